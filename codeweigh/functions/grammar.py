"""Lexical tables and master patterns for the Python 3 and Java token jobs.

Each master pattern is an ordered alternation whose every match is one
lexeme; a final ``[\\s\\S]`` branch makes ``regexp_extract_all`` lossless, so
the concatenation of the lexemes of a row is the row's text.

Two flavours are produced from the same pieces:

* ``"java"`` for Spark (``java.util.regex``): possessive loops, so long
  literals never recurse per character;
* ``"re2"`` for DuckDB (RE2, the test oracle): no possessives, no
  look-ahead; long strings use a lazy loop instead.

Both are leftmost-first.  Alternatives are ordered so that the first branch
that matches is also the longest token the grammar allows (the grammar is
longest-match, first rule on ties).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the Python 3 grammar): keyword text -> token name,
# in grammar order.
# ---------------------------------------------------------------------------
PY_KEYWORDS = [
    ("and", "AND"), ("as", "AS"), ("assert", "ASSERT"), ("async", "ASYNC"),
    ("await", "AWAIT"), ("break", "BREAK"), ("case", "CASE"), ("class", "CLASS"),
    ("continue", "CONTINUE"), ("def", "DEF"), ("del", "DEL"), ("elif", "ELIF"),
    ("else", "ELSE"), ("except", "EXCEPT"), ("False", "FALSE"), ("finally", "FINALLY"),
    ("for", "FOR"), ("from", "FROM"), ("global", "GLOBAL"), ("if", "IF"),
    ("import", "IMPORT"), ("in", "IN"), ("is", "IS"), ("lambda", "LAMBDA"),
    ("match", "MATCH"), ("None", "NONE"), ("nonlocal", "NONLOCAL"), ("not", "NOT"),
    ("or", "OR"), ("pass", "PASS"), ("raise", "RAISE"), ("return", "RETURN"),
    ("True", "TRUE"), ("try", "TRY"), ("_", "UNDERSCORE"), ("while", "WHILE"),
    ("with", "WITH"), ("yield", "YIELD"),
]

# FIXED VALUES (Python 3 grammar): operator text -> token name, grammar order.
PY_OPERATORS = [
    (".", "DOT"), ("...", "ELLIPSIS"), ("*", "STAR"), ("(", "OPEN_PAREN"),
    (")", "CLOSE_PAREN"), (",", "COMMA"), (":", "COLON"), (";", "SEMI_COLON"),
    ("**", "POWER"), ("=", "ASSIGN"), ("[", "OPEN_BRACK"), ("]", "CLOSE_BRACK"),
    ("|", "OR_OP"), ("^", "XOR"), ("&", "AND_OP"), ("<<", "LEFT_SHIFT"),
    (">>", "RIGHT_SHIFT"), ("+", "ADD"), ("-", "MINUS"), ("/", "DIV"),
    ("%", "MOD"), ("//", "IDIV"), ("~", "NOT_OP"), ("{", "OPEN_BRACE"),
    ("}", "CLOSE_BRACE"), ("<", "LESS_THAN"), (">", "GREATER_THAN"), ("==", "EQUALS"),
    (">=", "GT_EQ"), ("<=", "LT_EQ"), ("<>", "NOT_EQ_1"), ("!=", "NOT_EQ_2"),
    ("@", "AT"), ("->", "ARROW"), ("+=", "ADD_ASSIGN"), ("-=", "SUB_ASSIGN"),
    ("*=", "MULT_ASSIGN"), ("@=", "AT_ASSIGN"), ("/=", "DIV_ASSIGN"), ("%=", "MOD_ASSIGN"),
    ("&=", "AND_ASSIGN"), ("|=", "OR_ASSIGN"), ("^=", "XOR_ASSIGN"),
    ("<<=", "LEFT_SHIFT_ASSIGN"), (">>=", "RIGHT_SHIFT_ASSIGN"), ("**=", "POWER_ASSIGN"),
    ("//=", "IDIV_ASSIGN"),
]

# FIXED VALUES (Python 3 grammar): code points added to identifier start /
# continue beyond the Unicode categories (Other_ID_Start, Other_ID_Continue).
PY_ID_START_EXTRA = r"\x{1885}\x{1886}\x{2118}\x{212E}\x{309B}\x{309C}"
PY_ID_CONTINUE_EXTRA = r"\x{00B7}\x{0387}\x{1369}-\x{1371}\x{19DA}"

# Roles the structural audit gives to tokens (ours, not the grammar's).
PY_OPENERS = ["(", "[", "{"]
PY_CLOSERS = [")", "]", "}"]
PY_OPERAND_KEYWORDS = ["None", "True", "False", "_"]
# A logical line starting with one of these continues a compound statement
# (or decorates one) and is not a statement of its own.
PY_CONTINUATION_KEYWORDS = ["elif", "else", "except", "finally", "case"]

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the Java grammar): keywords, literal words and
# operators with their token names, in grammar order.
# ---------------------------------------------------------------------------
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char",
    "class", "const", "continue", "default", "do", "double", "else", "enum",
    "extends", "final", "finally", "float", "for", "if", "goto", "implements",
    "import", "instanceof", "int", "interface", "long", "native", "new", "package",
    "private", "protected", "public", "return", "short", "static", "strictfp", "super",
    "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void",
    "volatile", "while", "module", "open", "requires", "exports", "opens", "to",
    "uses", "provides", "with", "transitive", "var", "yield", "record", "sealed",
    "permits",
]
JAVA_WORD_LITERALS = [("true", "BOOL_LITERAL"), ("false", "BOOL_LITERAL"), ("null", "NULL_LITERAL")]
JAVA_OPERATORS = [
    ("(", "LPAREN"), (")", "RPAREN"), ("{", "LBRACE"), ("}", "RBRACE"),
    ("[", "LBRACK"), ("]", "RBRACK"), (";", "SEMI"), (",", "COMMA"), (".", "DOT"),
    ("=", "ASSIGN"), (">", "GT"), ("<", "LT"), ("!", "BANG"), ("~", "TILDE"),
    ("?", "QUESTION"), (":", "COLON"), ("==", "EQUAL"), ("<=", "LE"), (">=", "GE"),
    ("!=", "NOTEQUAL"), ("&&", "AND"), ("||", "OR"), ("++", "INC"), ("--", "DEC"),
    ("+", "ADD"), ("-", "SUB"), ("*", "MUL"), ("/", "DIV"), ("&", "BITAND"),
    ("|", "BITOR"), ("^", "CARET"), ("%", "MOD"), ("+=", "ADD_ASSIGN"),
    ("-=", "SUB_ASSIGN"), ("*=", "MUL_ASSIGN"), ("/=", "DIV_ASSIGN"), ("&=", "AND_ASSIGN"),
    ("|=", "OR_ASSIGN"), ("^=", "XOR_ASSIGN"), ("%=", "MOD_ASSIGN"), ("<<=", "LSHIFT_ASSIGN"),
    (">>=", "RSHIFT_ASSIGN"), (">>>=", "URSHIFT_ASSIGN"), ("->", "ARROW"),
    ("::", "COLONCOLON"), ("@", "AT"), ("...", "ELLIPSIS"),
]


def java_keyword_names():
    """Keyword text -> token name (the rule name is the upper-cased word)."""
    out = [(k, k.upper()) for k in JAVA_KEYWORDS]
    out.append(("non-sealed", "NON_SEALED"))
    return out + JAVA_WORD_LITERALS


def _escape(op: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\/-" else c for c in op)


def _ops_alternation(ops) -> str:
    """Longest operators first so leftmost-first equals longest match."""
    texts = sorted({o for o, _ in ops}, key=lambda s: (-len(s), s))
    return "|".join(_escape(t) for t in texts)


def _poss(flavor: str) -> tuple[str, str]:
    """Star and plus suffixes: possessive for Java and Python's re, plain for RE2."""
    return ("*", "+") if flavor == "re2" else ("*+", "++")


# ----------------------------------------------------------------- Python
def python_pattern(flavor: str = "java") -> str:
    star, plus = _poss(flavor)
    nl = r"(?:\r\n|\n|\r|\f)[ \t]" + star
    ws = r"[ \t]" + plus
    comment = r"#[^\r\n\f]" + star
    join = r"\\[ \t]" + star + r"(?:\r\n|\n|\r|\f)"
    esc = r"\\(?:\r\n|[\s\S])"
    if flavor == "java":
        long_sq = r"'''[^\\']*+(?:(?:\\[\s\S]|'(?!''))[^\\']*+)*+'''"
        long_dq = r'"""[^\\"]*+(?:(?:\\[\s\S]|"(?!""))[^\\"]*+)*+"""'
        short_sq = r"'[^\\\r\n\f']*+(?:" + esc + r"[^\\\r\n\f']*+)*+'"
        short_dq = r'"[^\\\r\n\f"]*+(?:' + esc + r'[^\\\r\n\f"]*+)*+"'
        lb = r"[\x00-\x26\x28-\x5b\x5d-\x7f]"
        lbd = r"[\x00-\x21\x23-\x5b\x5d-\x7f]"
        long_sb = r"'''" + lb + r"*+(?:(?:\\[\x00-\x7f]|'(?!''))" + lb + r"*+)*+'''"
        long_db = r'"""' + lbd + r'*+(?:(?:\\[\x00-\x7f]|"(?!""))' + lbd + r'*+)*+"""'
    else:
        long_sq = r"'''(?:[^\\]|\\[\s\S])*?'''"
        long_dq = r'"""(?:[^\\]|\\[\s\S])*?"""'
        short_sq = r"'(?:[^\\\r\n\f']|" + esc + r")*'"
        short_dq = r'"(?:[^\\\r\n\f"]|' + esc + r')*"'
        long_sb = r"'''(?:[\x00-\x5b\x5d-\x7f]|\\[\x00-\x7f])*?'''"
        long_db = long_sb.replace("'''", '"""')
    sbs = r"[\x00-\x09\x0b\x0c\x0e-\x26\x28-\x5b\x5d-\x7f]"
    sbd = r"[\x00-\x09\x0b\x0c\x0e-\x21\x23-\x5b\x5d-\x7f]"
    short_sb = "'" + sbs + star + r"(?:\\[\x00-\x7f]" + sbs + star + ")" + star + "'"
    short_db = '"' + sbd + star + r"(?:\\[\x00-\x7f]" + sbd + star + ")" + star + '"'
    string = (r"(?:[rR][fF]?|[fF][rR]?|[uU])?(?:" + "|".join([long_sq, long_dq, short_sq, short_dq]) + ")")
    bytes_ = r"(?:[bB][rR]?|[rR][bB])(?:" + "|".join([long_sb, long_db, short_sb, short_db]) + ")"
    d = "[0-9]"
    expo = r"(?:[eE][+-]?" + d + plus + ")"
    number = "|".join([
        r"(?:" + d + plus + r"\." + d + star + r"|\." + d + plus + ")" + expo + r"?[jJ]?",
        d + plus + r"(?:" + expo + r"[jJ]?|[jJ])",
        r"0[xX][0-9a-fA-F]" + plus, r"0[oO][0-7]" + plus, r"0[bB][01]" + plus,
        r"[1-9]" + d + star, "0" + plus,
    ])
    if flavor == "word":  # Python's re; other characters than ASCII are those of identifiers
        word = r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*+"
        return "|".join("(?:" + p + ")" for p in [word, number, _ops_alternation(PY_OPERATORS), r"[\s\S]"])
    id_start = r"[_\p{L}\p{Nl}" + PY_ID_START_EXTRA + "]"
    id_cont = r"[_\p{L}\p{Nl}" + PY_ID_START_EXTRA + r"\p{Mn}\p{Mc}\p{Nd}\p{Pc}" + PY_ID_CONTINUE_EXTRA + "]"
    name = id_start + id_cont + star
    ops = _ops_alternation(PY_OPERATORS)
    if flavor == "java":
        # Same tokens, cheaper order: only string/bytes prefixes overlap with
        # identifiers, so an identifier not followed by a quote within two
        # characters can be tried right after blanks.
        guarded = r"(?![rRuUfFbB]{1,2}['\"])" + name
        parts = [ws, guarded, nl, number, ops, string, bytes_, name, comment, join, r"[\s\S]"]
    else:
        parts = [nl, ws, comment, join, string, bytes_, number, name, ops, r"[\s\S]"]
    return "|".join("(?:" + p + ")" for p in parts)


#: A word of more characters is never part of a stretch: a search for one ends after so many.
LONGEST_WORD = 64


def python_stretch() -> str:
    """Java pattern of a stretch: words without quotes, ``#``, backslashes and line breaks, each
    followed by blanks.  No lexeme but a string, a comment or a line break or join holds a blank,
    so the lexemes of a stretch are those of its words, taken alone, and its runs of blanks."""
    signs = "".join(f"\\x{c:02x}" for c in range(33, 127) if chr(c) not in "\"'#\\")  # one by one: Java looks them up in a bit set
    return "(?:[" + signs + r"\p{L}]" + f"{{1,{LONGEST_WORD}}}+" + r"[ \t]++)++"


# ------------------------------------------------------------------- Java
def java_pattern(flavor: str = "java") -> str:
    star, plus = _poss(flavor)
    ws = r"[ \t\r\n\f]" + plus
    block = r"/\*[\s\S]*?\*/"
    line = r"//[^\r\n]" + star
    esc = r"\\(?:[btnfr" + "\"'" + r"\\]|[0-3][0-7][0-7]|[0-7][0-7]?|u+[0-9a-fA-F]{4})"
    text_block = r'"""[ \t]' + star + r'[\r\n][\s\S]*?"""'
    if flavor == "java":
        string = r'"[^"\\\r\n]*+(?:' + esc + r'[^"\\\r\n]*+)*+"'
    else:
        string = r'"(?:[^"\\\r\n]|' + esc + r')*"'
    char = r"'(?:[^'\\\r\n]|" + esc + r")'"
    digits = r"[0-9](?:[0-9_]*[0-9])?"
    hexd = r"[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?"
    number = "|".join([
        r"0[xX](?:" + hexd + r"\.?|(?:" + hexd + r")?\." + hexd + r")[pP][+-]?" + digits + r"[fFdD]?",
        r"0[xX]" + hexd + r"[lL]?",
        r"0[bB][01](?:[01_]*[01])?[lL]?",
        r"(?:" + digits + r"\.(?:" + digits + r")?|\." + digits + r")(?:[eE][+-]?" + digits + r")?[fFdD]?",
        digits + r"(?:[eE][+-]?" + digits + r"[fFdD]?|[fFdD])",
        r"0_*[0-7](?:[0-7_]*[0-7])?[lL]?",
        r"(?:0|[1-9](?:_+" + digits + "|(?:" + digits + r")?))[lL]?",
    ])
    ident = r"non-sealed|[a-zA-Z$_\x{80}-\x{10FFFF}][a-zA-Z0-9$_\x{80}-\x{10FFFF}]" + star
    ops = _ops_alternation(JAVA_OPERATORS)
    if flavor == "java":
        # Same tokens, cheaper order: identifiers share no first character with
        # comments, strings, numbers or operators, so they go right after blanks.
        parts = [ws, ident, block, line, text_block, string, char, number, ops, r"[\s\S]"]
    else:
        parts = [ws, block, line, text_block, string, char, number, ident, ops, r"[\s\S]"]
    return "|".join("(?:" + p + ")" for p in parts)
