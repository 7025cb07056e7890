"""Column functions that lex source text and audit its structure.

Lexing runs inside the JVM: one ``regexp_extract_all`` per text turns it
into its lexemes (lossless).  Roles and the sequential part of the Python
lexer -- NEWLINE suppression inside brackets and before blank/comment lines,
INDENT/DEDENT from an indent stack, the extra NEWLINE and DEDENTs at end of
input -- are computed by :mod:`codeweigh.functions.layout`, an Arrow UDF
that classifies whole batches with ``pyarrow.compute`` and folds with numpy
prefix sums.  (Measured: the same fold as a higher-order ``aggregate()`` is
interpreted and 10x slower; role codes as a ``transform`` CASE cost more
than the regex itself.)

Role codes (``k``):

====  =====================================================================
0     blanks (skipped)
1     line break (CR or LF) with its trailing blanks: NEWLINE candidate
13    the same, starting with a form feed; 14 blanks at offset 0
2     backslash line join, 12 comment (skipped)
3     UNKNOWN_CHAR
4     operand: NAME, NUMBER, ``None``/``True``/``False``/``_``
5     STRING
6     opener ``( [ {``, 7 closer ``) ] }``, 8 ``:``
9     any other operator or keyword
10    keyword continuing a compound statement (elif, else, except, finally,
      case), 11 ``@``
====  =====================================================================

The structural error score is **our stated approximation** of a parser's
syntax-error count (see README): E1 runs of UNKNOWN_CHAR lexemes, E2
unmatched closers plus openers left open, E3 INDENT not after ``:`` NEWLINE
plus ``:`` NEWLINE without INDENT, E4 last logical line unterminated at depth
0 with no open indent, E5 logical lines holding two adjacent operands (two
adjacent strings are legal).  It misses other grammar errors such as
``a = = b`` and accepts ``y := 2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G

PY_PATTERN = G.python_pattern("java")
JAVA_PATTERN = G.java_pattern("java")
STRETCH_PATTERN = f"(?:{G.python_stretch()})|{PY_PATTERN}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_lexemes(text) -> Column:
    """The ordered, lossless lexemes of a text (null text -> null).

    Linear in the text: one with many escaped quotes is lexed with its dead
    openers masked (see :func:`_without_dead_openers`)."""
    return _lexed(_c(text), _plain_lexemes)


def py_stretches(text) -> Column:
    """The lexemes of a text, with stretches of plain words (:func:`grammar.python_stretch`) left
    whole: far fewer strings leave the JVM.  :mod:`codeweigh.functions.stretches` cuts them."""
    return _lexed(_c(text), lambda t: F.regexp_extract_all(t, F.lit(STRETCH_PATTERN), 0))


def _lexed(t: Column, plain) -> Column:
    many = _many_escaped_quotes(t)
    lexemes = plain(t)
    for three in _STANDINS:
        lexemes = F.when(many & _without(t, three), _masked_lexemes(t, three)).otherwise(lexemes)
    return F.when(F.contains(t, F.lit("\\")), lexemes).otherwise(plain(t))  # one scan settles most texts


def _plain_lexemes(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(PY_PATTERN), 0)


#: Escaped quotes from which on a text is lexed with its dead openers masked.
ESCAPED_QUOTES = 32
# Three characters that stand for a masked single quote, a masked double quote and a
# cut between quotes.  Each is a lexeme of its own outside strings and comments, like a
# dead quote, and ASCII, so bytes literals stay what they are.  A text gets one of the
# triples that it does not hold (each is a branch of its own: a lambda of Spark that uses a variable
# of the lambda around it cannot be the input of a UDF).
_STANDINS = ["\x01\x02\x03", "\x1a\x1b\x1c", "\x0e\x0f\x10"]


def _many_escaped_quotes(t: Column) -> Column:
    """Whether masking pays: only escaped quotes can be dead in numbers (below)."""
    there = F.contains(t, F.lit("\\'")) | F.contains(t, F.lit('\\"'))
    return there & (F.regexp_count(t, F.lit("\\\\['\"]")) > ESCAPED_QUOTES)


def _without(t: Column, characters: str) -> Column:
    return ~t.rlike("[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]")


def _without_dead_openers(t: Column, quote: str, mask: str, cut: str) -> Column:
    """``t`` without quotes that would open a string and find no end.

    Whether a quote is escaped (an odd number of backslashes before it) is the
    same for every string that could hold it, because a string starts behind a
    quote and so never inside a row of backslashes.  So one pass settles all:

    * Short strings end at the next unescaped quote of their stretch (up to an
      unescaped line end).  Behind a stretch's last unescaped quote only escaped ones are
      left; none can end a string, and each would scan to the stretch's end in vain.
      They are replaced by ``mask``.
    * Long strings end at the next unescaped triple quote.  Behind the text's last one
      every three quotes open a long string in vain, then read as an empty
      string; ``cut`` goes between their second and third.

    What is left are one failing scan for each stretch and quote.
    """
    piece = rf"(?:[^\\{quote}\r\n\f]++|\\(?:\r\n|[\s\S]))++|[{quote}\r\n\f]|\\"
    long_piece = rf"(?:[^\\{quote}]++|\\[\s\S]|{quote}(?!{quote * 2}))++|{quote * 3}|\\"

    def mask_short(parts: Column) -> Column:
        after = F.concat(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")))
        return F.array_join(F.zip_with(parts, after, lambda x, y: F.when(
            (F.length(x) == 1) | (y == quote), x).otherwise(F.replace(x, F.lit(quote), F.lit(mask)))), "")

    def cut_long(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        opened = F.regexp_replace(last, F.lit(f"{quote * 2}(?={quote})"), F.lit(quote * 2 + cut))
        return F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ""), F.when(last == quote * 3, last).otherwise(opened))

    short = _let(F.regexp_extract_all(t, F.lit(piece), 0), mask_short)
    return _let(F.regexp_extract_all(short, F.lit(long_piece), 0), cut_long)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The same lexemes, with the two commonest of masked texts first: a control
#: character (no rule accepts one) and a backslash that joins no lines.
_MASKED_PATTERN = r"[\x01-\x08\x0e-\x1f]|\\(?![ \t]*+[\r\n\f])|" + PY_PATTERN


def _masked_lexemes(t: Column, three: str = _STANDINS[0]) -> Column:
    """:func:`_plain_lexemes`, found in the masked text and turned back."""
    one, two, cut = three
    masked = _without_dead_openers(_without_dead_openers(t, "'", one, cut), '"', two, cut)
    # the commonest lexemes first; translate() drops the cut, which has no partner
    back = F.transform(F.regexp_extract_all(masked, F.lit(_MASKED_PATTERN), 0), lambda x: F.when(x == "\\", x).when(x == one, "'").when(x == two, '"').otherwise(
        F.translate(x, three, "'\"")))
    return F.filter(back, lambda x: x != "")


def java_lexemes(text) -> Column:
    """T10 input: ordered, lossless lexemes of Java source."""
    return F.regexp_extract_all(_c(text), F.lit(JAVA_PATTERN), 0)


def indent_width(blanks) -> Column:
    """Column width of a run of blanks; a tab moves to the next multiple of 8."""
    b = _c(blanks)
    return F.when(F.instr(b, "\t") == 0, F.length(b)).otherwise(
        F.aggregate(F.split(b, ""), F.lit(0),
                    lambda acc, ch: F.when(ch == "\t", acc + 8 - acc % 8)
                    .when(ch == "", acc).otherwise(acc + 1)))


def add_py_profile(df, text, out: str = "prof"):
    """Add struct column ``out`` with the Python-lexer profile of ``text``.

    Fields: ``tokens`` (tokens the lexer emits, EOF excluded), ``ntok``
    (tokens other than NEWLINE/INDENT/DEDENT), ``nl``, ``ind``, ``ded``,
    ``final_depth``, ``max_depth``, ``unmatched_closers``, ``open_left``,
    ``max_nesting``, ``stmts``, ``e1``..``e5`` and ``errors``.
    Null text gives a null struct.
    """
    from .layout import profile_udf
    return df.withColumn(out, profile_udf(py_lexemes(text)))


def py_roles(lex):
    """``struct(codes array<int>, emit array<boolean>)`` per lexeme array:
    packed role codes and which line breaks the lexer emits as NEWLINE."""
    from .layout import roles_udf
    return roles_udf(_c(lex))
