"""Which token may stand next to which (a strictly local acceptor).

No parser: every pair of neighbouring tokens of a logical line is looked up in a
fixed matrix.  The matrix is not written out but derived below from a few
statements about Python's syntax: what can begin an operand, what an operand
can be followed by, what each operator or keyword asks for next.  It has four
dimensions: the kind of line (its first token: ``from``, ``import``, ``match`` or
any other), whether the pair is inside brackets, the left and the right token's
class.  ``START`` and ``END`` stand for the edges of a line.

So ``a = = b``, ``y := 2`` (``:`` and ``=`` to the lexer rebuilt here), ``x = * / 2``,
``def (x)`` or ``f(return)`` each hold an illegal pair, and code that a parser accepts
holds none.  What needs more than a neighbour (``else`` without ``if``) is not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar as G
from .layout import DEDENT, INDENT, TOKEN_NAMES, _batch_emission, _flat, in_pieces, name_ids, pack_roles

START, END = "START", "END"
_NAMES, _NUMBERS = {"NAME", "_"}, {"NUMBER", "None", "True", "False"}
_CLOSERS = set(G.PY_CLOSERS)
_COMPARED = {"<", ">", "==", ">=", "<=", "<>", "!="}
_ARITHMETIC = {"|", "^", "&", "<<", ">>", "/", "%", "//", "@", "+", "-"}
_ASSIGNED = {t for t, _ in G.PY_OPERATORS if t.endswith("=")} - _COMPARED - {"="}
#: Tokens that behave alike are one class, named after one of them.
CLASS_OF = {t: t for t, _ in G.PY_KEYWORDS + G.PY_OPERATORS} | {"STRING": "STRING", "UNKNOWN_CHAR": "UNKNOWN_CHAR"}
for _group, _name in ((_NAMES, "NAME"), (_NUMBERS, "NUMBER"), (_COMPARED, "<"), (_ARITHMETIC - {"+", "-", "@"}, "/"), (_ASSIGNED, "+=")):
    CLASS_OF |= dict.fromkeys(_group, _name)
CLASSES = [START, END, *dict.fromkeys(CLASS_OF.values())]
KINDS = ["", "from", "import", "match"]

# ---- what the syntax says, in classes
_ATOM = {"NAME", "match", "NUMBER", "STRING", "...", "(", "[", "{"}  # begins an operand without a sign
_FACTOR = _ATOM | {"+", "-", "~", "await"}
_TEST = _FACTOR | {"not", "lambda"}  # begins an expression
_OPERAND_ENDS = {"NAME", "match", "NUMBER", "STRING", "..."} | _CLOSERS
_SIMPLE = _TEST | {"*", "del", "pass", "break", "continue", "return", "raise", "yield", "import", "from", "global", "nonlocal", "assert"}
_COMPOUND = {"if", "while", "for", "try", "with", "def", "class", "@", "async", "elif", "else", "except", "finally", "case"}
_STOP = {END, ";"}
#: After an operand: another operator, a trailer, or the end of what it stands in.
_AFTER_OPERAND = {"/", "+", "-", "@", "*", "**", "<", "or", "and", "is", "in", "not", "if", "else", "=", ":", ",", ".", "(", "[", "as", "from"}
#: Left class -> right classes, outside and inside brackets.
_BOTH = {
    **dict.fromkeys(_OPERAND_ENDS, _AFTER_OPERAND),
    **dict.fromkeys(["/", "+", "-", "@", "~", "<", "as", "await"], _FACTOR),
    "or": _FACTOR | {"not"}, "and": _FACTOR | {"not"}, "not": _FACTOR | {"not", "in"}, "is": _FACTOR | {"not"}, "in": _TEST,
    "if": _TEST, "else": _TEST, "for": _FACTOR | {"*"}, "async": {"for"}, "lambda": {"NAME", "match", "*", "**", ":"},
    "*": _TEST | {",", ":"}, "**": _TEST, "=": _TEST | {"*", "yield"}, ":": _TEST, ",": _TEST | {"*", "**", "="},
    ".": {"NAME", "match"}, "->": _TEST, "yield": _TEST | {"from"}, "from": _TEST,
}
_OUTSIDE = {
    START: _SIMPLE | _COMPOUND,
    **dict.fromkeys(_OPERAND_ENDS, _STOP | {"+="}),
    ")": _STOP | {"+=", "->"}, "+=": _TEST | {"yield"}, ":": _SIMPLE | {END}, ",": _STOP | {"+=", "in", ":", "if"}, ";": _SIMPLE | {END},
    "else": {":"}, "def": {"NAME", "match"}, "class": {"NAME", "match"}, "global": {"NAME", "match"}, "nonlocal": {"NAME", "match"},
    "del": _FACTOR | {"*"}, "pass": _STOP, "break": _STOP, "continue": _STOP, "return": _TEST | _STOP, "raise": _TEST | _STOP,
    "yield": _STOP | {"="}, "assert": _TEST, "while": _TEST, "with": _TEST, "elif": _TEST, "except": _TEST | {":"},
    "try": {":"}, "finally": {":"}, "case": _ATOM | {"-", "*"}, "async": {"def", "with"},
}
_INSIDE = {
    **dict.fromkeys(_OPERAND_ENDS, _CLOSERS | {"for", "async"}),
    "(": _TEST | {"*", "**", "yield", ")"}, "[": _TEST | {"*", ":", "]"}, "{": _TEST | {"*", "**", "}"},
    ",": _CLOSERS | {":", "in"}, ":": _CLOSERS | {":", ","}, "*": {")"}, "yield": _CLOSERS,
}
#: What lines of a kind allow besides, outside brackets.
_BY_KIND = {
    "from": {"from": {"NAME", "match", ".", "..."}, ".": {".", "...", "import"}, "...": {"...", "NAME", "match", "import"}, "NAME": {"import"}, "match": {"import"},
             "import": {"NAME", "match", "*", "("}, "*": _STOP},
    "import": {"import": {"NAME", "match"}},
    "match": {"match": _TEST | {"*"}},
}


def legal_pairs() -> list[tuple[str, bool, str, str]]:
    """(kind, inside, left, right) of every legal pair."""
    out = []
    for kind in KINDS:
        for inside in (False, True):
            here = _INSIDE if inside else _OUTSIDE
            more = {} if inside else _BY_KIND.get(kind, {})
            for left in CLASSES:
                right = here.get(left, set()) | more.get(left, set())
                if (kind, left) != ("from", "from"):
                    right = right | _BOTH.get(left, set())
                if left == "STRING":
                    right = right | {"STRING"}  # strings side by side are one
                out += [(kind, inside, left, r) for r in sorted(right)]
    return out


_INDEX = {c: i for i, c in enumerate(CLASSES)}
LEGAL = np.zeros((len(KINDS), 2, len(CLASSES), len(CLASSES)), dtype=bool)
for _kind, _inside, _left, _right in legal_pairs():
    LEGAL[KINDS.index(_kind), int(_inside), _INDEX[_left], _INDEX[_right]] = True


def token_classes() -> dict[str, str]:
    """Token name -> class, for the names of the token table."""
    named = {n: CLASS_OF[t] for t, n in G.PY_KEYWORDS + G.PY_OPERATORS}
    return named | {"NAME": "NAME", "NUMBER": "NUMBER", "STRING": "STRING", "UNKNOWN_CHAR": "UNKNOWN_CHAR", "NEWLINE": END}


_CLASS_OF_ID = np.array([_INDEX[token_classes()[n]] if n in token_classes() else -1 for n in TOKEN_NAMES], dtype=np.int64)
assert (_CLASS_OF_ID[[0, INDENT, DEDENT]] == -1).all()


def illegal_pairs(values: pa.Array, packed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text of a batch: pairs looked up, and how many of them are illegal."""
    d = len(offsets) - 1
    if not packed.size:
        return np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
    _, _, _, keep, ks, _, kd, is_nl, depth, emit, _, _ = _batch_emission(packed, offsets)
    seen = ~is_nl | emit
    right = _CLASS_OF_ID[name_ids(values, packed)[keep][seen]]
    doc = kd[seen]
    before = (depth - ((ks == 6).astype(np.int64) - (ks == 7)))[seen] > 0
    ends = right == _INDEX[END]
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | ends[:-1]))
    left = np.where(first, _INDEX[START], np.concatenate(([0], right[:-1])))
    kinds = np.zeros(len(CLASSES), dtype=np.int64)
    kinds[[_INDEX[k] for k in KINDS[1:]]] = range(1, len(KINDS))
    kind = kinds[right[first]][np.cumsum(first) - 1]
    real = ~(first & ends)  # an empty line is no pair
    wrong = real & ~LEGAL[kind, before.astype(np.int64), left, right]
    return np.bincount(doc[real], minlength=d), np.bincount(doc[wrong], minlength=d)


PAIRS_TYPE = T.StructType([T.StructField("pairs", T.LongType()), T.StructField("pair_errors", T.LongType())])


@F.arrow_udf(PAIRS_TYPE)
def pairs_udf(lex: pa.Array) -> pa.Array:
    """Neighbouring pairs and illegal ones of a text's lexemes."""
    return in_pieces(lex, _pair_counts)


def _pair_counts(lex: pa.Array) -> pa.Array:
    values, offsets, nulls, at_start = _flat(lex)
    counts = illegal_pairs(values, pack_roles(values, at_start), offsets)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in counts], names=["pairs", "pair_errors"], mask=pa.array(nulls))
