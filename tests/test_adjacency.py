"""Token pairs: goldens, and the matrix against an independent SQL join."""

import random

import duckdb
import pytest

from codeweigh.functions import adjacency as A
from codeweigh.operators.tokens import token_pairs
from tests.test_differential import PIECES

CLEAN = [
    "", "\n", "x = 1\n", "if a: b\nelse:\n\tc\n", "from ... import x\n", "from ...a.b import c as d, e\n", "from .a import (b, c)\n", "from . import *\n",
    "import a.b as c, d\n", "@d.e(f)\ndef f(): pass\n", "x: int = 3\n", "a[1:, ::2]\n", "match x:\n    case [a, *b] if c:\n        pass\n",
    "match = match + 1\n", "f = lambda *, a: 1\n", "g = lambda: (yield)\n", "print(*a, **k)\n", "x = yield\n", "x = yield from y\n",
    "async def f():\n    async with a as b, c:\n        await x\n", "[i async for i in x if not i]\n", "a = b = *c, d\n", "raise x from y\n", "raise\n",
    "s = '''a''' 'b'\n", "def f(a, *, b=1, **k) -> int: return\n", "x = a if b else c; pass\n", "for a, in b: continue\n", "a.b.c = d[e](f)\n",
    "with open(f) as g, h as i: pass\n", "try:\n    x\nexcept (A, B) as e:\n    raise\nfinally:\n    pass\n", "global a, b\n", "assert a, b\n",
    "x = {**a, 'b': c}\n", "x = -1 ** -2\n", "not a in b is not c\n", "return not x\n", "del a[0], b.c\n", "x @= y @ z\n", "x = (1,\n     2)\n", "x = ...\n", "x = 1 # c\n",
    "while not x: break\n", "class A(B, metaclass=C): pass\n", "x = y[...]\n", "x = {i: j for i, j in k}\n", "f(x for x in y)\n", "nonlocal z\n", "x <<= ~y\n",
]
WRONG = ["a = = b\n", "y := 2\n", "x = * / 2\n", "def (x):\n    pass\n", "f(return)\n", "hello world\n", "1 2\n", "x = )\n", "import 3\n", "from x y\n", "a b = c\n",
         "for in x: pass\n", "x = [1 2]\n", "$a\n", "x = not\n", "return return\n", "(a; b)\n", "x = (a = )\n", "class 3: pass\n", "x..y\n", "match 3 4:\n", "a ? b\n"]


def counted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: (r.pairs, r.pair_errors) for r in token_pairs(df, "id", "text").collect()}


def test_clean_code_has_no_illegal_pair(spark):
    got = counted(spark, CLEAN)
    assert {CLEAN[i]: g for i, g in got.items() if g[1]} == {}
    assert got[0] == got[1] == (0, 0) and got[2] == (4, 0)


def test_every_wrong_text_has_one(spark):
    got = counted(spark, WRONG + [None])
    assert [WRONG[i] for i in range(len(WRONG)) if not got[i][1]] == []
    assert got[len(WRONG)] == (None, None)
    assert got[0][1] == 1 and got[1][1] == 1  # = = and : =


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_sql_join_on_random_texts(spark, seed):
    from codeweigh.plans.oracle import token_pairs as sql
    r = random.Random(seed)
    more = ["from ", "import ", "match ", " in ", " not ", "lambda ", "yield ", " as ", "for ", "async ", "*", "**", "->", "+=", "return "]
    texts = ["".join(r.choice(PIECES + more) for _ in range(r.randint(0, 40))) for _ in range(500)] + CLEAN + WRONG
    got = counted(spark, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = {i: (p, e) for i, p, e in con.execute(sql("t", "id", "text")).fetchall()}
    assert got == want


def test_matrix_holds_what_the_pairs_say():
    assert A.LEGAL.sum() == len(A.legal_pairs()) == len(set(A.legal_pairs()))
    assert not A.LEGAL[..., A._INDEX["UNKNOWN_CHAR"]].any() and not A.LEGAL[..., A._INDEX["START"]].any()
    assert not A.LEGAL[:, 1, :, A._INDEX["return"]].any()  # no statement inside brackets
