"""Python token counts, layout tokens, structural errors and statements."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweigh.functions.lexing import add_py_profile, indent_width, py_lexemes
from tests.reference_fold import profile_one

# FIXTURES.md 2.1: text, tokens, (nl, in, de), E1..E5, statements
GOLDEN = [
    ("", 0, (0, 0, 0), (0, 0, 0, 0, 0), 0),
    ("x = 1", 3, (0, 0, 0), (0, 0, 0, 1, 0), 1),
    ("x = 1\n", 4, (1, 0, 0), (0, 0, 0, 0, 0), 1),
    ("def f():\n    a = 1\n", 12, (2, 1, 1), (0, 0, 0, 0, 0), 2),
    ("def f():\n    a = 1", 12, (2, 1, 1), (0, 0, 0, 0, 0), 2),
    ("def asd(:\n    a = 1\n", 7, (0, 0, 0), (0, 1, 0, 0, 0), 1),
    ("if a:\n  if b:\n    c\nd\n", 16, (4, 2, 2), (0, 0, 0, 0, 0), 4),
    ("a\n\n\nb\n", 4, (2, 0, 0), (0, 0, 0, 0, 0), 2),
    ("a\n\n", 3, (2, 0, 0), (0, 0, 0, 0, 0), 1),
    ("# c\nx = 1\n", 5, (2, 0, 0), (0, 0, 0, 0, 0), 1),
    ("$a\n", 3, (1, 0, 0), (1, 0, 0, 0, 0), 1),
    ("    a\n", 5, (2, 1, 1), (0, 0, 1, 0, 0), 1),
    ("x = (1,\n     2)\n", 8, (1, 0, 0), (0, 0, 0, 0, 0), 1),
    ("x = 1_000\n", 5, (1, 0, 0), (0, 0, 0, 0, 1), 1),
    ("y := 2\n", 5, (1, 0, 0), (0, 0, 0, 0, 0), 1),
    ("0777\n", 3, (1, 0, 0), (0, 0, 0, 0, 1), 1),
    ("s = '''abc\n", 6, (1, 0, 0), (1, 0, 0, 0, 0), 1),
    ("f(a))\n", 6, (1, 0, 0), (0, 1, 0, 0, 0), 1),
    ("if a:\n    b\n  c\n  d\n", 14, (4, 2, 2), (0, 0, 1, 0, 0), 4),
    ("hello world\n", 3, (1, 0, 0), (0, 0, 0, 0, 1), 1),
    ("a = b'q' 'r'\n", 5, (1, 0, 0), (0, 0, 0, 0, 0), 1),
    ("if a: b\nelse:\n\tc\n", 12, (3, 1, 1), (0, 0, 0, 0, 0), 2),
    ("@d\ndef f(): pass\n", 10, (2, 0, 0), (0, 0, 0, 0, 0), 1),
]


def _profiles(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = add_py_profile(df, "text").orderBy("id").collect()
    return [r.prof for r in rows]


def test_goldens(spark):
    profs = _profiles(spark, [g[0] for g in GOLDEN])
    for (text, tokens, layout, errs, stmts), p in zip(GOLDEN, profs):
        assert p.tokens == tokens, text
        assert (p.nl, p.ind, p.ded) == layout, text
        assert (p.e1, p.e2, p.e3, p.e4, p.e5) == errs, text
        assert p.errors == sum(errs), text
        assert p.stmts == stmts, text


def test_clean_code_has_no_errors(spark):
    code = ("import os\n\n\nclass A(object):\n    def m(self, x=(1,\n              2)):\n"
            "        # comment\n        if x:\n            return [i for i in x]\n"
            "        elif x is None:\n            pass\n        else:\n            raise ValueError('no')\n")
    (p,) = _profiles(spark, [code])
    assert p.errors == 0
    # class, def, if, elif body, else body each open one level
    assert p.ind == p.ded == 5 and p.max_nesting == 3
    # import, class, def, if/elif/else (one compound statement), return, pass, raise
    assert p.stmts == 7


def test_tab_width(spark):
    # FIXTURES 2.2
    cases = [("", 0), ("    ", 4), ("\t", 8), ("  \t ", 9), ("        \t", 16)]
    df = spark.createDataFrame(cases, "b string, w int")
    got = df.select(indent_width("b").alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_robust_inputs(spark):
    big = "x = '''" + "a" * 360_000 + "'''\n"
    unclosed = "x = '''" + "a\\'" * 200_000 + "\n"
    esc = 's = "' + "\\n" * 100_000 + '"\n'
    texts = [big, unclosed, esc, "a\r\nb\r\n", "a\fb\n", "x = '😀' + 😀\n", None]
    profs = _profiles(spark, texts)
    assert profs[0].tokens == 4 and profs[0].errors == 0
    assert profs[2].tokens == 4
    assert profs[3].nl == 2
    assert profs[4].nl == 2
    assert profs[5].e1 == 1
    assert profs[6] is None


def test_lossless_and_balanced(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr(
            "page_id as doc_id", "html as text", "'x' as lang", "'p' as source", "0L as n_chars"))
    lx = df.select((F.array_join(py_lexemes("text"), "") == F.col("text")).alias("ok"))
    assert lx.where(~F.col("ok")).count() == 0
    p = add_py_profile(df, "text")
    assert p.where(F.col("prof.ind") != F.col("prof.ded")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0, 2, 12, 13]), max_size=40),
       st.lists(st.integers(0, 12), max_size=40))
def test_fold_invariants(codes, widths):
    packed = [c + 64 * (w if c in (1, 13) else 0) for c, w in zip(codes, widths + [0] * len(codes))]
    p = profile_one(packed)
    tokens, ntok, nl, ind, ded = p[:5]
    assert ind == ded
    assert tokens == ntok + nl + ind + ded
    assert min(p) >= 0 or p[5] < 0  # only final_depth may be negative


@pytest.mark.parametrize("text,expect", [
    ("rb'x' u'y' f\"z\" br'''w'''\n", ["rb'x'", " ", "u'y'", " ", 'f"z"', " ", "br'''w'''", "\n"]),
    ("1.5e3j .5 1. 0x1F 0o7 0b1 0777\n", ["1.5e3j", " ", ".5", " ", "1.", " ", "0x1F", " ", "0o7", " ",
                                          "0b1", " ", "0", "777", "\n"]),
    ("a**=b//=c...d->e<>f\n", ["a", "**=", "b", "//=", "c", "...", "d", "->", "e", "<>", "f", "\n"]),
    ("x \\\n  y # c\n", ["x", " ", "\\\n", "  ", "y", " ", "# c", "\n"]),
])
def test_lexemes(spark, text, expect):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(py_lexemes("t").alias("l")).first().l == expect


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]),
                                   st.integers(0, 12), st.booleans()), max_size=30), max_size=12))
def test_batch_fold_equals_per_text_fold(docs):
    import numpy as np

    from codeweigh.functions.layout import emit_batch, profile_batch
    from tests.reference_fold import emit_flags_one
    packs = [[k + 32 * int(lg) + 64 * (w if k in (1, 13, 14) else 0) for k, w, lg in d] for d in docs]
    flat = np.array([x for p in packs for x in p], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in packs]))).astype(np.int64)
    batch = profile_batch(flat, offsets)
    for i, p in enumerate(packs):
        assert tuple(batch[i]) == profile_one(p)
    flags = emit_batch(flat, offsets)
    assert flags.tolist() == [f for p in packs for f in (emit_flags_one(p) if p else [])]


def test_fold_is_linear_in_indented_texts():
    """The breaks looked at per text do not grow with the batch (counted, not timed)."""
    import numpy as np

    from codeweigh.functions import layout

    text = [4, 8, 1 + 64 * 4, 4, 9, 4, 1 + 64 * 4, 4, 1]  # name : NEWLINE+4 name = name NEWLINE+4 name NEWLINE
    looked = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            got = super().__getitem__(key)
            if isinstance(got, np.ndarray):
                looked[-1] += got.size
            return got

    real = np.flatnonzero
    for n in (100, 1000):
        looked.append(0)
        layout.np.flatnonzero = lambda x: real(x).view(Counting)
        try:
            out = layout.profile_batch(np.array(text * n), np.arange(n + 1) * len(text))
        finally:
            layout.np.flatnonzero = real
        assert (out == out[0]).all() and out[0][layout.PROFILE_FIELDS.index("ind")] == 1
    assert looked[1] <= 11 * looked[0]


QUOTED = ["\\", "\\", "'", '"', "'", "'''", '"""', "a", "b", "rb'", 'f"', "\n", "\r\n", "\r", "\f", " ", "é", "#", "\x01", "\x05",
          "\\'", '\\"', "\\\n", "\\\r\n", "b'''", "\\'''", '"""', '\\"""']


def test_masked_lexemes_equal_plain_ones(spark):
    """Quotes, backslashes and line ends in any order: masking dead openers changes no lexeme."""
    import random

    from codeweigh.functions import lexing as L
    r = random.Random(0)
    texts = ["".join(r.choice(QUOTED) for _ in range(r.randint(1, 60))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts if not {"\x01", "\x02", "\x03"} & set(t)], "t string").repartition(8)
    same = L._masked_lexemes(F.col("t")).eqNullSafe(L._plain_lexemes(F.col("t")))
    assert [r.t for r in df.where(~same).take(3)] == []
    # beyond the threshold the public function takes the masked way, also where a text holds stand-ins
    many = df.select(F.concat(F.repeat(F.lit("\\'\x02"), 40), "t").alias("t"))
    assert many.where(~py_lexemes("t").eqNullSafe(L._plain_lexemes(F.col("t")))).count() == 0
    every = "".join(map(chr, range(1, 32))) + "\\'" * 50  # no stand-ins left: plain
    assert spark.createDataFrame([(every,)], "t string").select(F.array_join(py_lexemes("t"), "")).first()[0] == every


def test_escaped_quotes_take_linear_time(spark):
    import time

    n = 1_000_000
    texts = ["s = " + "\\'" * n, "x = " + "\\'''" * (n // 4), '{"a":' + '\\"b\\":\\"c d\\",' * (n // 5)]
    for text in texts:
        df = spark.createDataFrame([(text,)], "t string").cache()
        df.count()
        took = []
        for _ in range(3):
            at = time.time()
            got = df.select(F.size(py_lexemes("t")).alias("n")).first().n
            took.append(time.time() - at)
        assert min(took) < 10, took  # 2 s on an idle machine; quadratic scans would take hours
        assert got > n // 8
