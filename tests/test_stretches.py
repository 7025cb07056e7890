"""Stretches of plain words left whole by the JVM: the same lexemes, counts and ids."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweigh.functions import lexing as L
from codeweigh.functions import stretches as S
from codeweigh.operators import token_rows

PIECES = ["a", "rb", "f", "ü", "naïve", "日本", "é", "·", "٣", "–", "😀", "_", "x1", "1", "0x1F", "0b2", "1.5e-3", ".5", "1_000", "12e", "3j", "'", '"',
          "'''", "#", "\\", "\\\n", "\n", "\r\n", "\f", "\t", " ", "  ", " ", " ", "...", "->", "**=", "==", "!=", "!", "$", "?", "`", "(", "]", "{", ":", ",", ".", ";", "\x01", "\x7f",
          " ", "don't", "b'x'", "rF\"y\"", "not in", "w" * 63, "w" * 64, "w" * 65, "a,b;" * 40, "\\'" * 40]


def texts(n, seed=7):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) + r.choice(["", "", " ", " "]) for _ in range(r.randrange(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    """(id, lexemes, stretches) of random texts, a null one and an empty one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "a ", " a b", *texts(3000)])], "id long, text string").repartition(3)
    return df.select("id", L.py_lexemes("text").alias("whole"), L.py_stretches("text").alias("lexemes")).toArrow().sort_by("id")


def cut(lex):
    """The lexemes of each text of a batch of stretches."""
    parts, before = S.cut(lex.flatten())
    coded = parts.dictionary_encode()
    lexemes, size = S.lexemes_of(coded.dictionary)
    lexemes, known, at = lexemes.to_pylist(), [], 0
    for n in size.tolist():
        known.append(lexemes[at:at + n])
        at += n
    words = [known[i] for i in coded.indices.to_pylist()]
    offsets = lex.offsets.to_numpy(zero_copy_only=False)
    ends = before[offsets - offsets[0]].tolist()
    return [None if null else [x for w in words[a:b] for x in w] for null, a, b in zip(lex.is_null().to_pylist(), ends, ends[1:])]


def test_stretches_hold_the_same_lexemes(rows):
    lex, whole = rows["lexemes"].combine_chunks(), rows["whole"].to_pylist()
    assert cut(lex) == whole
    assert cut(lex.slice(11, 100)) == whole[11:111]
    assert cut(lex.slice(0, 0)) == []


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_counts_are_those_of_the_lexemes(rows, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_BYTES", most)
    lex = rows["lexemes"].combine_chunks()
    got = S.count(lex).to_pylist()
    assert {r["lexeme"]: r["n"] for r in got} == Counter(x for t in rows["whole"].to_pylist() for x in t or ())
    assert len(got) == len({r["lexeme"] for r in got})
    assert S.count(lex.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("size", [0, 7, 5000])
def test_vocabulary_and_ids_are_the_same(spark, monkeypatch, size):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *texts(400, 3)])], "id long, text string").repartition(2)
    one, two = token_rows.lex_documents(df, "id", "text"), token_rows.lex_stretches(df, "id", "text")
    vocab = token_rows.vocab_from_lexemes(one, "lexemes", size)
    assert token_rows.vocab_from_lexemes(two, "lexemes", size, stretched=True).orderBy("id").collect() == vocab.orderBy("id").collect()
    want = {r["id"]: r["input_ids"] for r in token_rows.tokenize_lexemes(one, "id", "lexemes", vocab, size).collect()}
    assert {r["id"]: r["input_ids"] for r in token_rows.tokenize_lexemes(two, "id", "lexemes", vocab, size, stretched=True).collect()} == want
    assert want[0] is None and want[1] == []


def test_prose_leaves_the_jvm_in_few_strings(spark):
    df = spark.createDataFrame([("Some words, and more of them (as here); all on one line. " * 50,)], "text string")
    r = df.select(F.size(L.py_lexemes("text")).alias("lexemes"), F.size(L.py_stretches("text")).alias("strings")).first()
    assert r["strings"] == 1 and r["lexemes"] > 1000


def test_a_long_word_is_searched_a_bounded_way(spark):
    """Without its bound a word would be searched to its end at each of its lexemes."""
    df = spark.createDataFrame([("a," * 300_000,)], "text string")
    assert df.select(F.size(L.py_stretches("text")).alias("n")).first()["n"] == 600_000


def test_pieces_are_cut_by_bytes():
    lex = pa.array([["ab "], ["c", "d e f "], None, [], ["long " * 9], ["x"]], pa.list_(pa.string()))
    got = [p.to_pylist() for p in S.slices(lex, S._ends(lex.values)[lex.offsets.to_numpy()], 10)]
    assert got == [[["ab "], ["c", "d e f "], None, []], [["long " * 9]], [["x"]]]
