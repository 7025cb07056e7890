"""Byte-pair merges learned in Spark against a brute-force trainer."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweigh.operators import subwords as S
from codeweigh.operators import token_rows


def brute_train(words, merges, least=2):
    now, learned = [(list(w.encode()), n) for w, n in words], []
    while len(learned) < merges:
        counts = Counter()
        for w, n in now:
            for p in zip(w, w[1:]):
                counts[p] += n
        best = min(counts.items(), key=lambda x: (-x[1], x[0]), default=((0, 0), 0))
        if best[1] < least:
            break
        now = [(S.join_pairs(w, {best[0]: len(learned)}, [best[0]]), n) for w, n in now]
        learned.append(best[0])
    return learned


def corpus(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(12)]
    return [(w, r.randint(1, 9)) for w in {"".join(r.choice(stems) for _ in range(r.randint(1, 4)))[:S.PIECE] for _ in range(n)}]


def test_training_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUNDS", 3)  # the index is rebuilt on the way
    for seed, n, merges in ((1, 60, 40), (2, 3, 30)):
        words = corpus(seed, n) + [("aaaaaaa", 2), ("x", 5)]
        df = spark.createDataFrame(words, "word string, n long").repartition(3)
        assert S.train(df, merges) == brute_train(words, merges)


def test_nothing_to_learn(spark):
    assert S.train(spark.createDataFrame([], "word string, n long"), 5) == []
    assert S.train(spark.createDataFrame([("ab", 1), ("c", 9)], "word string, n long"), 5) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", min_size=1, max_size=9), st.integers(1, 5)), max_size=12))
def test_merges_that_share_a_round_change_nothing(words):
    """The brute-force order of merges begins with every safe prefix."""
    counts = Counter()
    for w, n in words:
        for p in zip(w.encode(), w.encode()[1:]):
            counts[p] += n
    best = sorted(((a, b, n) for (a, b), n in counts.items() if n >= 2), key=lambda x: (-x[2], x[0], x[1]))
    if best:
        merged = S.safe_prefix(best, True)
        assert merged == brute_train(words, len(merged))
        assert S.safe_prefix(best[:3], False) == merged[:len(S.safe_prefix(best[:3], False))]


def test_ids_and_round_trip(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcé😀") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    texts += ["", None, "x" * 100_000, "'" + "ab" * 5000 + "'", "\x00퟿\n\t", "def f(x):\n    return 'unseen ☃'"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    lexed = token_rows.lex_documents(df, "id", "text")
    counted = S.count_words(lexed, "lexemes").collect()
    assert max(len(x.word) for x in counted) == S.PIECE and sum(len(x.word) * x.n for x in counted) == sum(len(t or "") for t in texts)
    merges = brute_train([(x.word, x.n) for x in counted], 30)
    coded = S.encode(lexed, "id", "lexemes", merges)
    encoder, got = S.Encoder(merges), {}
    for row in S.decode(coded, "input_ids", merges).collect():
        assert row.decoded == texts[row.id]
        got[row.id] = row.input_ids
    lexemes = {x.id: x.lexemes for x in lexed.collect()}
    for i, t in enumerate(texts):
        if t is not None:
            # merges applied one by one to every piece, as in training
            pieces = [x[at:at + S.PIECE] for x in lexemes[i] for at in range(0, len(x), S.PIECE)]
            if len(t) < 2000:
                assert got[i] == [s for p in pieces for s in S.join_pairs(list(p.encode()), encoder.ranks, merges)]
    table = S.learned_table(spark, merges).collect()
    assert [(x.left, x.right) for x in table] == merges and bytes.fromhex(table[0].token) == S.token_bytes(merges)[256]


@pytest.mark.parametrize("few", [0, 1000])
def test_array_passes_give_the_ids_of_single_lexemes(monkeypatch, few):
    monkeypatch.setattr(S, "FEW_MERGES", few)
    r = random.Random(few)
    merges = [(97, 97), (256, 97), (97, 98), (256, 256), (195, 169), (258, 260), (98, 97)]
    texts = ["".join(r.choice("aabé") for _ in range(r.randrange(1, 90))) for _ in range(300)] + ["a" * 65, "é" * 33, "a" * 32 + "b"]
    encoder = S.Encoder(merges)
    flat, sizes = S.encode_words(pa.array(texts), merges)
    ends = np.cumsum(sizes)
    assert [flat[e - n:e].tolist() for e, n in zip(ends, sizes)] == [encoder.lexeme(t) for t in texts]


def test_words_are_stored_once(spark, monkeypatch):
    """What training writes is no larger than the words: no copy of a word for each of its pairs."""
    stored = []
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: stored.append(write(df)) or stored[-1])
    words = spark.createDataFrame([("".join(random.Random(k).choice("abcdefgh") for _ in range(30)), 1) for k in range(500)], "word string, n bigint")
    assert len(S.train(words, 3)) == 3
    assert all(t.count() <= 500 for t in stored)


def test_query_learns_until_no_pair_occurs_twice(spark, tmp_path):
    """As many merges as the texts give, up to the size of the original's vocabulary."""
    import __spark_entry__ as E
    from codeweigh.plans.catalog import PARAMS

    assert PARAMS["subword_merges"] == token_rows.DEFAULT_VOCAB
    r = random.Random(7)
    texts = [" ".join("".join(r.choice(["ba", "ro", "é", "tu", "x"]) for _ in range(r.randint(1, 5))) for _ in range(40)) for _ in range(12)]
    texts += [None, "", " ", "\tba ro\n  tu = 'x ba' # ro tu\r\n", "f(ba, 3.5e1)  ro.tu\\\n x", "ba " * 70_000, "é😀 \x00 ba", "'" + "ba" * 50, "tu" * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lexemes = {x.id: x.lexemes for x in token_rows.lex_documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    merges = brute_train(list(Counter(x[at:at + S.PIECE] for each in lexemes.values() for x in each or [] for at in range(0, len(x), S.PIECE)).items()), 10_000)
    assert len(merges) > 64
    encoder = S.Encoder(merges)
    for row in E.queries()["subword_ids"](spark, str(tmp_path)).collect():
        assert (row.input_ids or []) == [i for x in lexemes[row.doc_id] or [] for i in encoder.lexeme(x)]
        assert row.same_text or texts[row.doc_id] is None


@pytest.mark.parametrize("ahead, contexts", [(1, 1000), (3, 5), (4, 1000), (50, 20)])
def test_rounds_of_contexts_equal_brute_force(spark, monkeypatch, ahead, contexts):
    """However few pairs and contexts a round takes, ties across its last pair included."""
    monkeypatch.setattr(S, "AHEAD", ahead)
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    words = corpus(ahead, 25) + [("aaaaaaa", 2), ("abababa", 3), ("x", 5)]
    assert S.train(spark.createDataFrame(words, "word string, n long").repartition(3), 25) == brute_train(words, 25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", min_size=1, max_size=9), st.integers(1, 5)), max_size=12), st.integers(1, 12))
def test_contexts_tell_the_merges_up_to_their_last_pair(words, ahead):
    counts = Counter()
    for w, n in words:
        for p in zip(w.encode(), w.encode()[1:]):
            counts[p] += n
    best = sorted((-n, *p) for p, n in counts.items() if n >= 2)[:ahead]
    if best:
        linked = {p[1:] for p in best}
        contexts = Counter()
        for w, n in words:
            stretch = []
            for x in w.encode():
                if stretch and (stretch[-1], x) not in linked:
                    contexts[tuple(stretch)] += n
                    stretch = []
                stretch.append(x)
            contexts[tuple(stretch)] += n
        found = S.learn([(list(w), n) for w, n in contexts.items()], best[-1], 0, 1000)
        assert found and found == brute_train(words, len(found))


def test_many_words_at_once_are_merged_like_one():
    merges = brute_train(corpus(9, 60), 60)
    words = [w for w, _ in corpus(9, 200)] + ["a", "", "aaaa"]
    encoder = S.Encoder(merges)
    symbols, owner = S.merge_ranked(*S._bytes(pa.array(words)), S.ranked(merges))
    assert [symbols[owner == k].tolist() for k in range(len(words))] == [encoder.lexeme(w) for w in words]
