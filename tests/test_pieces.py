"""The fold in pieces: the same results as over a whole batch, in bounded memory."""

import tracemalloc

import pyarrow as pa
import pytest

from codeweigh.functions import adjacency, layout

TEXTS = [["if", " ", "x", ":", "\n    ", "y", " ", "$", "\n", "z"], None, [], ["(", "[", ")", "$", "§", "]"], ["a", " ", "b"], ["def", " ", "f", "(", ")", ":", "\n\t", "pass"]]
LISTS = pa.list_(pa.string())


def _udfs():
    return [layout.profile_udf, layout.roles_udf, layout.brackets_udf, adjacency.pairs_udf]


def _rows(batches) -> list[dict]:
    return [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("most", [1, 3, 11])
def test_pieces_give_what_the_whole_batch_gives(monkeypatch, most):
    lex = pa.array([["cut", "off"], *TEXTS * 3], LISTS).slice(1)
    keyed = [pa.RecordBatch.from_arrays([pa.array(range(len(lex))), lex], names=["key", "lexemes"])]
    only = [pa.RecordBatch.from_arrays([lex], names=["lexemes"])]

    def results():
        named = {r["name"]: r["n"] for r in _rows(layout.histogram_batches(only))}
        unknown: dict = {}
        for r in _rows(layout.unknown_batches(only)):
            unknown[r["ch"]] = unknown.get(r["ch"], 0) + r["n"]
        return [u.func(lex).to_pylist() for u in _udfs()], named, unknown, _rows(layout.token_batches(keyed))

    whole = results()
    monkeypatch.setattr(layout, "MOST_LEXEMES", most)
    assert results() == whole
    assert whole[2] == {"$": 6, "§": 3}
    tokens = [r for r in whole[3] if r["key"] == 0]
    assert [r["text"] for r in tokens if r["sub"] == 0 and r["pos"] < 10] == TEXTS[0]


def test_empty_batches_have_empty_results():
    lex = pa.array([], LISTS)
    assert all(len(u.func(lex)) == 0 for u in _udfs())


def test_memory_of_a_fold_does_not_grow_with_the_batch():
    def peak(texts: int) -> int:
        lex = pa.array([["x", " ", "=", " ", "(", "y", ")", "\n    "] * 50] * texts, LISTS)
        tracemalloc.start()
        for u in (layout.profile_udf, adjacency.pairs_udf):
            u.func(lex)
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    assert peak(4000) < 2 * peak(500)


def test_memory_of_the_histogram_does_not_grow_with_the_batch():
    def peak(texts: int) -> int:
        lex = pa.array([["x", " ", "=", " ", "(", "y", ")", "\n    "] * 50] * texts, LISTS)
        tracemalloc.start()
        counts = _rows(layout.histogram_batches([pa.RecordBatch.from_arrays([lex], names=["lexemes"])]))
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {r["name"]: r["n"] for r in counts}["NAME"] == 100 * texts
        return out

    assert peak(4000) < 2 * peak(500)
