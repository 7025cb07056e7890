"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from codeweigh.llm import exact_dedup, near_dedup, substring_dedup
from codeweigh.llm import superminhash as S
from codeweigh.llm.components import components
from codeweigh.llm.queries import QUERIES
from codeweigh.llm.recompression import Names, anchors
from tests.llm.conftest import awkward, prose


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- exact


def exact_brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in docs:
        x = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, min(groups[x])[1], len(groups[x]), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out)


EXACT = ("doc_id", "keep_id", "group_size", "text_sha256")


def test_exact_awkward(spark, tables):
    docs = awkward()
    got = QUERIES["op8_exact_dedup"](spark, tables(documents=docs))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows(got, *EXACT) == exact_brute(docs)
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len({x[3] for x in exact_brute(docs)}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_full_bytes_decide_when_digests_collide(spark, tables):
    docs = [(i, prose(i % 7, 20)) for i in range(60)] + awkward()
    path = tables(documents=docs) + "/documents.parquet"
    assert rows(exact_dedup.deduplicate(spark, path, digest_chars=1), *EXACT) == exact_brute(docs)


def test_exact_state_goes_on_with_new_files(spark, tables, tmp_path):
    first, second = [(i, f"text {i % 3}") for i in range(20, 30)], [(i, f"text  {i % 4}") for i in range(10)]
    path, checkpoint = tables(documents=first) + "/documents.parquet", str(tmp_path / "state")
    exact_dedup.ingest(spark, path, checkpoint, max_bytes=1000)
    assert rows(exact_dedup.decide(spark, path, checkpoint), *EXACT) == exact_brute(first)
    more = tables(documents=second) + "/documents.parquet"
    spark.read.parquet(more).write.mode("append").parquet(path)
    exact_dedup.ingest(spark, path, checkpoint)
    assert rows(exact_dedup.decide(spark, path, checkpoint), *EXACT) == exact_brute(first + second)


def test_empty_tables(spark, tables):
    top = tables(documents=[], benchmark=[], labels=[], pages=[])
    for name, query in QUERIES.items():
        assert query(spark, top).collect() == [], name


def test_nulls_in_any_column(spark, tables):
    docs = [(None, prose(1, 80)), (None, None), (None, prose(2, 80)), (3, prose(1, 80)), (4, None), (5, prose(7, 60)), (None, prose(7, 60) + " x")]
    top = tables(documents=docs, benchmark=[(None, prose(7, 12)), (None, None), (1, None)], labels=[(None, None, None), (3, None, 1), (None, 1, 1)],
                 pages=[(None, None, None), (None, "u", "<p>text of a page"), (1, None, "")])
    for name, query in QUERIES.items():
        got = query(spark, top).collect()
        if not name.startswith("op12_"):  # rows per item
            assert len(got) == (3 if name.startswith("op7_") else len(docs)), name
    near = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in QUERIES["op4_near_dedup"](spark, top).collect()}
    assert near[3, 76] is True and all(k in (True, False) for k in near.values())
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.run(spark, top).collect()} <= {None, 3}


# ---------------------------------------------------------------- near


def near_brute(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(i), find(j)))
                up[v] = u
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


def edited(text, seed, k):
    r = random.Random(seed)
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_awkward(spark, tables):
    docs = awkward()
    assert rows(QUERIES["op4_near_dedup"](spark, tables(documents=docs)), *NEAR) == near_brute(docs)


@pytest.mark.parametrize("block", [500, 7])
def test_near_groups_beyond_a_block(spark, tables, monkeypatch, block):
    """A large group whose members often differ from its first, copies, and a chain."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base, docs = prose(5, 150), []
    docs += [(1000 + i, edited(base, i, 1 + i % 9)) for i in range(90)]
    docs += [(2000 + i, prose(9, 40)) for i in range(50)]
    docs += [(3000 + i, " ".join(prose(11, 400).split()[i * 8:i * 8 + 120])) for i in range(12)]
    docs += [(4000 + i, prose(100 + i, 60)) for i in range(40)]
    random.Random(3).shuffle(docs)
    assert rows(near_dedup.group_near(spark.read.parquet(tables(documents=docs) + "/documents.parquet")), *NEAR) == near_brute(docs)


def test_two_dense_parts_joined_by_one_pair_beyond_a_block(spark, monkeypatch):
    """The first's part and an odd part, of which only one pair is alike, in many families."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)

    def payload(*parts):
        return np.array(sorted(x for p in parts for x in p), np.uint64).tobytes()

    core, ours, theirs = range(70), range(100, 115), range(200, 215)
    members = []
    for family in range(20):
        ids = iter(range(family * 100, family * 100 + 100))
        members += [(family, next(ids), payload(core, ours)) for _ in range(12)] + [(family, next(ids), payload(core, ours[:10]))]
        odd = [payload(core, theirs) for _ in range(12)] + [payload(core, theirs[:10])]
        random.Random(family).shuffle(odd)
        members += [(family, next(ids), p) for p in odd]
    df = spark.createDataFrame([(f, i, bytearray(p)) for f, i, p in members], "family long, doc_id long, payload binary")
    found = near_dedup.UnionFind()
    for r in near_dedup.links(df, "family", near_dedup.exact, "two-parts").collect():
        found.union(r["a"], r["b"])
    assert [i for f, i, _ in members if found.find(i) != f * 100] == []


def test_signature_estimates_with_lower_variance():
    r, n = np.random.default_rng(0), 300
    for jaccard in (0.5, 0.75):
        common = int(2 * n * jaccard / (1 + jaccard))
        found = []
        for _ in range(200):
            x = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            s = S.signatures([x[:n], x[-n:]])
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - jaccard) < 0.02
        assert np.std(found) < (jaccard * (1 - jaccard) / S.SLOTS) ** 0.5


def test_signature_of_a_batch_equals_single():
    sets = [S.shingles(prose(i, 3 + 40 * i)) for i in range(8)]
    assert all((S.signatures([s])[0] == row).all() for s, row in zip(sets, S.signatures(sets)))


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(50)] + [(9, 9)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    expected = sorted((x, find(x)) for x in {x for a, b in edges if a != b for x in (a, b)})
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert rows(components(df), "node", "component") == expected
    assert components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- substring


def substring_brute(docs):
    n = substring_dedup.WINDOW
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for p in range(len(w) - n + 1):
            g = tuple(w[p:p + n])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - n + 1) if first[tuple(w[p:p + n])] < i for q in range(p, p + n)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_awkward(spark, tables):
    docs = awkward()
    assert rows(QUERIES["op2_substring_dedup"](spark, tables(documents=docs)), *SUB) == substring_brute(docs)


def test_substring_passages_runs_and_periods(spark, tables):
    r, docs = random.Random(4), []
    passages = [prose(50 + k, 49 + k) for k in range(6)] + ["z " * 80, "p q " * 60, "p q r s t " * 25]
    for i in range(120):
        parts = [prose(1000 + i * 7 + k, r.randrange(0, 70), 30) for k in range(3)]
        for p in r.sample(passages, 2):
            parts.insert(r.randrange(len(parts) + 1), p)
        docs.append((r.randrange(10**6), " ".join(parts)))
    docs += [(i + 1, t) for i, t in docs[:15]]
    docs = list(dict(docs).items())
    assert rows(QUERIES["op2_substring_dedup"](spark, tables(documents=docs)), *SUB) == substring_brute(docs)


def test_equal_windows_have_equal_anchors_inside_them():
    r = np.random.default_rng(3)
    for vocabulary in (2, 3, 20, 10**6):
        common = r.integers(0, vocabulary, 90).astype(np.uint64)
        one, two = (np.concatenate([r.integers(0, vocabulary, k).astype(np.uint64), common, r.integers(0, vocabulary, 40).astype(np.uint64)]) for k in (13, 37))
        a, b = (anchors(x, np.arange(k, k + 41), 50) for x, k in ((one, 13), (two, 37)))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (a[2] - 13 == b[2] - 37).all()
        assert (a[2] >= np.arange(13, 54)).all() and (a[2] < np.arange(13, 54) + 50).all()


def test_range_names():
    w = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    names, seen = Names(w), {}
    for size in (1, 3, 50):
        for p, h in enumerate(names(np.arange(400 - size), size).tolist()):
            assert seen.setdefault(h, tuple(w[p:p + size])) == tuple(w[p:p + size])
    assert len(seen) == len({tuple(w[p:p + s]) for s in (1, 3, 50) for p in range(400 - s)})
