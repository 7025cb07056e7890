"""Ranked search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from codeweigh.llm import ranked_search as R
from codeweigh.llm.queries import QUERIES
from tests.llm.conftest import awkward, prose


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=50):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        rows = []
        asked = set(words(text))
        df = {t: sum(t in w for _, w in held) for t in asked}
        for i, w in held:
            m = 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in asked)
            if s > 0:
                rows.append((-s, i is None, i))
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:top]
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(rows, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark, tables):
    r = random.Random(3)
    docs = [d for d in awkward() if d[0] not in (10, 11)] + [(100 + i, prose(i, r.randint(1, 80), 60)) for i in range(300)]
    docs += [(600 + i, prose(5, 40, 60)) for i in range(70)] + [(None, prose(5, 40, 60)), (None, "w1-w2"), (700, "w7 " * 300)]
    items = [(i, prose(1000 + i, r.randint(1, 12), 60)) for i in range(20)] + [(20, prose(5, 40, 60)), (21, None), (22, " ,; "), (23, "nowhere"), (24, "W1 w1 É"), (24, "w2"), (None, "w3 w4")]
    assert got(QUERIES["op12_ranked_search"](spark, tables(documents=docs, benchmark=items))) == brute(docs, items)


def test_blocks_of_items_and_of_documents_change_nothing(spark, tables, monkeypatch):
    docs = [(i, prose(i, 30, 80)) for i in range(200)]
    items = [(i, prose(500 + i, 10, 80)) for i in range(30)]
    top = tables(documents=docs, benchmark=items)
    monkeypatch.setattr(R, "CELLS", 600)
    from codeweigh.llm.common import documents

    asked = documents(spark, top, "benchmark").filter("item_id < 6")  # one block each: read as so many parts
    assert got(R.search(documents(spark, top), asked.repartition(6), top=7)) == brute(docs, items[:6], 7)


def test_a_block_of_items_is_bounded(spark):
    text = " ".join(f"t{i:07}" for i in range(20_000))  # 160 kB of terms
    df = spark.createDataFrame([(i, text.replace("t", f"t{i}")) for i in range(4)], "item_id long, text string").coalesce(1)
    assert R.items_in_blocks(df).select("block").distinct().count() == 4


@pytest.mark.parametrize("leaves", [1, 4, 64])
def test_tree_skips_subtrees_and_loses_nothing(leaves, monkeypatch):
    monkeypatch.setattr(R, "LEAVES", leaves)
    r, width = np.random.default_rng(leaves), 40
    skipped = 0
    for k in range(40):
        n = int(r.integers(1, 600))
        dense = np.where(r.random((n, width)) < np.geomspace(0.8, 0.01, width), r.integers(1, 9, (n, width)), 0)
        dense[r.random(n) < 0.3] = dense[0]  # copies
        row, rank = np.nonzero(dense)
        m, ids = 50 + r.integers(0, 5, n) * 20, r.permutation(n)
        tree = R.Tree(row, rank, dense[row, rank], m, ids, width)
        columns = np.sort(r.choice(width, 12, replace=False))
        weight = r.integers(1, 5000, 12)
        best = R.Best(10)
        skipped += n - tree.search(columns, weight, best)
        all_ = R.score(weight, dense[:, columns], m)
        want = sorted((-s, i) for s, i in zip(all_.tolist(), ids.tolist()) if s > 0)[:10]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want
        # a node's maxima are those of its documents
        assert (tree.most[-1] == dense.max(0)).all() and tree.least_id[-1] == 0 and tree.least_m[-1] == m.min()
    assert skipped > 0
