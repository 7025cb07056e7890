"""Periodic runs against brute force."""

import hashlib
import random
import re
from binascii import crc32

import numpy as np
import pytest

from codeweigh.llm import periodic_runs as P
from codeweigh.llm.queries import QUERIES
from tests.llm.conftest import awkward, prose


def brute_runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the least period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def knotty(r, most=250):
    """Words with runs of every size, nested and next to one another."""
    w = []
    while len(w) < r.randint(0, most):
        if r.random() < 0.4:
            w += [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randint(1, 20))]
        else:
            part = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, r.choice([3, 9, 30])))]
            if r.random() < 0.3:
                part = part * r.randint(1, 5) + [r.randrange(3)]
            w += (part * r.randint(2, 9))[:r.randint(1, most)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(250):
        docs = [knotty(r) for _ in range(r.randint(1, 7))]
        got = [runs for runs, _ in P.per_text(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]))]
        assert got == [brute_runs(d) for d in docs]


def test_positions_depend_on_their_context_only():
    r = random.Random(5)
    w = np.array(([r.randrange(4) for _ in range(300)]) * 2, np.uint64)
    content, room = P._mix(w + P._PRIME), len(w) - np.arange(len(w))
    for tau in (1, 2, 4, 8, 16):
        chosen = P.synchronising(content, room, tau, np.zeros(len(w), bool))
        assert (chosen[:300 - 2 * tau] == chosen[300:600 - 2 * tau]).all()
        assert all(chosen[i:i + tau].any() for i in range(600 - 3 * tau))
        content = P._mix(content * P._PRIME + P._later(content, tau, P._TOP))


def test_long_and_repeating_texts():
    n = 400_000
    assert P.batch_runs(np.tile(np.arange(7), n // 7), np.array([n // 7 * 7])) == [(0, n // 7 * 7, 7)]
    one, two = [0], [0, 1]
    while len(two) < n:
        one, two = two, two + one
    assert P.batch_runs(np.array(two), np.array([len(two)])) == []  # the golden word has no fourth powers


def test_query_equals_brute_force(spark, tables):
    r = random.Random(9)
    docs = [d for d in {i: (i, t) for i, t in awkward() if i not in (10, 11)}.values()]
    docs += [(100 + i, " ".join(f"w{x}" for x in knotty(r, 120))) for i in range(150)] + [(400 + i, prose(i, 60)) for i in range(60)]
    docs += [(6, docs[3][1])]  # a repeated row
    got = sorted(tuple(x) for x in QUERIES["op13_periodic_runs"](spark, tables(documents=docs)).collect())
    assert got == sorted(brute_row(*d) for d in docs)
    assert any(x[1] for x in got)


def test_detect_gives_runs_and_the_text_left(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b a y\tz"), (2, None), (None, "q q q q q q")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in P.detect(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 9, 2)] and got[1]["collapsed"] == "x a b y z"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["start"] is None
    assert got[None]["collapsed"] == "q" and got[None]["exponent_milli"] == 6000
