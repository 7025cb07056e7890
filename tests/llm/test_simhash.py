"""SimHash groups against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from codeweigh.llm import simhash as H
from codeweigh.llm.components import components
from codeweigh.llm.queries import QUERIES
from tests.llm.conftest import awkward, prose


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """Least member reachable over links of four bits or less, of each distinct fingerprint."""
    left, out = set(fps), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        out.update(dict.fromkeys(group, frozenset(group)))
    return out


def test_query_equals_brute_force(spark, tables):
    r = random.Random(1)
    docs = [d for d in awkward() if d[0] != 10]
    for i in range(60):
        w = prose(i, r.choice([3, 30, 200])).split()
        docs.append((100 + 4 * i, " ".join(w)))
        for k in (1, 2, 3):
            w[r.randrange(len(w))] = f"E{r.randrange(99)}"
            docs.append((100 + 4 * i + k, " ".join(w).upper() if k == 2 else "\n".join(w)))
    docs += [(None, prose(0, 200)), (None, docs[-1][1]), (None, "only here " * 30)]
    fps = {t: brute_fingerprint(t) for _, t in docs}
    groups = brute_groups(fps.values())
    least = {f: min((i for i, t in docs if fps[t] in g and i is not None), default=None) for f, g in groups.items()}
    got = QUERIES["op11_simhash_near_dedup"](spark, tables(documents=docs))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = [(i, f"{fps[t]:016x}", least[fps[t]]) for i, t in docs]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(len(g) > 1 for g in groups.values())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def crowded(seed):
    """Dense clusters, chains between them and strangers that share segments."""
    r = random.Random(seed)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(r.choice([3, 40, 150])):
            x = centre
            for b in r.sample(range(64), r.choice([1, 2, 3, 5])):
                x ^= 1 << b
            fps.add(x)
        for _ in range(30):  # a chain that walks away
            centre ^= 1 << r.randrange(64) | 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(centre)
    for _ in range(100):
        fps.add(r.getrandbits(64) & r.choice([0xFFFF, 0xFFFFFFFF0000, (1 << 64) - 1]))
    return fps


@pytest.mark.parametrize("k", range(3))
def test_every_layout_finds_all_links(spark, k):
    fps = crowded(k)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["component"] for r in components(H.links(df, H.LAYOUTS[k])).collect()}
    groups = {frozenset(map(signed, g)) for g in brute_groups(fps).values()}
    got = {}
    for x in map(signed, fps):
        got.setdefault(found.get(x, x), set()).add(x)
    assert {frozenset(g) for g in got.values()} == groups


def test_members_of_a_dense_bucket_do_not_meet_all(spark, monkeypatch):
    """Looked at as verified pairs: near the size of the cluster, not its square."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    assert H.links(df, H.LAYOUTS[0]).count() < 12 * len(fps)


def test_layouts_cover_the_distance():
    for segments in H.LAYOUTS:
        assert sum(w for w, _ in segments) == H.BITS
        assert sum(radius + 1 for _, radius in segments) > H.DISTANCE
    assert [H.layout(n) for n in (10, 10**5, 10**8, 10**11)] == [H.LAYOUTS[0], H.LAYOUTS[0], H.LAYOUTS[1], H.LAYOUTS[2]]


def test_hash_equals_the_engine_s_own(spark):
    t = "Été a b c"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] == signed(xxhash.xxh64_intdigest(t.encode(), H.SEED))
    long = prose(3, 200_000, 90)
    slices = list(H.shingle_hashes(long))
    assert len(slices) == 4 and sum(map(len, slices)) == 200_000 - 3
