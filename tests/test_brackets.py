"""Running depth and partners of brackets against a stack."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from codeweigh.functions.layout import match_brackets
from codeweigh.operators.tokens import bracket_rows


def by_stack(steps):
    """Depth after each bracket and its partner, one text."""
    depth, open_, out, partner = 0, [], [], [-1] * len(steps)
    for i, s in enumerate(steps):
        depth += s
        out.append(depth)
        if s > 0:
            open_.append(i)
        elif open_:
            j = open_.pop()
            partner[i], partner[j] = j, i
    return out, partner


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, -1]), max_size=40), max_size=6))
def test_partners_equal_a_stack(texts):
    step = np.array([s for t in texts for s in t], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    depth, partner = match_brackets(step, doc, len(texts))
    base, want_d, want_p = 0, [], []
    for t in texts:
        d, p = by_stack(t)
        want_d += d
        want_p += [x + base if x >= 0 else -1 for x in p]
        base += len(t)
    assert depth.tolist() == want_d and partner.tolist() == want_p


def test_rows(spark):
    deep = "(" * 100_000 + ")" * 100_000
    df = spark.createDataFrame([(1, "f(a[1], {'(': 2})"), (2, ")x("), (3, None), (4, ""), (5, "(]"), (6, deep), (7, "# (\n")], "id long, t string")
    rows = bracket_rows(df, "id", "t")
    got = {}
    for r in rows.where("id <> 6").collect():
        got.setdefault(r.id, []).append((r.pos, r.text, r.depth, r.match_pos, r.same_kind))
    assert got[1] == [(1, "(", 1, 14, True), (3, "[", 2, 5, True), (5, "]", 1, 3, True), (8, "{", 2, 13, True), (13, "}", 1, 8, True), (14, ")", 0, 1, True)]
    assert got[2] == [(0, ")", -1, None, None), (2, "(", 0, None, None)] and got[5] == [(0, "(", 1, 1, False), (1, "]", 0, 0, False)]
    assert set(got) == {1, 2, 5}
    assert rows.where("id = 6 and match_pos <> 199999 - pos").count() == 0 and rows.where("id = 6").count() == 200_000


def test_random_texts_equal_a_stack(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("()[]{} a") for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {}
    for x in bracket_rows(df, "id", "t").collect():
        got.setdefault(x.id, []).append((x.pos, x.depth, x.match_pos))
    for i, t in enumerate(texts):
        lexemes = [c for k, c in enumerate(t) if not (k and t[k - 1] == c and c in " a")]
        at = [k for k, c in enumerate(lexemes) if c in "()[]{}"]
        depth, partner = by_stack([1 if lexemes[k] in "([{" else -1 for k in at])
        assert sorted(got.get(i, [])) == [(k, d, at[p] if p >= 0 else None) for k, d, p in zip(at, depth, partner)]
