"""The computed permutation: one-to-one for every n, invertible, the same everywhere."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweigh.functions import permutation as M
from codeweigh.operators.prepare import computed_shuffle


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_bijection_for_every_n(n, seed):
    x = np.arange(n)
    out = M.places(x, n, seed)
    assert (np.sort(out) == x).all() and (M.places(out, n, seed, back=True) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, M.MOST), st.integers(0, 9))
def test_large_n_inverts(n, seed):
    x = np.unique(np.random.default_rng(seed).integers(0, n, 200))
    out = M.places(x, n, seed)
    assert out.min() >= 0 and out.max() < n and len(np.unique(out)) == len(x) and (M.places(out, n, seed, back=True) == x).all()


def test_looks_random():
    n = 100_000
    out = M.places(np.arange(n), n, 42)
    assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.02  # about 0.003 for a random order
    steps = np.diff(out)
    assert abs((steps > 0).mean() - 0.5) < 0.02 and len(np.unique(steps)) > 50_000
    assert (out == M.places(np.arange(n), n, 43)).mean() < 0.001
    # each tenth of the table is spread over all tenths
    spread = np.histogram2d(np.arange(n), out, 10)[0]
    assert spread.min() > 800 and spread.max() < 1200


def test_same_on_any_partitioning_and_without_a_shuffle(spark):
    one = {r["id"]: r["shuffle_pos"] for r in computed_shuffle(spark.range(0, 1000, 1, 1), "id", 1000, 7).collect()}
    many = computed_shuffle(spark.range(0, 1000, 1, 9), "id", 1000, 7)
    assert {r["id"]: r["shuffle_pos"] for r in many.collect()} == one and sorted(one.values()) == list(range(1000))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    nulls = spark.createDataFrame([(None,), (3,)], "id long").select(M.permuted("id", 10, 1).alias("x"), F.col("id"))
    assert {(r["id"] is None) == (r["x"] is None) for r in nulls.collect()} == {True}
    with pytest.raises(ValueError):
        M.permuted("id", 0, 1)
    with pytest.raises(Exception, match="positions must be"):
        computed_shuffle(spark.range(5), "id", 4, 1).collect()
