"""Decay, clamp, reward edge cases and properties (FIXTURES 2.3, 2.4, 2.6)."""

import pytest
from pyspark.sql import functions as F

from codeweigh.functions import reward as R
from codeweigh.operators import scoring

A = [0.00001, 0.05, 0.5, 0.9, 0.99, 0.999, 0.99999]
X = [0.0, 0.02, 0.1, 0.25, 0.5, 0.9, 1.0, 2.0]
DECAY = [
    [1, 1e-10, 1e-50, 0, 0, 0, 0, 0],
    [1, 0.0025, 9.76562e-14, 0, 0, 0, 0, 0],
    [1, 0.25, 0.000976562, 2.98023e-8, 0, 0, 0, 0],
    [1, 0.809995, 0.348661, 0.0717651, 0.00512735, 0.0000496173, 0, 0],
    [1, 0.96861, 0.849175, 0.649543, 0.376949, 0.0610435, 0, 0],
    [1, 0.979004, 0.895438, 0.740544, 0.487496, 0.0955581, 0, 0],
    [1, 0.97999, 0.899955, 0.749906, 0.499875, 0.099955, 0, 0],
]


def test_decay_table(spark):
    rows = [(a, x) for a in A for x in X]
    df = spark.createDataFrame(rows, "a double, x double")
    got = df.select(R.clamp(R.exponential_decay("x", "a"), 0.0, 1.0).alias("d")).collect()
    for (a, x), r in zip(rows, got):
        exp = DECAY[A.index(a)][X.index(x)]
        assert r.d == pytest.approx(exp, rel=1e-5, abs=1e-6), (a, x)


def _score(spark, rows, avg_tokens=10.0, avg_errors=2.0):
    df = spark.createDataFrame(rows, "prompt string, output string, nt int, ne int")
    return df.select(R.reward("nt", "ne", F.lit(avg_tokens), F.lit(avg_errors), "prompt", "output")
                     .alias("r")).collect()


def test_reward_edges(spark):
    got = _score(spark, [("x = 1\n", "", 0, 0), ("a", "b", 5, 2), ("a", "b", 5, 7), (None, "x", 1, None)])
    assert [r.r for r in got] == [1.0, 0.0, 0.0, 0.0]


def test_null_output_is_rejected(spark):
    with pytest.raises(Exception, match="output is null"):
        _score(spark, [("a", None, 1, 1)])


def test_missing_calibration_is_rejected(spark):
    df = spark.createDataFrame([("a", "b", 1, 1)], "prompt string, output string, nt int, ne int")
    with pytest.raises(Exception, match="calibration missing"):
        df.select(R.reward("nt", "ne", F.lit(None).cast("double"), F.lit(2.0), "prompt", "output")).collect()


def test_reward_bounded_and_monotone(spark):
    rows = [("p", "o", nt, ne) for nt in range(0, 40, 3) for ne in range(0, 6)]
    got = [r.r for r in _score(spark, rows)]
    assert all(0.0 <= g <= 1.0 for g in got)
    by_nt = {}
    for (_, _, nt, ne), g in zip(rows, got):
        by_nt.setdefault(nt, []).append((ne, g))
    for seq in by_nt.values():
        vals = [g for _, g in sorted(seq)]
        assert all(b <= a for a, b in zip(vals, vals[1:]))


@pytest.mark.parametrize("nt,ne,avg_t,avg_e", [([7], [1], 7, 1), ([0, 0], [0, 0], 1, 1), ([10, 20], [3, 0], 15, 1.5)])
def test_calibration(spark, nt, ne, avg_t, avg_e):
    df = spark.createDataFrame(list(zip(nt, ne)), "nt int, ne int")
    r = scoring.calibrate(df).first()
    assert (r.avg_tokens, r.avg_errors, r.n) == (avg_t, avg_e, len(nt))


def test_keyword_count(spark):
    df = spark.createDataFrame([("cats and cats.* catscats",)], "s string")
    assert df.select(R.keyword_count("s", "cats").alias("n")).first().n == 4
    assert df.select(R.keyword_count("s", ".*").alias("n")).first().n == 1


def test_empty_calibration_is_null(spark):
    df = spark.createDataFrame([], "nt int, ne int")
    r = scoring.calibrate(df).first()
    assert (r.avg_tokens, r.avg_errors, r.n) == (None, None, 0)


def test_calibration_skips_pairs_that_cannot_be_judged(spark):
    from codeweigh.operators import scoring

    df = spark.createDataFrame([(10, 4, 1), (None, None, None)], "nt int, ne int, ns int")
    got = scoring.calibrate(df).first()
    assert (got.avg_tokens, got.avg_errors, got.n) == (10.0, 4.0, 1)
    assert scoring.calibrate_statements(df).first().n == 1


def test_output_alone(spark):
    from codeweigh.operators import scoring

    df = spark.createDataFrame([(None, "x = 1\n"), ("f(", "y = )\n")], "prompt string, output string")
    got = {r.output: r for r in scoring.score_pairs(df, errors_of="output").collect()}
    assert got["x = 1\n"].reward == 1.0 and got["x = 1\n"].ne == 0 and got["y = )\n"].ne > 0
