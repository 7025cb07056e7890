"""The journalled reward log: retries, repeated epochs, rejected pairs."""

import os

import pytest
from pyspark.sql import functions as F

from codeweigh.operators import scoring
from codeweigh.sources import reward_log

SCORED = "prompt string, output string, reward double, batch_id long"


def scored(spark, n, reward=0.5):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("prompt"), F.lit("o").alias("output"), F.lit(reward).alias("reward"), F.floor(F.col("id") / 2).alias("batch_id"))


def test_a_shorter_retry_leaves_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    reward_log.write_reward_log(scored(spark, 3000), path, "1")
    reward_log.write_reward_log(scored(spark, 10), path, "2")
    got = reward_log.write_reward_log(scored(spark, 100, 0.25), path, "1")
    assert sorted((r["run"], r["count"]) for r in got.groupBy("run").count().collect()) == [("1", 100), ("2", 10)]
    assert got.where("run = '1' and reward <> 0.25").isEmpty() and got.where("sample = 'p7o'").count() == 2
    assert got.columns == ["prompt", "output", "reward", "batch_id", "sample", "run", "batch_range"]
    gone = reward_log.sweep(spark, path)
    assert len(gone) == 1 and reward_log.read(spark, path).count() == 110 and reward_log.sweep(spark, path) == []


def test_an_unfinished_attempt_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    reward_log.write_reward_log(scored(spark, 6), path, "a")

    def dies():
        raise RuntimeError("driver lost")

    monkeypatch.setattr(reward_log.time, "time_ns", dies)  # rows are written, the entry is not
    with pytest.raises(RuntimeError):
        reward_log.append(scored(spark, 50), path, "a")
    monkeypatch.undo()
    assert reward_log.read(spark, path).count() == 6
    with pytest.raises(ValueError, match="no finished write"):
        reward_log.read(spark, str(tmp_path / "nothing"))


def pairs(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.concat(F.lit("x = "), "id").alias("prompt"), F.when(F.col("id") != 7, F.lit("\ny = 1\n")).alias("output"))


def test_killed_and_repeated_epochs(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "log")
    pairs(spark, 0, 500).coalesce(1).write.parquet(src)
    schema = pairs(spark, 0, 1).schema
    first = str(tmp_path / "ck1")
    reward_log.log_stream(spark, src, schema, path, "s", first, 5.0, 2.0)
    # the driver is lost after the entry and before the stream's own commit: the epoch comes again
    commits = os.path.join(first, "commits")
    for name in os.listdir(commits):
        os.unlink(os.path.join(commits, name))
    pairs(spark, 500, 1000).coalesce(1).write.mode("append").parquet(src)
    reward_log.log_stream(spark, src, schema, path, "s", first, 5.0, 2.0)
    got = reward_log.read(spark, path)
    assert got.count() == got.select("id").distinct().count() == 999
    lost = reward_log.read_rejected(spark, path).collect()
    assert [(r["prompt"], r["reason"], r["run"]) for r in lost] == [("x = 7", "output is null", "s")]
    assert {r["epoch"] for r in got.select("epoch").distinct().collect()} == {0, 1}


def test_one_null_output_in_a_thousand_rows(spark):
    good, bad = scoring.score_or_reject(pairs(spark, 0, 1000), spread_by=["id"])
    assert good.where("reward between 0 and 1").count() == 999
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(7, "output is null")]
    with pytest.raises(Exception, match="output is null"):
        scoring.score_frame(pairs(spark, 0, 10), "prompt", "output", 5.0, 2.0).select("reward").collect()


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "log")
    pairs(spark, 0, 60).repartition(3).write.parquet(src)
    reward_log.log_stream(spark, src, pairs(spark, 0, 1).schema, path, "s", str(tmp_path / "ck"), 5.0, 2.0, files_per_trigger=1)
    got = reward_log.read(spark, path).select("id", "reward")
    want = scoring.score_frame(scoring.quarantine(pairs(spark, 0, 60))[0], "prompt", "output", 5.0, 2.0).select("id", "reward")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 59
