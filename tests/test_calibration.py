"""The streamed calibration against the batch one."""

import os
import shutil

from pyspark.sql import functions as F

from codeweigh.operators import scoring
from codeweigh.streaming import calibration as C


def pairs(spark, lo, hi):
    text = F.concat(F.lit("x = "), F.repeat(F.lit("( a "), (F.col("id") % 5).cast("int")), F.lit("\n"))
    return spark.range(lo, hi).select("id", F.when(F.col("id") % 7 != 3, F.lit("p\n")).alias("prompt"), text.alias("output"))


def test_any_file_order_and_restarts_equal_batch(spark, tmp_path):
    want = scoring.calibrate(scoring.add_counts(pairs(spark, 0, 90))).first()
    parts = [(0, 10), (10, 55), (55, 60), (60, 90)]
    for name, order in (("a", [0, 1, 2, 3]), ("b", [3, 1, 0, 2])):
        src, checkpoint = str(tmp_path / name), str(tmp_path / f"ck-{name}")
        os.makedirs(src)
        for k, i in enumerate(order):
            pairs(spark, *parts[i]).coalesce(2).write.mode("append").parquet(src)
            if k != 1:  # two deliveries meet in one run
                C.calibrate_stream(spark, src, pairs(spark, 0, 1).schema, checkpoint, files_per_trigger=1)
            if k == 2:  # a copy of the checkpoint is all that is left of the first driver
                checkpoint = shutil.copytree(checkpoint, checkpoint + "-moved")
        assert C.read_calibration(spark, checkpoint).first() == want
    scored = scoring.score(scoring.apply_calibration(scoring.add_counts(pairs(spark, 0, 20)), C.read_calibration(spark, checkpoint)))
    assert scored.where("reward between 0 and 1").count() == 20


def test_no_pair_that_can_be_judged(spark, tmp_path):
    src, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    pairs(spark, 3, 4).write.parquet(src)
    C.calibrate_stream(spark, src, pairs(spark, 0, 1).schema, checkpoint)
    assert tuple(C.read_calibration(spark, checkpoint).first()) == (None, None, 0)
