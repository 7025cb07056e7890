"""Reward reports (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reward_batch_stats(scored: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A3: per batch ``n, mean, std (sample), min, max`` of the reward."""
    r = F.col("reward")
    return scored.groupBy(batch_col).agg(
        F.count(r).alias("n"), F.round(F.avg(r), 6).alias("reward_mean"),
        F.round(F.stddev_samp(r), 6).alias("reward_std"),
        F.min(r).alias("reward_min"), F.max(r).alias("reward_max"))
