"""User-supplied functions (U2, U3): the vectorized slow path.

Both take plain pandas functions and run them on Arrow batches, so a user
function sees thousands of rows per call, never one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def custom_reward(df: DataFrame, fn: Callable[[pd.Series, pd.Series], pd.Series],
                  prompt: str = "prompt", output: str = "output",
                  return_type: T.DataType = T.DoubleType(), out: str = "reward") -> DataFrame:
    """``reward = fn(prompts, outputs)`` evaluated batch-wise."""
    udf = F.pandas_udf(fn, return_type)
    return df.withColumn(out, udf(F.col(prompt), F.col(output)))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``fn`` maps each batch of rows to new rows; input columns are dropped
    unless ``fn`` returns them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)
