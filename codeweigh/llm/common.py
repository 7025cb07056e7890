"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweigh.session import scratch_path

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: the
    lineage is cut, executors may be lost, and later readers prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column) -> Column:
    """True for the fifth of all rows that no classifier learns from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def share_of(key: Column, salt: str, fraction: float) -> Column:
    """A deterministic sample: the same rows whatever the partitioning."""
    return F.crc32(F.concat(key.cast("string"), F.lit(salt))) < F.lit(int(fraction * (1 << 32)))


_OWNER: list[str] = []


def claim(owner: str) -> None:
    """Called by a worker before it runs a kernel of module ``owner``.  Workers are
    shared by all jobs of an application; what the module before kept in memory
    (its ``forget`` drops it) is given back to the system first."""
    if _OWNER and _OWNER[0] != owner:
        forget = getattr(sys.modules.get(_OWNER[0]), "forget", None)
        if forget is not None:
            forget()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
    _OWNER[:] = [owner]


def map_rows(df: DataFrame, schema: str | StructType, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None],
             most: int = 4 << 20) -> DataFrame:
    """Apply ``kernel`` to every Arrow batch.  Batches are cut to about ``most``
    bytes first, so a kernel's working memory is bounded by
    the longest single text and not by the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(kernel.__module__)
        for batch in batches:
            for piece in slices(batch, most):
                out = kernel(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, good: Callable[[str | None], bool], name: str = "text") -> DataFrame:
    """Rows whose text is good, with all their columns."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([good(t) for t in batch.column(name).to_pylist()], pa.bool_()))

    kernel.__module__ = good.__module__  # whose memory it is
    return map_rows(df, df.schema, kernel)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, rows * most // max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
