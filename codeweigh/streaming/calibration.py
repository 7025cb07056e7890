"""A1 over arriving files: the calibration as lasting state of a stream.

Each micro-batch adds (tokens, errors, pairs) of its files to one row of a state store;
the sums are partial per task before they meet.  Sums merge in any order, so
the result is that of one batch job over all files, whatever their order and
however often the stream is stopped and started.  The state is read back as
the calibration table that :func:`codeweigh.operators.scoring.apply_calibration` takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import add_counts, calibrate_sums


def calibrate_stream(spark: SparkSession, source_dir: str, schema: StructType, checkpoint_dir: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Take up every file that landed in ``source_dir`` since the last call, then stop."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    counts = add_counts(reader.parquet(source_dir)).where(F.col("nt").isNotNull() & F.col("ne").isNotNull())
    sums = counts.groupBy(F.lit("all").alias("scope")).agg(F.sum(F.col("nt").cast("long")), F.sum(F.col("ne").cast("long")), F.count(F.lit(1)))
    query = sums.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_calibration(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """``avg_tokens, avg_errors, n`` of all files taken up so far (null averages if none held a pair)."""
    state = spark.read.format("statestore").load(checkpoint_dir)
    sums = state.select(F.col("value").cast("struct<nt: bigint, ne: bigint, n: bigint>").alias("v")).select("v.*")
    return calibrate_sums(sums)
