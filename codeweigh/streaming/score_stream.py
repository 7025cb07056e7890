"""Score prompt/output files as they land (Structured Streaming).

Stateless: the calibration is fixed before the stream starts, so no
watermark or state store is needed; each micro-batch is scored exactly like
the batch job (same column expressions, same pandas UDF).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import reward as R
from ..operators.scoring import add_counts


def scored_stream(stream: DataFrame, avg_tokens: float, avg_errors: float) -> DataFrame:
    counts = add_counts(stream).drop("ns")
    return counts.withColumn("reward", R.reward("nt", "ne", F.lit(float(avg_tokens)),
                                                F.lit(float(avg_errors)), "prompt", "output"))


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                 checkpoint_dir: str, avg_tokens: float, avg_errors: float,
                 files_per_trigger: int | None = None):
    """Process every file now in ``source_dir`` (availableNow) and stop.

    Returns the finished ``StreamingQuery``; results are Parquet in ``sink_dir``.
    The checkpoint makes a restarted job resume where it stopped.
    ``files_per_trigger`` optionally caps the files per micro-batch (each
    micro-batch has a fixed cost of about a second; by default every landed
    file goes into the next one).
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (scored_stream(stream, avg_tokens, avg_errors).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    return q
