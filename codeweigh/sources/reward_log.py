"""The reward log, written by batch jobs and by streams.

A log is a folder of tables: ``rows`` (Parquet, partitioned by ``attempt`` and
``batch_range``) and ``journal`` (one row for each finished attempt: run, epoch, attempt,
when).  A write puts its rows into a folder of its own attempt first; then one
small file, which appears as a whole or not at all, enters the attempt in the journal.
Readers use, of each (run, epoch), the attempt entered last, and nothing else.  So

* a write that dies leaves rows that nobody reads, and the older attempt stays;
* writing a run again replaces all its rows, also where the new attempt is shorter;
* an epoch of a stream that is repeated after a failure is recognised by its
  entry and skipped, so rows are neither lost nor doubled.

A run is one batch job (epoch -1) or one stream (its epochs); one writer
at a time per run, any number of runs.  :func:`sweep` removes rows of attempts that count no more.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import quarantine
from ..streaming.score_stream import scored_stream

WHOLE_RUN = -1
_JOURNAL = "run string, epoch long, attempt string, written long, schema string"


def _journal(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_JOURNAL).parquet(os.path.join(path, "journal"))
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], _JOURNAL)


def live_attempts(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, attempt, schema): the attempt that counts of each run and epoch."""
    last = Window.partitionBy("run", "epoch").orderBy(F.desc("written"), F.desc("attempt"))
    return _journal(spark, path).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "written")


def append(scored: DataFrame, path: str, run: str, epoch: int = WHOLE_RUN, batches_per_range: int = 1024, rejected: DataFrame | None = None) -> str:
    """Write one attempt (and its ``rejected`` pairs) and enter it; gives its name."""
    spark, attempt = scored.sparkSession, uuid.uuid4().hex
    out = scored.withColumn("sample", F.concat("prompt", "output")).withColumn("run", F.lit(run)).withColumn("epoch", F.lit(epoch).cast("long"))
    out = out.withColumn("batch_range", F.floor(F.col("batch_id") / F.lit(batches_per_range)))
    out.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", "batch_range").parquet(os.path.join(path, "rows"))
    if rejected is not None:
        lost = rejected.select("prompt", "output", "reason", F.lit(run).alias("run"), F.lit(epoch).cast("long").alias("epoch"), F.lit(attempt).alias("attempt"))
        lost.write.mode("append").partitionBy("attempt").parquet(os.path.join(path, "rejected"))
    entry = spark.createDataFrame([(run, epoch, attempt, time.time_ns(), out.schema.json())], _JOURNAL)
    entry.coalesce(1).write.mode("append").parquet(os.path.join(path, "journal"))
    return attempt


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows that count.  The attempts that count are joined on the partition column, so folders of others are not read."""
    live = live_attempts(spark, path)
    first = live.select("schema").first()
    if first is None:
        raise ValueError(f"no finished write in {path}")
    kinds = StructType.fromJson(json.loads(first["schema"]))
    rows = spark.read.schema(kinds.add("attempt", "string")).parquet(os.path.join(path, "rows"))
    return rows.join(F.broadcast(live.select("attempt")), "attempt", "left_semi").select(*[f.name for f in kinds if f.name != "attempt"])


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, output, reason, run, epoch) of the rejected pairs that count."""
    kinds = "prompt string, output string, reason string, run string, epoch long, attempt string"
    try:
        rows = spark.read.schema(kinds).parquet(os.path.join(path, "rejected"))
    except AnalysisException:  # none so far
        rows = spark.createDataFrame([], kinds)
    return rows.join(F.broadcast(live_attempts(spark, path).select("attempt")), "attempt", "left_semi").drop("attempt")


def write_reward_log(scored: DataFrame, path: str, run: str, batches_per_range: int = 1024) -> DataFrame:
    """Log query, response, sample and reward per batch.  Writing a ``run`` again (a
    retry) replaces all its rows, other runs stay."""
    append(scored, path, run, batches_per_range=batches_per_range)
    return read(scored.sparkSession, path).drop("epoch")


def log_batch(path: str, run: str, avg_tokens: float, avg_errors: float):
    """A ``foreachBatch`` function that scores and logs each micro-batch of pairs once; its
    number is the ``batch_id``.  Pairs that cannot be judged are rejected, the others scored."""

    def sink(batch: DataFrame, epoch: int) -> None:
        done = _journal(batch.sparkSession, path).where((F.col("run") == run) & (F.col("epoch") == epoch))
        if done.isEmpty():
            good, bad = quarantine(batch)
            scored = scored_stream(good, avg_tokens, avg_errors).withColumn("batch_id", F.lit(epoch).cast("long"))
            append(scored, path, run, epoch, rejected=bad)

    return sink


def log_stream(spark: SparkSession, source_dir: str, schema: StructType, path: str, run: str, checkpoint_dir: str, avg_tokens: float,
               avg_errors: float, files_per_trigger: int | None = None) -> StreamingQuery:
    """Score pairs as their files land and log each micro-batch; runs over what is there, then stops."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = reader.parquet(source_dir).writeStream.foreachBatch(log_batch(path, run, avg_tokens, avg_errors)).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove the rows of attempts that count no more (replaced or never finished); gives their
    names.  Not while a writer is at work."""
    live = {r["attempt"] for r in live_attempts(spark, path).select("attempt").collect()}
    gone = set()
    for table in ("rows", "rejected"):
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, table))
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(top) if fs.exists(top) else ():
            name = status.getPath().getName()
            if name.startswith("attempt=") and name.removeprefix("attempt=") not in live:
                fs.delete(status.getPath(), True)
                gone.add(name.removeprefix("attempt="))
    return sorted(gone)
