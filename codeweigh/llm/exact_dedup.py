"""Exact deduplication as a stateful stream.

``ingest`` runs a Structured Streaming query over the files of a table
(``availableNow``: everything there now; later calls with the same checkpoint
read only new files).  Its keyed state lives in RocksDB on the executors'
disks, is checkpointed to the shared folder, and never expires.  Per SHA-256
digest of the normalised text it retains the group's size and the row that
stays: its code-point count, stable identifier (``doc_id``) and content
locator (file and row in it).  Rows meet in partial aggregates before the
shuffle, so a digest that a third of all rows share costs one row per task.

``decide`` reads the state back as a table and gives every document its
verdict.  Full bytes are checked on every hit: the rows of all digests with
more than one member are grouped by their whole normalised text, and where
one digest covers different texts, those are regrouped by the text itself.

Normalised text: the text without the characters ``[\\x20\\x09-\\x0D]``.  Of
equal texts the row with the most code points, then the smallest ``doc_id``,
then the smallest locator stays; exactly one row of a group is ``kept``, also
if rows repeat; a missing ``doc_id`` is the smallest.  Null counts as empty, so all null, empty and blank texts are
one group.  An empty table gives an empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import BLANKS, documents, written
from codeweigh.session import scratch_path

#: State on disk; no space reserved ahead, since many partitions hold little each.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _rows(df: DataFrame, digest_chars: int) -> DataFrame:
    """(doc_id, digest, sha, rank, norm, whole): ``rank`` orders a group, the
    smallest stays; ``whole`` has all columns (pruned where nobody asks)."""
    norm = normalised(F.col("text"))
    file = df.metadataColumn("_metadata")  # not a column of the table that has this name
    place = F.struct(file["file_path"].alias("file"), file["file_block_start"].alias("block"), file["row_index"].alias("row"))
    rank = F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("minus_points"), F.col("doc_id"), place.alias("place"))
    sha = F.sha2(norm.cast("binary"), 256)
    return df.select("doc_id", F.substring(sha, 1, digest_chars).alias("digest"), sha.alias("sha"), rank.alias("rank"), norm.alias("norm"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))


def ingest(spark: SparkSession, path: str, checkpoint: str, digest_chars: int = 64, max_bytes: int | None = None) -> None:
    """Bring the state at ``checkpoint`` up to date with the files at ``path``."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        read = spark.readStream.schema(spark.read.parquet(path).schema)
        # a pattern, since a stream's plain path must be a folder and a table may be one file
        folder, name = os.path.split(path.rstrip("/"))
        stream = (read.option("maxBytesPerTrigger", max_bytes) if max_bytes else read).parquet(f"{folder}/{{{name}}}")
        state = _rows(stream, digest_chars).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
        query = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, group_size, best) from the keyed state."""
    raw = spark.read.format("statestore").load(checkpoint)
    values = raw.schema["value"].dataType.names
    return raw.select(F.col("key.digest").alias("digest"), F.col("value")[values[0]].alias("group_size"), F.col("value")[values[1]].alias("best"))


def decide(spark: SparkSession, path: str, checkpoint: str, digest_chars: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, whole) per row at ``path``."""
    rows = _rows(spark.read.parquet(path), digest_chars)
    state = state_table(spark, checkpoint)
    many = state.filter("group_size > 1").select("digest")
    # full bytes: one group per digest unless different texts share it
    exact = rows.join(many, "digest", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))
    clash = exact.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    clash = written(clash, "dedup-clashes")
    plain = rows.join(state, "digest").select("doc_id", "digest", "sha", "rank", "group_size", "best", "whole")
    if not clash.isEmpty():
        # the text itself decides: group and verdict come from the rows with that very text
        regroup = rows.join(clash, "digest", "left_semi").groupBy("digest", "sha", "norm").agg(
            F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("best"))
        plain = plain.join(clash, "digest", "left_anti").unionByName(
            rows.join(regroup, ["digest", "sha", "norm"]).select("doc_id", "digest", "sha", "rank", "group_size", "best", "whole"))
    return plain.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"),
                        F.col("sha").alias("text_sha256"), "whole")


def deduplicate(spark: SparkSession, path: str, digest_chars: int = 64) -> DataFrame:
    checkpoint = scratch_path(spark, "dedup-state")
    ingest(spark, path, checkpoint, digest_chars)
    return decide(spark, path, checkpoint, digest_chars)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``."""
    path = scratch_path(docs.sparkSession, "dedup-input")
    docs.write.parquet(path)
    return deduplicate(docs.sparkSession, path).filter("kept").select("whole.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, os.path.join(sf_dir, "documents.parquet")).drop("whole")


_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"
ORACLE = f"""
with n as (select doc_id, {_NORM} x, length(coalesce(text, '')) c from documents),
g as (select doc_id, x, first_value(doc_id) over (partition by x order by c desc, doc_id) keep_id, count(*) over (partition by x) group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(x) text_sha256 from g
"""
