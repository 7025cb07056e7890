"""A tokenized table that is kept up to date file by file.

``refresh`` compares the source's files with the manifest of the last finished
refresh and encodes only files whose rows are new.  Three looks, each
only at what the one before left open:

1. the list of files (path, length, time of change), without reading them;
2. of files whose entry differs: a digest of their rows (copied or touched files
   with equal rows are not encoded again);
3. of files whose rows differ: the encoding.

Encoded rows lie in ``parts/attempt=.../file=...``; ``manifest/version=...`` names for every source
file its digest and its part.  The digests form a tree (files, groups of
files, root); an equal root means that nothing changed.  A refresh writes its parts, then its
manifest, then one small journal file that makes the manifest the current one: a
driver lost on the way leaves the old table as it was.  The journal holds a digest of
the settings (vocabulary and all that the encoding depends on); other settings make all files new.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

_JOURNAL = "version string, written long, settings string, root string, schema string"
_MANIFEST = "path string, entry string, digest string, attempt string, file string"


@dataclass
class Refreshed:
    """The current table and what the refresh did."""

    table: DataFrame
    encoded: list[str]
    reused: int


def _files(spark: SparkSession, source: str) -> DataFrame:
    """(path, entry) of the source's Parquet files, from their listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source)
    return listed.select("path", F.md5(F.concat_ws("|", "length", F.col("modificationTime").cast("double")).cast("binary")).alias("entry"))


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of some files, with the file's path in ``_path``."""
    df = spark.read.parquet(*paths)
    return df.withColumn("_path", df.metadataColumn("_metadata")["file_path"])


def _current(spark: SparkSession, path: str):
    try:
        return spark.read.schema(_JOURNAL).parquet(os.path.join(path, "journal")).orderBy(F.desc("written")).first()
    except AnalysisException:  # nothing finished yet
        return None


def _manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(os.path.join(path, "manifest", f"version={version}"))


def tree_root(manifest: DataFrame) -> str | None:
    """Digest of digests: of the files of a group, then of the groups."""
    leaf = manifest.select(F.md5(F.concat_ws("|", "path", "digest").cast("binary")).alias("leaf"))
    level = lambda c: F.md5(F.array_join(F.sort_array(F.collect_list(c)), ",").cast("binary"))
    groups = leaf.groupBy(F.substring("leaf", 1, 2).alias("g")).agg(F.concat("g", level("leaf")).alias("node"))
    return groups.agg(level("node").alias("root")).first()["root"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last finished refresh."""
    now = _current(spark, path)
    if now is None:
        raise ValueError(f"no finished refresh in {path}")
    kinds = StructType.fromJson(json.loads(now["schema"]))
    live = _manifest(spark, path, now["version"]).select("attempt", "file")
    rows = spark.read.schema(StructType([*kinds, *StructType.fromDDL("attempt string, file string")])).parquet(os.path.join(path, "parts"))
    return rows.join(F.broadcast(live), ["attempt", "file"], "left_semi").select(*kinds.names)


def refresh(spark: SparkSession, source: str, path: str, encode: Callable[[DataFrame], DataFrame], settings: dict) -> Refreshed:
    """Bring the table at ``path`` up to the files in the folder ``source``.

    ``encode`` maps rows of the source to rows of the table and passes the column ``_path`` through."""
    wanted = json.dumps(settings, sort_keys=True)
    now = _current(spark, path)
    files = _files(spark, source)
    old = _manifest(spark, path, now["version"]) if now is not None and now["settings"] == wanted else spark.createDataFrame([], _MANIFEST)
    same = old.join(files, ["path", "entry"], "left_semi")
    changed = [r["path"] for r in files.join(same, "path", "left_anti").select("path").collect()]  # names only, of changed files
    encoded: list[str] = []
    manifest, schema = same, now and now["schema"]
    if changed:
        rows = _rows(spark, changed)
        columns = [F.col(f"`{c}`") for c in rows.columns if c != "_path"]
        sums = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))
        named = files.where(F.col("path").isin(*changed)).join(sums, F.col("path") == F.col("_path"), "left")
        digests = materialize(named.select("path", "entry", F.md5(F.concat_ws("|", F.coalesce("n", F.lit(0)), F.coalesce(F.col("h").cast("string"), F.lit(""))).cast("binary")).alias("digest")))  # a row for each file; the rows are read once
        touched = digests.join(old.select("path", "digest", "attempt", "file"), ["path", "digest"]).select(*_names())
        new = digests.join(touched, "path", "left_anti")
        attempt = uuid.uuid4().hex
        new = new.select("path", "entry", "digest", F.lit(attempt).alias("attempt"), F.md5(F.col("path").cast("binary")).alias("file"))
        encoded = sorted(r["path"] for r in new.select("path").collect())
        if encoded:
            out = encode(_rows(spark, encoded))
            schema = out.drop("_path").schema.json()
            parts = out.withColumn("attempt", F.lit(attempt)).withColumn("file", F.md5(F.col("_path").cast("binary"))).drop("_path")
            parts.write.mode("append").partitionBy("attempt", "file").parquet(os.path.join(path, "parts"))
        manifest = same.select(*_names()).unionByName(touched).unionByName(new)
    root = tree_root(manifest)
    if now is None or now["root"] != root or changed or now["settings"] != wanted:
        version = uuid.uuid4().hex
        manifest.write.parquet(os.path.join(path, "manifest", f"version={version}"))
        entry = spark.createDataFrame([(version, time.time_ns(), wanted, root, schema)], _JOURNAL)
        entry.coalesce(1).write.mode("append").parquet(os.path.join(path, "journal"))  # the switch
    return Refreshed(read(spark, path), encoded, files.count() - len(encoded))


def _names() -> list[str]:
    return [c.split()[0] for c in _MANIFEST.split(", ")]
