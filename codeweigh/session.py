"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def local_session(cores: int | str = "*", app: str = "codeweigh") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    scratch = tempfile.mkdtemp(prefix="codeweigh-")
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            # text stages after a shuffle are CPU-bound: keep AQE from merging
            # a small shuffle into fewer tasks than cores
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "16g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            # lexeme arrays of long texts are large: cap Arrow batches by bytes
            .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
            .config("spark.codeweigh.spread", "true")
            .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage.  Only a local
    session without it gets a private temporary folder (as in tests).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = os.path.join(tempfile.mkdtemp(prefix="codeweigh-"), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    The result survives the loss of executors, and later readers prune
    columns.  The caller removes the folder ``tables`` at the end of a run."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


SPREAD = "spark.codeweigh.spread"


def rebalance(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` before CPU-heavy text work, if the session asks
    for it (``spark.codeweigh.spread``; sized by AQE).

    Off by default: a scan of many files or row groups already yields enough
    tasks.  Local sessions, which read one small file, turn it on."""
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(*keys)
