"""Sources and sinks.

Readers are lazy: nothing is read until an action, and column pruning and
filters reach the Parquet scan.  CSV and JSON take an explicit schema when
one is known (schema inference is an extra pass over the data).
"""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_named(spark: SparkSession, root: str, name: str, config: str | None = None) -> DataFrame:
    """A named dataset (``root/name[/config].parquet``) or a catalog table."""
    if root is None:
        return spark.table(name if config is None else f"{name}_{config}")
    path = os.path.join(root, name if config is None else os.path.join(name, config))
    return spark.read.parquet(path if path.endswith(".parquet") else path + ".parquet")


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header; ``multi_line`` allows line breaks in quoted
    fields (then a file is one task)."""
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def scan_json(spark: SparkSession, path: str, schema: StructType | None = None,
              multi_line: bool = False) -> DataFrame:
    """S3: JSON lines (or one document per file with ``multi_line``)."""
    r = spark.read.option("multiLine", multi_line)
    return r.schema(schema).json(path) if schema is not None else r.json(path)


def scan_text(spark: SparkSession, path: str, keep_linebreaks: bool = True) -> DataFrame:
    """One row per line in column ``text``.

    The reader strips line breaks; when they are kept, ``\\n`` is appended
    again.  (A last line without a break is the one row that differs.)"""
    df = spark.read.text(path).withColumnRenamed("value", "text")
    return df.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else df


def scan_by_extension(spark: SparkSession, path: str, schema: StructType | None = None,
                      keep_linebreaks: bool = True) -> DataFrame:
    """Dispatch on each file's own extension (csv, json, txt, parquet)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return scan_csv(spark, path, schema)
    if ext in ("json", "jsonl"):
        return scan_json(spark, path, schema)
    if ext == "txt":
        return scan_text(spark, path, keep_linebreaks)
    if ext == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type {ext!r} for {path}")


def split_names(train: str | None, validation: str | None) -> list[str]:
    """Names of the splits that :func:`scan_train_validation` makes of these files."""
    return [name for name, path in (("train", train), ("validation", validation)) if path is not None]


def scan_train_validation(spark: SparkSession, train: str | None, validation: str | None,
                          schema: StructType | None = None, keep_linebreaks: bool = True,
                          file_order: bool = False) -> DataFrame:
    """Train and validation files become one frame with a ``split`` column
    (and, with ``file_order``, each row's place in its files)."""
    parts = []
    for split, path in (("train", train), ("validation", validation)):
        if path is not None:
            part = scan_by_extension(spark, path, schema, keep_linebreaks)
            part = with_file_order(part) if file_order else part
            parts.append(part.withColumn("split", F.lit(split)))
    if not parts:
        raise ValueError("need a train or a validation file")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


FILE_ORDER = "_at"


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``_at``: (file, block in the file, row as read), the stored order."""
    return df.withColumn(FILE_ORDER, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


# FIXED VALUES (grammar rewriting rule): ordered literal replacements.
GRAMMAR_REWRITES = [("!this.", "not self."), ("this.", "self.")]


def rewrite_lines(text, replacements=GRAMMAR_REWRITES):
    """Apply ordered plain-substring replacements to every line.

    None of the patterns spans a line break, so replacing in the whole text
    equals replacing line by line."""
    col = F.col(text) if isinstance(text, str) else text
    for old, new in replacements:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def rewrite_file(spark: SparkSession, src: str, dst: str, replacements=GRAMMAR_REWRITES) -> DataFrame:
    """S6 on files: writes the rewritten lines to ``dst``; ``src`` is untouched."""
    lines = spark.read.text(src)
    lines.select(rewrite_lines("value", replacements).alias("value")).write.mode("overwrite").text(dst)
    return spark.read.text(dst)


def _fingerprint(df: DataFrame, settings: dict) -> str:
    """Names the content of a frame and the settings it was made with."""
    cols = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    n, total = df.select(*[c.alias("h") for c in cols]).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return json.dumps({"rows": n, "hash": str(total), "columns": df.dtypes, "settings": settings}, sort_keys=True)


def write_tokenized(df: DataFrame, path: str, source: DataFrame, settings: dict, overwrite: bool = False) -> DataFrame:
    """Cache a tokenized table.  An existing one is reused only if it was
    finished and made from the same ``source`` rows with the same ``settings``
    (noted beside it after the write); else it is written anew."""
    spark, note = df.sparkSession, path.rstrip("/") + ".made-from"
    wanted = _fingerprint(source, settings)
    try:
        found = None if overwrite else spark.read.text(note).first()
    except AnalysisException:  # no such note
        found = None
    if found is None or found[0] != wanted:
        # an unfinished write must not keep an older note
        spark.createDataFrame([("unfinished",)], "value string").coalesce(1).write.mode("overwrite").text(note)
        df.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(note)
    return spark.read.schema(df.schema).parquet(path)
