"""Session helpers and error paths."""

import pytest
from pyspark.sql import functions as F

from codeweigh.operators import prepare, token_rows
from codeweigh.session import materialize, rebalance, shared_dir, table
from tests.conftest import SF


def test_shared_dir_from_session(spark):
    path = shared_dir(spark)
    assert path and path == spark.conf.get("spark.checkpoint.dir")


def test_rows_are_dealt_out_only_if_the_session_asks(spark):
    docs = table(spark, SF, "documents")
    assert "Exchange" in rebalance(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.codeweigh.spread", "false")
    try:
        assert rebalance(docs, "doc_id") is docs
    finally:
        spark.conf.set("spark.codeweigh.spread", "true")


def test_materialize_cuts_lineage_and_prunes(spark):
    m = materialize(spark.range(100).withColumn("x", F.col("id") * 2))
    plan = m.select("x")._jdf.queryExecution().executedPlan().toString()
    assert m.count() == 100 and "FileScan parquet" in plan and "ReadSchema: struct<x:bigint>" in plan


def test_error_paths(spark):
    with pytest.raises(ValueError):
        token_rows.max_input_length(512, 512)
    assert token_rows.max_input_length(1024, 512) == 512
    with pytest.raises(ValueError):
        prepare.resolve_text_column(spark.range(1), "missing")
