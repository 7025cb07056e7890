"""Registered queries against the DuckDB oracle, and the stream against batch."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from codeweigh.plans.oracle import ORACLE
from codeweigh.session import TABLES
from tests.conftest import SF, SF01

KEYS = sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_every_query_has_sql():
    from codeweigh.plans.catalog import QUERIES

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


def test_visible_rows_of_the_token_table_are_its_tokens(spark):
    table = E.queries()["python_token_table"](spark, SF).where("not hidden").groupBy("doc_id").count()
    tokens = E.queries()["python_token_count"](spark, SF)
    assert tokens.join(table, "doc_id", "left").where("tokens <> coalesce(count, 0)").count() == 0
    names = E.queries()["python_token_table"](spark, SF).where("sub > 0").select("name").distinct()
    assert {r.name for r in names.collect()} == {"INDENT", "DEDENT"}


def test_stream_equals_batch(spark):
    s = E.queries()["score_stream"](spark, SF)
    b = E.queries()["reward"](spark, SF).select("conv_id", "turn", "nt", "ne", "reward")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"conv_id", "turn", "prompt", "output", "nt", "ne", "reward"} <= set(df.columns)
    assert df.where((F.col("reward") < 0) | (F.col("reward") > 1)).count() == 0


def test_incremental_micro_batches_equal_batch(spark):
    """Three one-file micro-batches give exactly the batch scores."""
    from codeweigh.operators import scoring
    from codeweigh.plans import catalog as C
    from codeweigh.session import scratch_path
    from codeweigh.streaming.score_stream import score_stream
    pairs = C._pairs(spark, SF)
    cal = scoring.calibrate(scoring.add_counts(pairs)).first()
    src, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    pairs.repartition(3).write.parquet(src)
    q = score_stream(spark, src, pairs.schema, sink, scratch_path(spark, "ck"), cal["avg_tokens"],
                     cal["avg_errors"], files_per_trigger=1)
    assert len(q.recentProgress) >= 3
    s = spark.read.parquet(sink).select("conv_id", "turn", "reward")
    b = E.queries()["reward"](spark, SF).select("conv_id", "turn", "reward")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_pairs_are_lexed_in_many_tasks(spark):
    """A join of two small sides must not leave all lexing to one task."""
    from codeweigh.operators import scoring
    from codeweigh.plans import catalog as C

    for frame in (C._counts(spark, SF01), scoring.score_frame(C._pairs(spark, SF01), "prompt", "output", 200.0, 50.0, spread_by=C.PAIR_KEYS)):
        sizes = frame.select(F.spark_partition_id().alias("p"), "nt").groupBy("p").agg(F.sum("nt")).collect()
        assert len(sizes) > 1
    big = C._pairs(spark, SF01).withColumn("output", F.repeat("output", 40))
    tasks = scoring.add_counts(big, spread_by=C.PAIR_KEYS).select(F.spark_partition_id().alias("p"), "nt").groupBy("p").agg(F.count("nt")).collect()
    assert len(tasks) > 3 and max(r[1] for r in tasks) < 0.4 * sum(r[1] for r in tasks)
