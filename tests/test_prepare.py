"""Splits, positions, batches, slices, sources (FIXTURES 2.5, 2.7)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeweigh.operators import prepare, token_rows
from codeweigh.sources import readers, reward_log


@pytest.mark.parametrize("n,expected", [(100, 5), (10, 0), (30, 2), (50, 2)])
def test_split_rounding(spark, n, expected):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = prepare.split_head_percent(df, ["k"], 5)
    assert s.where("split = 'validation'").count() == expected
    assert s.count() == n
    val = [r.k for r in s.where("split = 'validation'").collect()]
    assert sorted(val) == list(range(expected))


def test_positions_match_row_number(spark):
    df = spark.range(0, 3000, 7).withColumn("k", F.col("id") * 13 % 3001).select("k").distinct()
    idx = prepare.positional_index(df, ["k"], num_partitions=5)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k")) - 1)
    bad = idx.join(ref, "k").where(F.col("pos") != F.col("rn")).count()
    assert bad == 0 and idx.count() == df.count()


def test_hash_split_is_stable_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = prepare.split_hash_percent(df, "k", 5).repartition(3)
    b = prepare.split_hash_percent(df.repartition(7), "k", 5)
    assert a.exceptAll(b).count() == 0
    v = a.where("split = 'validation'").count()
    assert 40 < v < 170


def test_batches(spark):
    df = spark.range(10).selectExpr("id as k", "array(cast(id as int)) as input_ids")
    rows = prepare.batch_rows(df, ["k"], 4)
    got = prepare.collate_batches(rows).orderBy("batch_id").collect()
    assert [r.input_ids for r in got] == [[[0], [1], [2], [3]], [[4], [5], [6], [7]], [[8], [9]]]


SLICES = [([], [], [], []), ([7], [], [7], [7]), ([1, 2], [1], [1, 2], [1, 2]),
          ([1, 2, 3], [1, 2], [2, 3], [1, 2, 3]), ([1, 2, 3, 4, 5], [1, 2, 3], [4, 5], [1, 2, 3, 4, 5])]


def test_token_slices(spark):
    df = spark.createDataFrame([(s[0],) for s in SLICES], "ids array<int>")
    got = df.select(token_rows.prompt_half_split("ids").alias("h"), token_rows.response_tail("ids", 2).alias("t2"),
                    token_rows.response_tail("ids", 5).alias("t5")).collect()
    for s, r in zip(SLICES, got):
        assert (r.h, r.t2, r.t5) == (s[1], s[2], s[3])


def test_pad_argmax_accuracy(spark):
    df = spark.createDataFrame([([1, 2], [0.1, 0.9, 0.9]), ([3, 3, 3], [2.0, 1.0, 0.0])],
                               "ids array<int>, v array<double>")
    got = df.select(token_rows.left_pad("ids", 4, 9).alias("p"), token_rows.argmax("v").alias("a")).collect()
    assert [r.p for r in got] == [[9, 9, 1, 2], [9, 3, 3, 3]]
    assert [r.a for r in got] == [1, 0]
    acc = token_rows.shifted_accuracy(df, "ids", "ids").first()
    assert (acc.matches, acc.compared) == (2, 3)


@pytest.mark.parametrize("size", [100, 2, 0])
def test_tokens_lose_nothing(spark, size):
    rows = [(1, "x = 1\n"), (2, "y = x + 'é日😀'\n" + "z" * 500), (3, ""), (4, None), (5, "x x x")]
    df = spark.createDataFrame(rows, "k long, t string")
    lexed = token_rows.lex_documents(df, "k", "t")
    vocab = token_rows.vocab_from_lexemes(lexed, "lexemes", size)
    ids = token_rows.tokenize_lexemes(lexed, "k", "lexemes", vocab, size)
    dec = token_rows.decode(ids, "input_ids", vocab, size).orderBy("k").collect()
    assert [(r.k, r.decoded) for r in dec] == rows
    assert dec[2].input_ids == [] and dec[3].input_ids is None
    assert max(max(r.input_ids or [0]) for r in dec) < token_rows.eos_id(size)
    end = spark.createDataFrame([([token_rows.eos_id(size), size + 65],)], "i array<int>")
    assert token_rows.decode(end, "i", vocab, size).first().decoded == "<eos>A"


def test_equal_keys_spread_over_tasks(spark):
    df = spark.range(2000, numPartitions=4).selectExpr("'' as k", "id")
    idx = prepare.positional_index(df, ["k"], num_partitions=8)
    assert sorted(r.pos for r in idx.collect()) == list(range(2000))
    assert len([f for f in idx.inputFiles() if "part-" in f]) > 2
    with pytest.raises(ValueError):
        prepare.split_head_percent(df, ["k"], 50)


def test_split_in_file_order(spark, tmp_path):
    from codeweigh.plans import workflows

    path = tmp_path / "lines.txt"
    path.write_text("".join(f"z{i:02}\n" for i in range(99, -1, -1)))
    s = workflows.prepare_splits(spark, train_file=str(path), validation_split_percentage=5, max_train_samples=3)
    assert [r.text for r in s.validation.collect()] == [f"z{i}\n" for i in range(99, 94, -1)]
    assert sorted(r.text for r in s.train.collect()) == ["z92\n", "z93\n", "z94\n"]


def test_cut_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "cast(id as string) as text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(prepare.in_head(df, ["k"], 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(k,49)" in plan and "Exchange" not in plan


def test_fractional_hash_split(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = [prepare.split_hash_percent(df, "k", p).where("split = 'validation'").count() for p in (0.5, 1, 50)]
    assert 60 < n[0] < 150 and 150 < n[1] < 260 and 9700 < n[2] < 10300


def test_seeded_shuffle(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r.k for r in prepare.seeded_shuffle(df, "k", 1).orderBy("shuffle_pos").collect()]
    b = [r.k for r in prepare.seeded_shuffle(df.repartition(7), "k", 1).orderBy("shuffle_pos").collect()]
    c = [r.k for r in prepare.seeded_shuffle(df, "k", 2).orderBy("shuffle_pos").collect()]
    assert a == b != c and sorted(a) == sorted(c) == list(range(500))


def test_tokenized_table_is_reused_only_if_finished_and_the_same(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.range(3)
    assert readers.write_tokenized(one, path, one, {"v": 1}).count() == 3
    assert readers.write_tokenized(one.limit(0), path, one, {"v": 1}).count() == 3  # reused
    assert readers.write_tokenized(spark.range(5), path, one, {"v": 2}).count() == 5  # other settings
    assert readers.write_tokenized(spark.range(4), path, spark.range(4), {"v": 2}).count() == 4  # other rows
    failing = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        readers.write_tokenized(failing, path, spark.range(9), {"v": 3})
    assert readers.write_tokenized(spark.range(7), path, spark.range(4), {"v": 2}).count() == 7  # not what a failed write left


def test_reward_log_grows_and_retries(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(10).selectExpr("id", "'p' as prompt", "'o' as output", "0.5d as reward", "id div 5 as batch_id")
    reward_log.write_reward_log(rows.where("batch_id = 0"), path, "a")
    reward_log.write_reward_log(rows.where("batch_id = 1").limit(2), path, "b")
    got = reward_log.write_reward_log(rows.where("batch_id = 1"), path, "b")
    assert sorted(r.id for r in got.collect()) == list(range(10))
    assert got.select("sample").distinct().collect()[0].sample == "po"


def test_rewrite_file(spark, tmp_path):
    src = tmp_path / "g.txt"
    src.write_text("{!this.ok()}?\nplain\n")
    got = readers.rewrite_file(spark, str(src), str(tmp_path / "out"))
    assert sorted(r.value for r in got.collect()) == ["plain", "{not self.ok()}?"] and "!this." in src.read_text()


@pytest.mark.parametrize("line,out", [("{!this.ok()}?", "{not self.ok()}?"), ("{this.open();}", "{self.open();}"),
                                      ("xthis.y", "xself.y"), ("no change", "no change")])
def test_rewrite(spark, line, out):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(readers.rewrite_lines("l").alias("r")).first().r == out


def test_text_scan_and_dispatch(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("one\ntwo\n")
    rows = [r.text for r in readers.scan_by_extension(spark, str(p)).collect()]
    assert rows == ["one\n", "two\n"]
    rows = [r.text for r in readers.scan_text(spark, str(p), keep_linebreaks=False).collect()]
    assert rows == ["one", "two"]
    with pytest.raises(ValueError):
        readers.scan_by_extension(spark, str(tmp_path / "a.xml"))


def test_text_column_and_split_check(spark):
    df = spark.createDataFrame([(1, "a")], "id long, body string")
    assert prepare.resolve_text_column(df) == "id"
    assert prepare.resolve_text_column(df, "body") == "body"
    with pytest.raises(ValueError):
        prepare.filter_split(df.withColumn("split", F.lit("train")), "validation")


def test_csv_json_round_trips(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline, with comma'), (2, "plain"), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    csv, js = str(tmp_path / "x.csv"), str(tmp_path / "x.json")
    df.write.option("header", True).option("escape", '"').csv(csv)
    df.write.json(js)
    got_csv = sorted((r.id, r.text or "") for r in readers.scan_csv(spark, csv, df.schema, multi_line=True).collect())
    got_json = sorted((r.id, r.text) for r in readers.scan_json(spark, js, df.schema).collect())
    assert got_csv == sorted(rows) and got_json == sorted(rows)
    one = tmp_path / "one.json"
    one.write_text('[{"id": 5, "text": "x"},\n {"id": 6, "text": "y"}]')
    multi = readers.scan_json(spark, str(one), df.schema, multi_line=True).orderBy("id").collect()
    assert [(r.id, r.text) for r in multi] == [(5, "x"), (6, "y")]


def test_scan_named_with_config(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(str(tmp_path / "ds" / "cfg.parquet"))
    got = readers.scan_named(spark, str(tmp_path), "ds", "cfg").collect()
    assert [(r.id, r.text) for r in got] == [(1, "a")]


def test_kth_key_equals_a_sort(spark, monkeypatch):
    import random

    r = random.Random(5)
    monkeypatch.setattr(prepare, "FEW", 20)
    monkeypatch.setattr(prepare, "PIVOTS", 6)
    unique = [(x, f"é{x % 7}") for x in r.sample(range(10**9), 3000)]
    tied = [(r.choice([1, 1, 1, 2, 3, 9]), "b") for _ in range(3000)]
    for rows in (unique, tied, unique[:5]):
        df = spark.createDataFrame(rows, "a long, b string").repartition(5)
        for cols in (["a"], ["b", "a"]):
            keys = sorted(tuple({"a": a, "b": b}[c] for c in cols) for a, b in rows)
            for k in (0, len(rows) // 20, len(rows) - 1):
                last, upto = prepare.kth_key(df, cols, k)
                assert tuple(last) == keys[k] and upto == sum(x <= keys[k] for x in keys)
    with pytest.raises(ValueError, match="row 5 of 5"):
        prepare.kth_key(df, ["a"], 5)


def test_split_moves_no_keys(spark):
    """The condition is a plain comparison that reaches the scan; nothing is sorted for it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plan = docs.where(prepare.in_head(docs, ["doc_id"], 5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(doc_id), LessThanOrEqual(doc_id,49)]" in plan
