"""End-to-end workflows composed from the operators."""

from pyspark.sql import functions as F

from codeweigh.operators import scoring
from codeweigh.plans import workflows as W
from codeweigh.session import table
from tests.conftest import SF


def test_prepare_splits_named(spark):
    s = W.prepare_splits(spark, dataset_name="documents", dataset_root=SF, validation_split_percentage=5,
                         max_train_samples=100, max_eval_samples=100)
    n = table(spark, SF, "documents").count()
    assert s.text_column == "text"
    assert s.validation.count() == min(100, round(n * 0.05))
    assert s.train.count() == min(100, n - round(n * 0.05))
    assert s.train.join(s.validation, "doc_id").count() == 0


def test_prepare_splits_files(spark, tmp_path):
    tr, va = str(tmp_path / "tr.json"), str(tmp_path / "va.json")
    table(spark, SF, "documents").select("doc_id", "text").write.json(tr)
    table(spark, SF, "benchmark").select(F.col("item_id").alias("doc_id"), "text").write.json(va)
    s = W.prepare_splits(spark, train_file=tr, validation_file=va)
    assert s.validation.count() == table(spark, SF, "benchmark").count()
    only = W.prepare_splits(spark, train_file=tr, validation_split_percentage=10)
    assert only.validation.count() == round(table(spark, SF, "documents").count() * 0.1)


def test_rollouts_and_scoring(spark):
    docs = table(spark, SF, "documents")
    r = W.rollout_batches(docs, "doc_id", "text", per_device_train_batch_size=16, context_size=64,
                          max_new_tokens=32, split_examples=True, vocab_size=5000)
    row = r.orderBy("pos").first()
    assert len(row.input_ids) <= 32 and len(row.query_ids) == len(row.input_ids) - len(row.input_ids) // 2
    assert r.select("batch_id").distinct().count() == -(-docs.count() // 16)
    pairs = scoring.pair_prompt_output(table(spark, SF, "conversations")).withColumn("batch_id", F.lit(0))
    scored, stats = W.score_rollouts(pairs, 200.0, 50.0)
    assert stats.first().n == pairs.count()
    scored2, _ = W.score_rollouts(pairs)
    assert scored2.where("reward < 0 or reward > 1").count() == 0
