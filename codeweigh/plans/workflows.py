"""The two end-to-end workflows of the original project, as Spark jobs.

Both only compose registered operators; parameter names follow the original
command-line flags so a run can be switched over one flag at a time.

* :func:`prepare_splits` -- load a named dataset or train/validation files,
  derive a validation split when none exists, resolve the text column and cap
  each split (the first entry point, up to the reward callback).
* :func:`rollout_batches` -- tokenize, truncate to the context left for new
  tokens, number rows into batches and cut prompts (the second entry point,
  up to generation, which is not part of this engine).
* :func:`score_rollouts` -- score prompt/output pairs with a fixed or a
  computed calibration and summarise rewards per batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, prepare, scoring, token_rows
from ..session import materialize
from ..sources import readers


@dataclass
class Splits:
    train: DataFrame | None
    validation: DataFrame | None
    text_column: str


def prepare_splits(spark: SparkSession, dataset_name: str | None = None, dataset_root: str | None = None,
                   dataset_config_name: str | None = None, train_file: str | None = None,
                   validation_file: str | None = None, validation_split_percentage: float = 5,
                   text_column_name: str | None = None, max_train_samples: int | None = None,
                   max_eval_samples: int | None = None, order_by: list[str] | None = None,
                   keep_linebreaks: bool = True) -> Splits:
    """Load, split, resolve the text column and cap.

    Existing ``train``/``validation`` splits are used as they are; without a
    validation split, the first ``validation_split_percentage`` % of the
    train rows (in ``order_by`` order, else as stored) become it."""
    if dataset_name is not None:
        data = readers.scan_named(spark, dataset_root, dataset_name, dataset_config_name)
        data = data if order_by else readers.with_file_order(data)
    elif train_file is not None or validation_file is not None:
        data = readers.scan_train_validation(spark, train_file, validation_file,
                                             keep_linebreaks=keep_linebreaks, file_order=not order_by)
    else:
        raise ValueError("give dataset_name or train_file/validation_file")
    if train_file is not None or validation_file is not None:
        present = {n for n, p in (("train", train_file), ("validation", validation_file)) if p is not None}
    else:  # one column, as many names as splits
        present = ({r[0] for r in data.select("split").distinct().collect()}
                   if "split" in data.columns else set())
    key = order_by or [readers.FILE_ORDER]
    if "validation" not in present:
        base = data.where(F.col("split") == "train") if "train" in present else data
        base = base.drop("split") if "split" in base.columns else base
        data = prepare.split_head_percent(base, key, validation_split_percentage)
    text = prepare.resolve_text_column(data.drop("split", readers.FILE_ORDER), text_column_name)
    train = data.where(F.col("split") == "train").drop("split")
    valid = data.where(F.col("split") == "validation").drop("split")
    return Splits(prepare.limit_rows(train, key, max_train_samples).drop(readers.FILE_ORDER),
                  prepare.limit_rows(valid, key, max_eval_samples).drop(readers.FILE_ORDER), text)


def rollout_batches(df: DataFrame, key: str, text: str, per_device_train_batch_size: int = 64,
                    context_size: int = 1024, max_new_tokens: int = 512, split_examples: bool = False,
                    vocab_size: int = token_rows.DEFAULT_VOCAB) -> DataFrame:
    """Tokenize, truncate, batch and cut prompts.

    Returns ``key, batch_id, pos, input_ids, query_ids, query`` where the query
    is the first half of the ids with ``split_examples`` (else all of them),
    decoded back to text."""
    lexed = token_rows.lex_stretches(df, key, text)
    vocab = materialize(token_rows.vocab_from_lexemes(lexed, "lexemes", vocab_size, stretched=True))
    limit = token_rows.max_input_length(context_size, max_new_tokens)
    ids = token_rows.tokenize_lexemes(lexed, key, "lexemes", vocab, vocab_size, max_length=limit, stretched=True)
    rows = prepare.batch_rows(ids, [key], per_device_train_batch_size)
    q = token_rows.prompt_half_split("input_ids") if split_examples else F.col("input_ids")
    rows = rows.withColumn("query_ids", q)
    return token_rows.decode(rows, "query_ids", vocab, vocab_size, out="query")


def score_rollouts(pairs: DataFrame, avg_tokens: float | None = None, avg_errors: float | None = None,
                   batch_col: str | None = "batch_id", errors_of: str = "sample") -> tuple[DataFrame, DataFrame | None]:
    """Score ``prompt``/``output`` pairs (R4, A1 or U1) and summarise per batch (A3).

    With both averages given they are used as fixed calibration; otherwise
    they are computed from the pairs themselves.  ``errors_of="output"`` judges
    outputs without their prompts (no split of the examples)."""
    if avg_tokens is not None and avg_errors is not None:
        scored = scoring.score_frame(pairs, "prompt", "output", avg_tokens, avg_errors, errors_of=errors_of)
    else:
        scored = scoring.score_pairs(pairs, errors_of=errors_of)
    stats = metrics.reward_batch_stats(scored, batch_col) if batch_col in scored.columns else None
    return scored, stats
