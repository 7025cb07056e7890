"""Registered queries: one per operator, each over the given tables.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE[key]`` (DuckDB SQL
over the same tables) share column names.  Parameters that are fixed values
of the original workflow are named in ``PARAMS``.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexing as L
from ..functions import reward as R
from ..functions.permutation import position_of
from ..operators import metrics, prepare, scoring, subwords, token_rows, tokens, udf
from ..session import materialize, rebalance, scratch_path, table
from ..sources import readers, reward_log, token_cache
from ..streaming import calibration
from ..streaming.score_stream import score_stream

# FIXED VALUES (launch parameters of the original workflow): batch size,
# new tokens per response, validation share, sample caps, calibration
# sample, fixed calibration of the second entry point, reward keyword,
# size of its tokenizer's vocabulary (50,257 with the bytes and the end of a text).
PARAMS = dict(batch_size=64, max_new_tokens=512, context_size=1024, validation_percent=5,
              max_train_samples=100, max_eval_samples=100, calibration_sample=100,
              fixed_avg_tokens=200.0, fixed_avg_errors=50.0, keyword="er", seed=42,
              vocab_size=token_rows.DEFAULT_VOCAB, truncate_to=128, subword_merges=token_rows.DEFAULT_VOCAB, cache_files=8)

#: Replacements of :func:`code_like`, in order.
CODE_LIKE = [(". ", ":\n    "), (", ", "\n"), (" of ", "\n\t"), (" the ", ":\n        "), (" with ", "\n  \t"), (" de ", " = (")]

#: Replacements of :func:`escaped`, in order.
ESCAPED = [("\n", " "), ("'", "\\'"), ('"', '\\"')]

P = PARAMS
V = P["vocab_size"]
PAIR_KEYS = ["conv_id", "turn"]


# ----------------------------------------------------------------- helpers
def _conv(spark, sf):
    return table(spark, sf, "conversations")


def _pairs(spark, sf):
    return scoring.pair_prompt_output(_conv(spark, sf))


def code_like(text):
    """Prose as indented lines, by plain replacements that DuckDB has too:
    a sentence opens a block, some words start deeper or outer lines."""
    out = F.col(text)
    for old, new in CODE_LIKE:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _code(spark, sf):
    return _docs(spark, sf).select("doc_id", code_like("text").alias("text"))


def _counts(spark, sf):
    c = scoring.add_counts(_pairs(spark, sf), spread_by=PAIR_KEYS)
    return c.withColumn("nt", F.col("nt").cast("bigint")).withColumn("ne", F.col("ne").cast("bigint")) \
            .withColumn("ns", F.col("ns").cast("bigint"))


def _scored(spark, sf):
    s = scoring.score_pairs(_pairs(spark, sf), spread_by=PAIR_KEYS)
    return s.withColumn("nt", F.col("nt").cast("bigint")).withColumn("ne", F.col("ne").cast("bigint"))


def _calibrated(spark, sf):
    counts = materialize(_counts(spark, sf))
    return scoring.apply_calibration(counts, scoring.calibrate(counts))


def _docs(spark, sf):
    return rebalance(table(spark, sf, "documents"), "doc_id")


def _raw_docs(spark, sf):
    return table(spark, sf, "documents")


def _pages(spark, sf):
    return rebalance(table(spark, sf, "pages"), "page_id")


def _lexed(spark, sf):
    return token_rows.lex_stretches(_docs(spark, sf), "doc_id", "text")


def _vocab(spark, sf, lexed=None):
    lexed = lexed if lexed is not None else _lexed(spark, sf)
    # at most V rows; written once because encoding and decoding both read it
    return materialize(token_rows.vocab_from_lexemes(lexed, "lexemes", V, stretched=True))


def _ids(spark, sf, lexed=None):
    lexed = lexed if lexed is not None else _lexed(spark, sf)
    return token_rows.tokenize_lexemes(lexed, "doc_id", "lexemes", _vocab(spark, sf, lexed), V, stretched=True)


def _split(spark, sf):
    return prepare.split_head_percent(_raw_docs(spark, sf), ["doc_id"], P["validation_percent"])


def _tv_files(spark, sf):
    """Train/validation files derived from the tables: documents and benchmark."""
    train = scratch_path(spark, "train") + ".json"
    valid = scratch_path(spark, "validation") + ".json"
    _raw_docs(spark, sf).select(F.col("doc_id").alias("id"), "text").write.json(train)
    table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text").write.json(valid)
    return train, valid


def _tv(spark, files):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    return readers.scan_train_validation(spark, *files, schema)


def _round6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- S*
def q_scan_named(spark, sf):
    return readers.scan_named(spark, sf, "conversations")


def q_scan_csv(spark, sf):
    conv = table(spark, sf, "conversations")
    path = scratch_path(spark, "conversations") + ".csv"
    conv.write.option("header", True).option("escape", '"').csv(path)
    return readers.scan_csv(spark, path, conv.schema, multi_line=True)


def q_scan_json(spark, sf):
    docs = _raw_docs(spark, sf)
    path = scratch_path(spark, "documents") + ".json"
    docs.write.json(path)
    return readers.scan_json(spark, path, docs.schema)


def q_scan_text(spark, sf):
    path = scratch_path(spark, "benchmark") + ".txt"
    table(spark, sf, "benchmark").select("text").write.text(path)
    return readers.scan_text(spark, path, keep_linebreaks=True)


def q_scan_train_validation(spark, sf):
    return _tv(spark, _tv_files(spark, sf))


def q_rewrite_lines(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", readers.rewrite_lines("html").alias("html"))


def q_write_tokenized(spark, sf):
    path, docs = scratch_path(spark, "tokenized"), _raw_docs(spark, sf).select("doc_id", "text")
    settings = {"vocab_size": V}
    ids = _ids(spark, sf)
    # an older table of other settings is replaced, then the finished one is reused
    readers.write_tokenized(ids.limit(0), path, docs, {"vocab_size": 0})
    readers.write_tokenized(ids, path, docs, settings)
    return readers.write_tokenized(ids.limit(0), path, docs, settings)


def q_refresh_tokens(spark, sf):
    """Documents in several files, one of which changes after the first refresh."""
    src, path = scratch_path(spark, "files"), scratch_path(spark, "token_cache")
    vocab = _vocab(spark, sf)

    def write(which, text):
        part = F.col("doc_id") % P["cache_files"]
        docs = _raw_docs(spark, sf).where(which(part)).withColumn("part", part)
        # one file for a part, or several of a part too large for one task
        docs.select("doc_id", text.alias("text"), "part").hint("rebalance", "part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(src)

    def encode(rows):
        lexed = rows.select(F.struct("doc_id", "_path").alias("row"), L.py_stretches("text").alias("lexemes"))
        return token_rows.tokenize_lexemes(lexed, "row", "lexemes", vocab, V, stretched=True).select("row.*", "input_ids")

    write(lambda part: part >= 0, F.col("text"))
    token_cache.refresh(spark, src, path, encode, {"vocab_size": V})
    write(lambda part: part == 0, F.replace("text", F.lit("e"), F.lit("E")))
    return token_cache.refresh(spark, src, path, encode, {"vocab_size": V}).table


def q_write_reward_log(spark, sf):
    scored = _scored(spark, sf)
    batched = prepare.batch_rows(scored, PAIR_KEYS, P["batch_size"]).select(*PAIR_KEYS, "prompt", "output", "reward", "batch_id")
    path = scratch_path(spark, "reward_log")
    own = lambda run: batched.where(F.col("batch_id") % 2 == int(run))
    reward_log.write_reward_log(own("0"), path, "0")
    reward_log.write_reward_log(batched, path, "1")  # too many rows: the retry below replaces them all
    return reward_log.write_reward_log(own("1"), path, "1")


def q_log_stream(spark, sf):
    pairs = _pairs(spark, sf)
    src, path = scratch_path(spark, "pairs_in"), scratch_path(spark, "reward_log")
    scoring.spread(pairs, PAIR_KEYS).write.parquet(src)
    for attempt in range(2):  # the stream is run again without its checkpoint: finished epochs are recognised
        reward_log.log_stream(spark, src, pairs.schema, path, "stream", scratch_path(spark, "stream_ckpt"), P["fixed_avg_tokens"], P["fixed_avg_errors"])
    return reward_log.read(spark, path).select(*PAIR_KEYS, "prompt", "output", "sample", "reward", "run", "epoch")


# ----------------------------------------------------------------- P*
def q_resolve_text_column(spark, sf):
    docs = _raw_docs(spark, sf)
    return docs.select(prepare.resolve_text_column(docs))


def q_drop_source_columns(spark, sf):
    return _ids(spark, sf).select("input_ids")


def q_select_prompts(spark, sf):
    docs = _raw_docs(spark, sf)
    return prepare.select_prompts(docs.where(~prepare.in_head(docs, ["doc_id"], P["validation_percent"])))


def q_concat_sample(spark, sf):
    return scoring.concat_sample(_pairs(spark, sf))


def q_filter_split(spark, sf):
    files = _tv_files(spark, sf)
    return prepare.filter_split(_tv(spark, files), "validation", known=readers.split_names(*files))


# ----------------------------------------------------------------- J*, A*
def q_pair_prompt_output(spark, sf):
    return _pairs(spark, sf)


def q_apply_calibration(spark, sf):
    return _calibrated(spark, sf).select(*PAIR_KEYS, "nt", "ne", "avg_tokens", "avg_errors")


def q_calibrate(spark, sf):
    return scoring.calibrate(_counts(spark, sf))


def q_calibrate_statements(spark, sf):
    return scoring.calibrate_statements(_counts(spark, sf))


def q_calibrate_stream(spark, sf):
    """Half of the conversations land, the stream runs and stops; then the other half."""
    src, checkpoint = scratch_path(spark, "pairs_in"), scratch_path(spark, "calibration")
    pairs = _pairs(spark, sf)
    for half in (0, 1):
        scoring.spread(pairs.where(F.col("conv_id") % 2 == half), PAIR_KEYS).write.mode("append").parquet(src)
        calibration.calibrate_stream(spark, src, pairs.schema, checkpoint)
    return calibration.read_calibration(spark, checkpoint)


def q_reward_batch_stats(spark, sf):
    rewards = _scored(spark, sf).select(*PAIR_KEYS, "reward")  # texts are not moved to number the rows
    batched = prepare.batch_rows(rewards, PAIR_KEYS, P["batch_size"])
    return metrics.reward_batch_stats(batched)


def q_token_histogram(spark, sf):
    return tokens.token_histogram(_code(spark, sf), "doc_id", "text")


# ----------------------------------------------------------------- W*, L*
def q_batch_rows(spark, sf):
    return prepare.batch_rows(_raw_docs(spark, sf).select("doc_id"), ["doc_id"], P["batch_size"])


def q_collate_batches(spark, sf):
    rows = prepare.batch_rows(_ids(spark, sf), ["doc_id"], P["batch_size"])
    return prepare.collate_batches(rows)


def q_limit_train(spark, sf):
    docs = _raw_docs(spark, sf).select("doc_id", "text")
    return prepare.limit_rows(docs.where(~prepare.in_head(docs, ["doc_id"], P["validation_percent"])), ["doc_id"], P["max_train_samples"])


def q_limit_eval(spark, sf):
    docs = _raw_docs(spark, sf).select("doc_id", "text")
    return prepare.limit_rows(docs.where(prepare.in_head(docs, ["doc_id"], P["validation_percent"])), ["doc_id"], P["max_eval_samples"])


def q_calibration_sample(spark, sf):
    sample = prepare.limit_rows(_pairs(spark, sf), PAIR_KEYS, P["calibration_sample"])
    return scoring.calibrate(scoring.add_counts(sample))


def q_split_head_percent(spark, sf):
    return _split(spark, sf).select("doc_id", "split")


def q_split_hash_percent(spark, sf):
    return prepare.split_hash_percent(_raw_docs(spark, sf).select("doc_id"), "doc_id",
                                      P["validation_percent"], P["seed"])


def q_seeded_shuffle(spark, sf):
    return prepare.seeded_shuffle(_raw_docs(spark, sf).select("doc_id"), "doc_id", P["seed"])


def q_computed_shuffle(spark, sf):
    docs = _raw_docs(spark, sf).select("doc_id")
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    out = prepare.computed_shuffle(docs, "doc_id", n, P["seed"])
    return out.withColumn("inverse", position_of("shuffle_pos", n, P["seed"]))


# ----------------------------------------------------------------- R*
def q_normalize(spark, sf):
    c = _calibrated(spark, sf)
    return c.select(*PAIR_KEYS, _round6(R.normalize("nt", 0, "avg_tokens")).alias("norm_tokens"))


def q_exponential_decay(spark, sf):
    c = _calibrated(spark, sf)
    a = R.clamp(R.normalize("nt", 0, "avg_tokens"), R.LENGTH_FLOOR, R.LENGTH_CEIL)
    return c.select(*PAIR_KEYS, (_round6(R.exponential_decay(R.normalize("ne", 0, "avg_errors"), a))
                                 + F.lit(0.0)).alias("decay"))


def q_clamp(spark, sf):
    c = _calibrated(spark, sf)
    a = R.clamp(R.normalize("nt", 0, "avg_tokens"), R.LENGTH_FLOOR, R.LENGTH_CEIL)
    return c.select(*PAIR_KEYS, _round6(a).alias("clamped_length"))


def q_reward(spark, sf):
    return _scored(spark, sf)


def q_reward_failure_guard(spark, sf):
    conv = _conv(spark, sf)
    # every assistant turn, with its user prompt when there is one; lexed once
    outs = materialize(scoring.add_counts(scoring.pair_prompt_output(conv, how="right"), spread_by=PAIR_KEYS))
    cal = scoring.calibrate(outs.where(F.col("prompt").isNotNull()))
    s = scoring.score(scoring.apply_calibration(outs, cal))
    return s.select(*PAIR_KEYS, F.col("prompt").isNull().alias("prompt_missing"), "reward")


def q_quarantine(spark, sf):
    """Every user turn: scored if it has an answer, else rejected with the reason."""
    pairs = scoring.pair_prompt_output(_conv(spark, sf), how="left")
    scored, rejected = scoring.score_or_reject(pairs, spread_by=PAIR_KEYS)
    return scored.select(*PAIR_KEYS, "reward", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select(*PAIR_KEYS, F.lit(None).cast("double").alias("reward"), "reason"))


def q_keyword_count_reward(spark, sf):
    s = scoring.concat_sample(_pairs(spark, sf))
    return s.select(*PAIR_KEYS, R.keyword_count("sample", P["keyword"]).alias("reward"))


# ----------------------------------------------------------------- K*
def q_tokenize_ids(spark, sf):
    return _ids(spark, sf)


def q_subword_ids(spark, sf):
    docs = _docs(spark, sf)
    lexed = docs.select(F.struct("doc_id", "text").alias("doc"), L.py_stretches("text").alias("lexemes"))
    merges = subwords.train(subwords.count_words(lexed, "lexemes", stretched=True), P["subword_merges"])
    ids = subwords.decode(subwords.encode(lexed, "doc", "lexemes", merges, stretched=True), "input_ids", merges)
    return ids.select("doc.doc_id", "input_ids", (F.col("decoded") == F.col("doc.text")).alias("same_text"))


def q_truncate_tokens(spark, sf):
    return _ids(spark, sf).select("doc_id", token_rows.truncate("input_ids", P["truncate_to"]).alias("input_ids"))


def q_max_input_length(spark, sf):
    m = token_rows.max_input_length(P["context_size"], P["max_new_tokens"])
    ids = _ids(spark, sf)
    return ids.select("doc_id", F.lit(m).cast("bigint").alias("max_input_length"),
                      F.size(token_rows.truncate("input_ids", m)).cast("bigint").alias("n_ids"))


def q_prompt_half_split(spark, sf):
    return _ids(spark, sf).select("doc_id", token_rows.prompt_half_split("input_ids").alias("prompt_ids"))


def q_response_tail(spark, sf):
    return _ids(spark, sf).select("doc_id", token_rows.response_tail("input_ids", P["max_new_tokens"])
                                  .alias("tail_ids"))


def q_decode_tokens(spark, sf):
    docs = _docs(spark, sf)
    vocab = _vocab(spark, sf)
    ids = token_rows.tokenize_lexemes(docs.select(F.struct("doc_id", "text").alias("doc"), L.py_stretches("text").alias("lexemes")),
                                      "doc", "lexemes", vocab, V, stretched=True)
    d = token_rows.decode(ids, "input_ids", vocab, V)
    return d.select("doc.doc_id", "decoded", (F.col("decoded") == F.col("doc.text")).alias("same_text"))


def q_left_pad(spark, sf):
    return _ids(spark, sf).select("doc_id", token_rows.left_pad("input_ids", P["truncate_to"], token_rows.eos_id(V)).alias("input_ids"))


def q_argmax_array(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", token_rows.argmax("embedding").alias("argmax"))


def q_shifted_accuracy(spark, sf):
    """Predictions: the next id, but at every third position the id itself."""
    ids = _ids(spark, sf)
    preds = F.transform("input_ids", lambda x, i: F.when(i % 3 == 0, x).otherwise(F.coalesce(F.get("input_ids", i + 1), F.lit(-1))))
    return token_rows.shifted_accuracy(ids.withColumn("preds", preds), "preds", "input_ids")


# ----------------------------------------------------------------- T*
PROFILE_T3 = ["tokens"]
PROFILE_T4 = ["final_depth", "max_depth", "unmatched_closers", "open_left"]
PROFILE_T5 = ["nl", "ind", "ded", "max_nesting"]
PROFILE_T8 = ["e1", "e2", "e3", "e4", "e5", "errors"]
PROFILE_T9 = ["stmts"]


def q_code_lexemes(spark, sf):
    return tokens.lexeme_stats(_pages(spark, sf), "page_id", "html")


def escaped(text):
    """A text as it stands in a minified file: one line, every quote escaped."""
    out = F.col(text)
    for old, new in ESCAPED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def q_escaped_lexemes(spark, sf):
    return tokens.lexeme_lengths(_pages(spark, sf).select("page_id", escaped("html").alias("html")), "page_id", "html")


def q_python_token_table(spark, sf):
    return tokens.python_token_table(_code(spark, sf), "doc_id", "text")


def q_python_token_count(spark, sf):
    return tokens.profile(_code(spark, sf), "doc_id", "text", PROFILE_T3)


def q_bracket_depth(spark, sf):
    return tokens.profile(_pages(spark, sf), "page_id", "html", PROFILE_T4)


def q_bracket_pairs(spark, sf):
    return tokens.bracket_rows(_pages(spark, sf), "page_id", "html")


def q_indent_profile(spark, sf):
    return tokens.profile(_code(spark, sf), "doc_id", "text", PROFILE_T5)


def q_indent_width(spark, sf):
    return tokens.indent_widths(_code(spark, sf), "text")


def q_unknown_chars(spark, sf):
    return tokens.unknown_chars(_pages(spark, sf), "page_id", "html")


def q_structural_errors(spark, sf):
    return tokens.profile(_code(spark, sf), "doc_id", "text", PROFILE_T8)


def q_token_pair_errors(spark, sf):
    return tokens.token_pairs(_code(spark, sf), "doc_id", "text")


def q_statement_count(spark, sf):
    return tokens.profile(_code(spark, sf), "doc_id", "text", PROFILE_T9)


def q_java_token_table(spark, sf):
    return tokens.java_token_table(_pages(spark, sf), "page_id", "html")


# ----------------------------------------------------------------- X1, U*
def q_score_stream(spark, sf):
    pairs = _pairs(spark, sf)
    src = scratch_path(spark, "pairs_in")
    scoring.spread(pairs, PAIR_KEYS).write.parquet(src)  # files arrive; one task reads one
    cal = scoring.calibrate(scoring.add_counts(spark.read.parquet(src))).first()
    sink = scratch_path(spark, "scored_out")
    score_stream(spark, src, pairs.schema, sink, scratch_path(spark, "stream_ckpt"),
                 cal["avg_tokens"], cal["avg_errors"])
    out = spark.read.parquet(sink)
    return out.select(*PAIR_KEYS, F.col("nt").cast("bigint").alias("nt"),
                      F.col("ne").cast("bigint").alias("ne"), "reward")


def q_score_frame(spark, sf):
    s = scoring.score_frame(_pairs(spark, sf), "prompt", "output",
                            P["fixed_avg_tokens"], P["fixed_avg_errors"], spread_by=PAIR_KEYS)
    return s.select(*PAIR_KEYS, F.col("nt").cast("bigint").alias("nt"),
                    F.col("ne").cast("bigint").alias("ne"), "reward")


def _count_keyword(prompts: pd.Series, outputs: pd.Series) -> pd.Series:
    return (prompts + outputs).str.count(PARAMS["keyword"]).astype("int64")


def q_custom_reward(spark, sf):
    s = udf.custom_reward(_pairs(spark, sf), _count_keyword, return_type=T.LongType())
    return s.select(*PAIR_KEYS, "reward")


def _text_stats(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": b["doc_id"], "n_chars": b["text"].str.len().astype("int64"),
                         "n_lines": b["text"].str.count("\n").astype("int64")})


def q_map_batches(spark, sf):
    return udf.map_batches(_raw_docs(spark, sf).select("doc_id", "text"), _text_stats,
                           "doc_id long, n_chars long, n_lines long")


QUERIES = {
    "scan_named": q_scan_named, "scan_csv": q_scan_csv, "scan_json": q_scan_json,
    "scan_text": q_scan_text, "scan_train_validation": q_scan_train_validation,
    "rewrite_lines": q_rewrite_lines, "write_tokenized": q_write_tokenized,
    "refresh_tokens": q_refresh_tokens, "write_reward_log": q_write_reward_log,
    "resolve_text_column": q_resolve_text_column, "drop_source_columns": q_drop_source_columns,
    "select_prompts": q_select_prompts, "concat_sample": q_concat_sample,
    "filter_split": q_filter_split,
    "pair_prompt_output": q_pair_prompt_output, "apply_calibration": q_apply_calibration,
    "calibrate": q_calibrate, "calibrate_stream": q_calibrate_stream, "calibrate_statements": q_calibrate_statements,
    "reward_batch_stats": q_reward_batch_stats, "token_histogram": q_token_histogram,
    "batch_rows": q_batch_rows, "collate_batches": q_collate_batches,
    "limit_train": q_limit_train, "limit_eval": q_limit_eval,
    "calibration_sample": q_calibration_sample, "split_head_percent": q_split_head_percent,
    "split_hash_percent": q_split_hash_percent, "seeded_shuffle": q_seeded_shuffle, "computed_shuffle": q_computed_shuffle,
    "normalize": q_normalize, "exponential_decay": q_exponential_decay, "clamp": q_clamp,
    "reward": q_reward, "reward_failure_guard": q_reward_failure_guard, "quarantine": q_quarantine,
    "keyword_count_reward": q_keyword_count_reward,
    "tokenize_ids": q_tokenize_ids, "subword_ids": q_subword_ids, "truncate_tokens": q_truncate_tokens,
    "max_input_length": q_max_input_length, "prompt_half_split": q_prompt_half_split,
    "response_tail": q_response_tail, "decode_tokens": q_decode_tokens, "left_pad": q_left_pad,
    "argmax_array": q_argmax_array, "shifted_accuracy": q_shifted_accuracy,
    "code_lexemes": q_code_lexemes, "escaped_lexemes": q_escaped_lexemes, "python_token_table": q_python_token_table,
    "python_token_count": q_python_token_count, "bracket_depth": q_bracket_depth, "bracket_pairs": q_bracket_pairs,
    "indent_profile": q_indent_profile, "indent_width": q_indent_width,
    "unknown_chars": q_unknown_chars, "structural_errors": q_structural_errors,
    "token_pair_errors": q_token_pair_errors, "statement_count": q_statement_count, "java_token_table": q_java_token_table,
    "score_stream": q_score_stream, "log_stream": q_log_stream, "score_frame": q_score_frame,
    "custom_reward": q_custom_reward, "map_batches": q_map_batches,
}
