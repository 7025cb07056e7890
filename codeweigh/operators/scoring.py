"""Pairs, counts, calibration and the reward.

Plan at scale: ``conversations -> pair (join on (conv_id, turn)) -> lex
prompt+output and output once -> checkpoint counts -> calibrate (partial +
final aggregate over two int columns) -> scalar subquery -> score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reward as R
from ..functions.lexing import add_py_profile
from ..session import materialize


def pair_prompt_output(conv: DataFrame, how: str = "inner") -> DataFrame:
    """A user turn and the assistant turn right after it become one pair.

    Keyed on ``(conv_id, turn)``, which is unique, so the shuffle is balanced
    even when one conversation holds a large share of all turns.
    ``how="right"`` keeps assistant turns without a user prompt (prompt null),
    ``how="left"`` user turns without an answer (output null).
    """
    u = conv.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("prompt"))
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"),
        F.col("text").alias("output"))
    j = u.join(a, (u.conv_id == a.a_conv) & (u.u_turn + 1 == a.a_turn), how)
    if how in ("inner", "left"):
        return j.select("conv_id", F.col("u_turn").alias("turn"), "prompt", "output")
    return j.select(F.col("a_conv").alias("conv_id"), (F.col("a_turn") - 1).alias("turn"),
                    "prompt", "output")


def concat_sample(pairs: DataFrame) -> DataFrame:
    """``sample = prompt ++ output`` (null in, null out)."""
    return pairs.withColumn("sample", F.concat("prompt", "output"))


def spread(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Deal pairs out before they are lexed.  A join of small sides ends in as many
    tasks as its larger side's scan has, often one; lexing is the costly part.
    A rebalance by key is sized by bytes (AQE splits and merges its partitions),
    so it fits any amount of data.  Streams are left as they are."""
    return pairs if pairs.isStreaming else pairs.hint("rebalance", *keys)


def add_counts(pairs: DataFrame, errors_of: str = "sample", spread_by: list[str] | None = None) -> DataFrame:
    """``nt`` = tokens of the output, ``ne`` = structural errors of prompt+output,
    ``ns`` = statements of prompt+output.  The output is lexed alone and as
    part of the sample; with ``errors_of="output"`` it is judged alone.
    ``spread_by`` names keys to deal the pairs out by first (see :func:`spread`)."""
    if spread_by:
        pairs = spread(pairs, spread_by)
    if errors_of == "output":
        alone = add_py_profile(pairs, "output", "_po")
        return alone.withColumns({"nt": F.col("_po.tokens"), "ne": F.col("_po.errors"), "ns": F.col("_po.stmts")}).drop("_po")
    if errors_of != "sample":
        raise ValueError("errors_of is 'sample' or 'output'")
    with_out = add_py_profile(pairs, "output", "_po")
    both = add_py_profile(with_out.withColumn("_sample", F.concat("prompt", "output")), "_sample", "_ps")
    return (both.withColumn("nt", F.col("_po.tokens"))
                .withColumn("ne", F.col("_ps.errors"))
                .withColumn("ns", F.col("_ps.stmts"))
                .drop("_po", "_ps", "_sample"))


#: Why a pair cannot be judged, by condition.  (A null prompt is judged: it scores 0.)
UNFIT = {"output is null": "output IS NULL"}


def quarantine(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that can be judged, and the others with a ``reason``.

    One unfit row does not end the job: the others are scored, and the unfit go to a
    table of their own (:func:`score_or_reject`, and the log of a stream)."""
    reason = F.coalesce(*[F.when(F.expr(condition), F.lit(why)) for why, condition in UNFIT.items()])
    marked = pairs.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def score_or_reject(pairs: DataFrame, errors_of: str = "sample", spread_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """R4 with R5's quarantine: the scored pairs (calibrated on themselves) and the rejected ones."""
    good, bad = quarantine(pairs)
    return score_pairs(good, errors_of=errors_of, spread_by=spread_by), bad


def calibrate(counts: DataFrame) -> DataFrame:
    """A1: one row ``avg_tokens, avg_errors, n``; each mean is floored at 1.
    Pairs that cannot be judged (null prompt or output) do not count.

    Empty input gives null averages; :func:`apply_calibration` then fails
    with a clear message instead of dividing by zero.
    """
    n = F.count(F.lit(1))

    def mean_at_least_1(c):
        return F.when(n > 0, F.greatest(F.sum(c).cast("double") / n, F.lit(1.0)))
    counts = counts.where(F.col("nt").isNotNull() & F.col("ne").isNotNull())
    return counts.agg(mean_at_least_1("nt").alias("avg_tokens"), mean_at_least_1("ne").alias("avg_errors"),
                      n.alias("n"))


def calibrate_sums(sums: DataFrame) -> DataFrame:
    """A1 from partial sums (nt, ne, n): they merge in any order."""
    n = F.coalesce(F.sum("n"), F.lit(0))

    def mean_at_least_1(c):
        return F.when(n > 0, F.greatest(F.sum(c).cast("double") / n, F.lit(1.0)))
    return sums.agg(mean_at_least_1("nt").alias("avg_tokens"), mean_at_least_1("ne").alias("avg_errors"), n.alias("n"))


def calibrate_statements(counts: DataFrame) -> DataFrame:
    """A2: mean statements per sample, floored at 1."""
    n = F.count(F.lit(1))
    counts = counts.where(F.col("ns").isNotNull())
    return counts.agg(F.when(n > 0, F.greatest(F.sum("ns").cast("double") / n, F.lit(1.0))).alias("avg_stmt"),
                      n.alias("n"))


def apply_calibration(counts: DataFrame, calibration: DataFrame) -> DataFrame:
    """Every row gets the two global averages.

    The one-row calibration is a scalar subquery: computed once, then used as
    a value in the projection (no join)."""
    cal = calibration.select(F.struct("avg_tokens", "avg_errors").alias("_cal")).scalar()
    return (counts.withColumn("_cal", cal)
                  .withColumn("avg_tokens", F.col("_cal.avg_tokens"))
                  .withColumn("avg_errors", F.col("_cal.avg_errors")).drop("_cal"))


def score(calibrated: DataFrame, factor: int = R.DECAY_FACTOR, errors_of: str = "sample") -> DataFrame:
    """Add ``reward`` to rows carrying nt, ne, avg_tokens, avg_errors."""
    prompt = "prompt" if errors_of == "sample" else None  # judged alone, an output needs no prompt
    return calibrated.withColumn(
        "reward", R.reward("nt", "ne", "avg_tokens", "avg_errors", prompt, "output", factor))


def score_pairs(pairs: DataFrame, persist: bool = True, errors_of: str = "sample", spread_by: list[str] | None = None) -> DataFrame:
    """Count once, calibrate on the counts, score: ``pairs + nt, ne, reward``.

    With ``persist`` the counted pairs are written to the shared folder
    so calibration (two ints) and scoring read them instead of lexing twice.
    ``errors_of="output"`` scores outputs alone, without their prompts.
    """
    counts = add_counts(pairs, errors_of, spread_by)
    if persist:
        counts = materialize(counts)
    cal = calibrate(counts)
    return score(apply_calibration(counts, cal), errors_of=errors_of).drop("avg_tokens", "avg_errors", "ns")


def score_frame(df: DataFrame, prompt: str, output: str, avg_tokens: float, avg_errors: float,
                factor: int = R.DECAY_FACTOR, errors_of: str = "sample", spread_by: list[str] | None = None) -> DataFrame:
    """Score a frame with fixed calibration values given by the caller."""
    renamed = df.withColumnRenamed(prompt, "prompt").withColumnRenamed(output, "output")
    counts = add_counts(renamed, errors_of, spread_by)
    return counts.withColumn(
        "reward", R.reward("nt", "ne", F.lit(float(avg_tokens)), F.lit(float(avg_errors)),
                           "prompt" if errors_of == "sample" else None, "output", factor)).drop("ns")
