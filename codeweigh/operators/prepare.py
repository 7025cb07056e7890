"""Dataset preparation: text column, splits, limits, positions, batches
(P1, P3, P5, L1-L6, W1, W2).

Positions never come from an unpartitioned window (that is one task).  The
frame is range-partitioned on the order key, sorted inside partitions and
written to the shared folder (so both passes see one layout); the
position is then the per-partition row number plus a broadcast prefix sum of
partition sizes (one row per partition, so its size is bounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.permutation import permuted
from ..session import materialize

_LOW33 = (1 << 33) - 1


def resolve_text_column(df: DataFrame, name: str | None = None) -> str:
    """The given column, else ``text``, else the first column."""
    if name is not None:
        if name not in df.columns:
            raise ValueError(f"text column {name!r} not in {df.columns}")
        return name
    return "text" if "text" in df.columns else df.columns[0]


def select_prompts(df: DataFrame, name: str | None = None) -> DataFrame:
    """Project the resolved text column (it stays distributed)."""
    return df.select(resolve_text_column(df, name))


def filter_split(df: DataFrame, split: str, known: list[str] | None = None) -> DataFrame:
    """P5: rows of one named split, which must exist.  Whoever made the frame
    knows its splits (``readers.split_names``) and passes them as ``known``; without, the
    column's distinct values are looked up (a pass over one column)."""
    present = set(known) if known is not None else {r[0] for r in df.select("split").distinct().collect()}
    if split not in present:
        raise ValueError(f"split {split!r} requested but only {sorted(present)} exist")
    return df.where(F.col("split") == split)


def positional_index(df: DataFrame, order_by: list[str], num_partitions: int | None = None,
                     col: str = "pos") -> DataFrame:
    """W1 helper: 0-based position of each row in ``order_by`` order.  Equal
    keys keep the order they are read in, and spread over several tasks."""
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              spark.sparkContext.defaultParallelism, 1)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(n, *order_by, "_tie").sortWithinPartitions(*order_by, "_tie").drop("_tie")
    fixed = materialize(ordered.withColumn("_pid", F.spark_partition_id())
                               .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = fixed.join(F.broadcast(offsets), "_pid")
    return out.withColumn(col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33))).drop(
        "_pid", "_mid", "_off")


def batch_rows(df: DataFrame, order_by: list[str], batch_size: int) -> DataFrame:
    """``pos`` and ``batch_id = floor(pos / batch_size)``."""
    idx = positional_index(df, order_by)
    return idx.withColumn("batch_id", F.floor(F.col("pos") / F.lit(batch_size)).cast("bigint"))


def collate_batches(rows: DataFrame, ids: str = "input_ids") -> DataFrame:
    """One row per batch with its members' id lists in position order.

    A group holds ``batch_size`` rows, so it is bounded by construction."""
    g = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", ids))).alias("_m"))
    return g.select("batch_id", F.transform("_m", lambda m: m[ids]).alias(ids))


def limit_rows(df: DataFrame, order_by: list[str], n: int | None) -> DataFrame:
    """L1/L2/L3: first ``min(n, rows)`` rows in key order (a top-k, not a scan cap)."""
    if n is None:
        return df
    return df.orderBy(*order_by).limit(int(n))


#: Keys drawn as pivots in a round of :func:`kth_key`, and rows few enough to look at one by one.
PIVOTS, FEW = 64, 10_000


def kth_key(df: DataFrame, order_by: list[str], k: int) -> tuple[Row, int]:
    """The key of the ``k``-th row (from 0) in key order, and how many rows have it or less.

    No sort and no table of keys: each round draws ``PIVOTS`` random keys between
    the bounds (a top-k of random numbers), counts in one pass how many rows
    lie up to each (one row of counts per task) and moves the bounds to the two pivots around
    the ``k``-th row.  A round leaves about one row in thirty, so a billion
    rows take six; the last ``FEW`` are looked at one by one.  Where a single
    key fills the bounds, that is it."""
    one = len(order_by) == 1  # a plain column compares faster than a struct
    key = (F.col(order_by[0]) if one else F.struct(*order_by)).alias("k")
    kinds = [df.schema[c].dataType for c in order_by]

    def lit(value):
        return _literal(value).cast(kinds[0]) if one else F.struct(*[_literal(v).cast(t).alias(c) for v, t, c in zip(value, kinds, order_by)])

    def as_row(value):
        return Row(**{order_by[0]: value}) if one else value
    rows, low, high, below, left, rounds = df.select(key), None, None, 0, None, 0
    left = df.count()
    if not 0 <= k < left:
        raise ValueError(f"row {k} of {left}")
    while True:
        inside = rows if low is None else rows.where(F.col("k") > lit(low))
        inside = inside if high is None else inside.where(F.col("k") <= lit(high))
        if left <= FEW:
            found = [r["k"] for r in inside.orderBy("k").limit(FEW).collect()]
            last = found[k - below]
            return as_row(last), below + sum(x == last for x in found) + found.index(last)
        ticket = F.xxhash64(F.monotonically_increasing_id(), F.lit(rounds))
        pivots = [r["k"] for r in inside.orderBy(ticket).limit(PIVOTS).orderBy("k").collect()]
        pivots = list(dict.fromkeys(pivots))
        counts = inside.agg(F.min("k").alias("least"), F.max("k").alias("most"), *[F.count_if(F.col("k") <= lit(p)).alias(f"n{i}") for i, p in enumerate(pivots)]).first()
        if counts["least"] == counts["most"]:
            return as_row(counts["most"]), below + left
        if all(p == counts["most"] for p in pivots):  # nothing to choose from: step over the least key
            pivots = [counts["least"]]
            counts = inside.agg(F.count_if(F.col("k") <= lit(pivots[0])).alias("n0")).first()
        upto = [counts[f"n{i}"] for i in range(len(pivots))]
        at = next((i for i, n in enumerate(upto) if n > k - below), len(pivots))
        if at < len(pivots):
            high, left = pivots[at], upto[at]
        if at:
            low, below, left = pivots[at - 1], below + upto[at - 1], left - upto[at - 1]
        rounds += 1


def in_head(df: DataFrame, order_by: list[str], percent: float):
    """Condition for the first p% of the rows (rounded half to even) in key order.

    The key at the cut is found by :func:`kth_key`; the condition compares each row with
    it, so nothing is sorted or shuffled and it reaches the scan.  Keys that are
    equal across the cut are refused: the cut would not be defined.  Keys are not null."""
    cut = round(df.count() * float(percent) / 100.0)
    if cut < 1:
        return F.lit(False)
    last, upto = kth_key(df, order_by, cut - 1)
    if upto > cut:
        raise ValueError(f"rows around the cut share the key {order_by}; give a unique order")
    limits = [_literal(last[c]).cast(df.schema[c].dataType) for c in order_by]
    if len(order_by) == 1:
        return F.col(order_by[0]) <= limits[0]
    return F.struct(*order_by) <= F.struct(*[v.alias(c) for v, c in zip(limits, order_by)])


def _literal(value):
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


def split_head_percent(df: DataFrame, order_by: list[str], percent: float) -> DataFrame:
    """L4: first p% (rounded half to even) is ``validation``, the rest ``train``."""
    return df.withColumn("split", F.when(in_head(df, order_by, percent), "validation").otherwise("train"))


def seeded_hash(key: str, seed: int):
    """60 bits of ``md5(key:seed)``: the same in any engine and partitioning."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def split_hash_percent(df: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """Order-free split by :func:`seeded_hash`; percent may be fractional."""
    part = F.pmod(seeded_hash(key, seed), F.lit(1_000_000))
    return df.withColumn("split", F.when(part < F.lit(float(percent)) * 10_000, "validation").otherwise("train"))


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Reproducible random order from a seed; adds its 0-based position."""
    keyed = df.withColumn("_h", seeded_hash(key, seed))
    return positional_index(keyed, ["_h", key], col="shuffle_pos").drop("_h")


def computed_shuffle(df: DataFrame, position: str, n: int, seed: int) -> DataFrame:
    """L6 for a table with positions 0..n-1: its rows' places in a random order, computed
    from the position alone (no sort, no shuffle).  ``position_of`` inverts it."""
    return df.withColumn("shuffle_pos", permuted(position, n, seed))
