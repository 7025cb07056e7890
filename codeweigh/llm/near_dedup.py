"""Near-duplicate groups: SuperMinHash, banding, verification, union-find.

Two documents are linked if their sets of 5-word shingles have a Jaccard
similarity of at least 75 %; a group is a connected component.

1. ``sketch``: per document the set's size, its digest and its SuperMinHash
   signature.  Equal sets are linked anyway, so one document per digest goes
   on: a third of all rows that are copies cost one row per task.
2. Banding: 32 bands of 4 slots.  A pair at the threshold shares no band with
   probability (1 - 0.75 ** 4) ** 32 < 6e-6.
3. Candidates: in each bucket every member is compared, by signature, with the
   bucket's first.  Only those that differ from the first are compared with
   the rest, inside tasks that hold two bounded blocks of the bucket, and a
   task emits a forest, never its pairs.  Candidates need an estimate of
   ``ESTIMATE`` or more (4.5 standard deviations below the threshold).
4. Verification on full sets: the candidates' components are compared exactly
   in the same way: all members with the first, then the rest with all.
5. ``components`` of the verified links.

So the work in a group is its size times the members that differ from its
first, and no pair table, group or component meets in one task or the driver.

Rows: null, empty and blank texts have an empty set and are linked with
nothing (``component_id`` is their own id).  Each row is judged by its own
text; repeated rows give equal results, and where different texts share a
``doc_id`` that represents them, they are linked.  A row without ``doc_id``
belongs to its copies that have one; else it stays, compared with nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm import superminhash as S
from codeweigh.llm.common import documents, map_rows, texts, written
from codeweigh.llm.components import UnionFind, components

THRESHOLD = 75
ESTIMATE = 0.59
#: Members of a group that one task holds on either side.
BLOCK = 500


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, bands) per row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [S.shingles(t) for t in texts(batch)]
        full = [s for s in sets if len(s)]
        signatures = S.signatures(full)
        keys = iter(S.band_keys(signatures).view(np.int64).tolist()) if full else iter(())
        rows = iter(signatures)
        return pa.record_batch([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
            pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "signature", "bands"])

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>", kernel)


# ------------------------------------------------- similarity of one with many


def estimates(payloads: list[bytes]) -> Callable[[int], np.ndarray]:
    all_ = np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), S.SLOTS)
    return lambda i: (all_ == all_[i]).mean(1) >= ESTIMATE


def exact(payloads: list[bytes]) -> Callable[[int], np.ndarray]:
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes = np.array([len(s) for s in sets])
    names, where = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def linked(i: int) -> np.ndarray:
        mine = np.zeros(len(names), np.int64)
        mine[where[starts[i]:starts[i] + sizes[i]]] = 1
        common = np.add.reduceat(mine[where], starts)
        return 100 * common >= THRESHOLD * (sizes + sizes[i] - common)

    return linked


def forest(ids: list[int], odd: list[bool], compare: list[bool], like: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is alike, comparing each member marked ``compare``
    with all others.  Members that are not odd are known to be connected; an odd
    one that is already connected with them needs no comparison: what it is like
    is compared with it in turn, or connected with them too."""
    groups, edges = UnionFind(), []
    main = [i for i, o in zip(ids, odd) if not o]
    for i in main:
        groups.union(main[0], i)
    for k, c in enumerate(compare):
        if not c or (main and groups.find(ids[k]) == groups.find(main[0])):
            continue
        for other in np.flatnonzero(like(k)).tolist():
            if groups.union(ids[k], ids[other]):
                edges.append((ids[k], ids[other]))
    return edges


# ---------------------------------------------------------------- Spark jobs


def with_first(members: DataFrame, group: str, like: Callable) -> DataFrame:
    """Compare each (group, doc_id, payload) with the payload of the group's
    first; adds ``first`` and ``alike``."""
    sizes = members.groupBy(group).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    first = written(members.withColumnRenamed("payload", "other").join(sizes.withColumnRenamed("first", "doc_id"), [group, "doc_id"]).select(
        group, F.col("doc_id").alias("first"), "size", "other"), "first")
    kind = members.schema[group].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("payload").to_pylist(), batch.column("other").to_pylist())
        alike = [bool(like([mine, other])(0)[1]) for mine, other in pairs]
        return pa.record_batch([batch.column(c) for c in (group, "doc_id", "first", "size")] + [pa.array(alike, pa.bool_())],
                               names=[group, "doc_id", "first", "size", "alike"])

    return map_rows(members.join(first, group).select(group, "doc_id", "first", "size", "payload", "other"),
                    f"{group} {kind}, doc_id long, first long, size long, alike boolean", kernel)


def rest_with_all(members: DataFrame, group: str, like: Callable) -> DataFrame:
    """Links (a, b) among (group, doc_id, odd, payload): every odd member
    against all, in blocks; a task holds two blocks and emits a forest.  Every row
    keeps its own ``odd``; ``compare`` marks the odd block of the task."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("all"), F.count_if("odd").alias("odds")).filter("odds > 0 and all > 1")
    sizes = written(sizes, "sizes")
    n = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    rows = members.join(sizes.select(group, n("all").alias("n_all"), n("odds").alias("n_odd")), group)
    mine: Callable[[str], Column] = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    every = rows.select(group, "doc_id", "payload", "odd", F.lit(False).alias("compare"), mine("n_all").alias("j"),
                        F.explode(F.sequence(F.lit(0), F.col("n_odd") - 1)).alias("i"))
    odd = rows.filter("odd").select(group, "doc_id", "payload", "odd", F.lit(True).alias("compare"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), mine("n_odd").alias("i"))

    def run(table: pa.Table) -> pa.Table:
        doc_id, odd_, compare, payload = (table.column(c).to_pylist() for c in ("doc_id", "odd", "compare", "payload"))
        odds = {i for i, o in zip(doc_id, odd_) if o}
        mine_ = {i for i, c in zip(doc_id, compare) if c}
        seen = sorted(set(zip(doc_id, payload)))
        edges = forest([i for i, _ in seen], [i in odds for i, _ in seen], [i in mine_ for i, _ in seen], like([x for _, x in seen]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return every.unionByName(odd).groupBy(group, "i", "j").applyInArrow(run, "a long, b long")


def links(members: DataFrame, group: str, like: Callable, name: str) -> DataFrame:
    """(a, b): a forest that connects what is alike within each group of
    (group, doc_id, payload), however large the group."""
    compared = written(with_first(members, group, like), name)
    odd = compared.filter("size > 2").groupBy(group, "doc_id").agg(F.max(~F.col("alike")).alias("odd"))
    mixed = odd.groupBy(group).agg(F.max("odd").alias("any")).filter("any").select(group)
    rest = members.join(odd.join(mixed, group, "left_semi"), [group, "doc_id"])
    direct = compared.filter("alike and doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return direct.unionByName(rest_with_all(rest, group, like))


def group_near(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    sketches = written(sketch(docs), "sketches")
    # grouped sides are written before they are joined: a join of two plain shuffles can be split at a hot key
    classes = written(sketches.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "representatives")
    of_class = written(sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left"), "classes")
    one = sketches.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    one = one.select("doc_id", "signature", "bands")

    keys = one.select("doc_id", F.explode("bands").alias("bucket"))
    shared = written(keys.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("bucket"), "shared")
    in_bucket = written(keys.join(shared, "bucket", "left_semi").distinct(), "buckets")
    payload = one.select("doc_id", F.col("signature").alias("payload"))
    near = written(links(in_bucket.join(payload, "doc_id").select("bucket", "doc_id", "payload"), "bucket", estimates, "estimates"), "candidates")
    family = written(components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("family"), batch.column("doc_id"), pa.array([S.shingles(t).tobytes() for t in texts(batch)], pa.binary())],
                               names=["family", "doc_id", "payload"])

    full = written(map_rows(docs.join(family, "doc_id").select("family", "doc_id", "text"), "family long, doc_id long, payload binary", sets)
                   .filter("length(payload) > 0"), "sets")
    component = components(written(links(full, "family", exact, "verified"), "links"))
    found = of_class.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of the one document that stays of each group, with all columns."""
    kept = group_near(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(documents(spark, sf_dir))


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB SQL: intersections by shared shingle, components by reachability.
ORACLE = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {THRESHOLD} * (x.n + y.n - c)),
pairs as (select a, b from link union all select b, a from link),
reach(s, t) as (select a, b from pairs union select s, b from reach join pairs on t = a),
least_id as (select s, min(t) m from reach group by s)
select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(m, doc_id)) component_id, doc_id = least(doc_id, coalesce(m, doc_id)) kept
from w left join n using (doc_id) left join least_id on s = doc_id
"""


def forget() -> None:
    """Drop what a worker keeps between batches."""
    S._NAMES.clear()
