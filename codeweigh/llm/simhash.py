"""SimHash groups by multi-index hashing.

1. ``fingerprints``: per text 64 bits; a bit is 1 if it is set in over half the
   hashes of the text's word shingles (repeats count).
2. Equal fingerprints become one row (copies are one row a task before the
   shuffle); everything below works on distinct fingerprints.
3. Multi-index hashing: a fingerprint is cut into segments with radii; if the
   radii plus one add up to more than ``DISTANCE``, two fingerprints at that
   distance or less agree in some segment up to its radius.  One table holds each
   fingerprint under its segments' values; each fingerprint then looks up all values
   in the Hamming ball around its own segments, and every hit is verified on all
   64 bits.  ``layout`` picks segments by the number of distinct fingerprints, so
   that a look-up meets few strangers; all layouts give the same links.
4. Dense buckets: in a bucket of many alike fingerprints each would meet all.  So
   first every fingerprint is compared with its buckets' least and greatest
   (one comparison each) and the components of these links are found.  Members of
   the component that prevails in a bucket then meet only the bucket's others:
   the work in a bucket is its size times its others, and what joins them goes
   through union-find inside the task, so that no list of pairs is kept.
5. ``components`` of all links; a component's name is its least ``doc_id``.

Null, empty and blank texts have fingerprint zero and are linked like any other;
a text of fewer than ``WORDS`` words has one shingle.  Very long texts are hashed in
slices.  Repeated rows and equal texts share a fingerprint; ties of bits (exactly
half) are 0.  A row without ``doc_id`` gets its component like any other, but names
none; the component of such rows alone is null.  An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import documents, map_rows, texts, written
from codeweigh.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
BITS = 64
#: Segments as (width, radius).
LAYOUTS = [[(16, 1), (16, 0), (16, 0), (16, 0)], [(22, 1), (21, 1), (21, 0)], [(32, 2), (32, 1)]]
#: What meeting a stranger costs, in look-ups.
STRANGER = 0.05
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in slices; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        yield np.array([hashed(whole, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[:-WORDS])).tolist(), (ends[WORDS - 1:] - 1).tolist()
    for at in range(0, len(starts), SLICE):
        yield np.array([hashed(whole[a:b], SEED) for a, b in zip(starts[at:at + SLICE], stops[at:at + SLICE])], np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row."""
    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", lambda batch: pa.record_batch(
        [batch.column("doc_id"), pa.array([fingerprint(t) for t in texts(batch)], pa.int64())], names=["doc_id", "fp"]))


# ------------------------------------------------------------ multi-index hashing


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def layout(distinct: int) -> list[tuple[int, int]]:
    """The layout with the cheapest look-ups: one for each value of a ball, plus the strangers met there."""
    return min(LAYOUTS, key=lambda segments: sum(len(ball(*s)) * (1 + STRANGER * distinct / 2 ** s[0]) for s in segments))


def _segments(fp: Column, segments: list[tuple[int, int]], masks: bool) -> Column:
    """Buckets of a fingerprint: its segments' values, or all values in their balls.  A bucket's number holds the segment's."""
    found, at = [], 0
    for k, (width, radius) in enumerate(segments):
        own = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 48))
        flips = F.array(*[F.lit(m).cast("long") for m in (ball(width, radius) if masks else [0])])
        found.append(F.transform(flips, own.bitwiseXOR))
        at += width
    return F.concat(*found)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def with_ends(table: DataFrame) -> DataFrame:
    """Links (a, b) of each (bucket, fp) with its bucket's least and greatest."""
    ends = written(table.groupBy("bucket").agg(F.min("fp").alias("least"), F.max("fp").alias("greatest")).filter("least < greatest"), "ends")
    joined = table.join(ends, "bucket").select("fp", F.explode(F.array("least", "greatest")).alias("b"))
    return joined.filter(F.col("fp") != F.col("b")).filter(_near("fp", "b")).select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` at ``DISTANCE`` or less."""
    table = written(fps.select("fp", F.explode(_segments(F.col("fp"), segments, False)).alias("bucket")), "buckets")
    direct = written(with_ends(table).distinct(), "direct")
    group = written(components(direct), "groups").withColumnRenamed("node", "fp").withColumnRenamed("component", "family")
    family = written(fps.join(group, "fp", "left").select("fp", F.coalesce("family", "fp").alias("family")), "family")
    # the family that prevails in a bucket, where it has more than one member there
    held = table.join(family, "fp")
    counts = held.groupBy("bucket", "family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    main = written(counts.groupBy("bucket").agg(F.max_by("family", F.struct("n", "family")).alias("main")), "main")
    side = F.coalesce(F.col("family") == F.col("main"), F.lit(False))
    there = written(held.join(main, "bucket", "left").select("bucket", side.alias("in_main"), F.col("fp").alias("b"), F.col("family").alias("family_b")), "there")
    # a look-up meets the others of a bucket, and its main family only if it is no member
    probes = family.select("fp", "family", F.explode(_segments(F.col("fp"), segments, True)).alias("bucket")).join(main, "bucket", "left")
    meets = F.when(F.col("main").isNull() | side, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    here = written(probes.select("bucket", F.col("fp").alias("a"), "family", F.explode(meets).alias("in_main")), "probes")
    met = here.join(there, (here["bucket"] == there["bucket"]) & (here["in_main"] == there["in_main"]) & (F.col("a") < F.col("b")) & (F.col("family") != F.col("family_b")) & _near("a", "b"))
    return direct.unionByName(met.select("a", "b"))


def group_similar(docs: DataFrame, segments: list[tuple[int, int]] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes.select("fp"), segments or layout(classes.count())))
    named = written(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "members")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = written(named.join(least, "component").select("fp", "component_id"), "names")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_similar(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
