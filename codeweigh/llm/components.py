"""Connected components of an edge table: local union-find, then star contraction.

Each task first reduces its edges to a forest with union-find, so a dense
group costs one edge per node and task.  Alternating large-star and small-star
rounds then pull every node to the least node of its component; each round is
a grouped minimum (partial before the shuffle) and a join, and is written to
the shared folder.  Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweigh.llm.common import written


class UnionFind(dict):
    """Roots are the least members."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


#: Edges that one task takes up before it hands its forest on.
FOREST_EDGES = 1 << 20


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, seen = UnionFind(), 0

    def out() -> pa.RecordBatch:
        pairs = [(x, found.find(x)) for x in list(found)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.union(a, b)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield out()
            found, seen = UnionFind(), 0
    yield out()


def _shape(df: DataFrame) -> tuple:
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its least node."""
    now = written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
                  .mapInArrow(_forests, "u long, v long").distinct(), "forest")
    shape = _shape(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins read plain shuffles, which Spark splits at a node of very many edges
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "star")
        before, shape = shape, _shape(now)
        if shape == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
