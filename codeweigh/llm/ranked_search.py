"""Ranked lexical search: a document FP-tree searched by branch and bound.

All documents are ranked for each item of a query table; each item gets its
``TOP`` best.

1. Items are packed into blocks of bounded bytes (``items_in_blocks``); each block
   is one bounded set of queries, searched over all documents.
2. ``vectors``: one pass over the texts keeps of each document its length and the
   frequencies of the block's terms (its restricted vector).  The number of
   documents, their terms and the document frequencies come from that table.
3. Every task reads its vectors in blocks and builds an FP-tree of each: terms in
   order of document frequency, so common terms stand at the top and documents
   with equal beginnings share a path (paths without a branch are one edge).
   Every node knows, for its subtree, the greatest frequency of each term, the
   least length factor ``m`` and the least ``doc_id``.
4. Per item the tree is searched depth first, best child first.  The score
   grows with a term's frequency and falls with ``m``, so the node's maxima and its
   least ``m`` bound every score below it; a subtree that cannot enter the list is
   skipped.  Subtrees of ``LEAVES`` documents or fewer are scored at once.  The
   lists go on from block to block of a task.
5. Each task hands on ``TOP`` rows an item; a window per item merges them.

Nothing else is shuffled, and no task holds more than one block of cells
(``CELLS``: documents times terms) besides the lists.

Null, empty and signs-only texts hold no term: as documents they count nowhere,
as items they get no rows.  Very long texts are single rows of a long ``n``.  Ties
go to the smaller ``doc_id`` (a row without one comes last); repeated rows are
listed each, with ranks of their own; items with equal ``item_id`` are ranked each.
Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from codeweigh.llm.common import documents, map_rows, slices, texts, written

TOP = 50
#: Bytes of the distinct terms of the items that are searched (and broadcast) together; a larger item stands alone.
BLOCK_BYTES = 1 << 18
#: Documents times terms of one tree.
CELLS = 1 << 23
#: Subtrees of so many documents are scored at once.
LEAVES = 64
_NO_ID = np.iinfo(np.int64).max

_SIGNS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SIGNS + bytes(range(0x41, 0x5B)), b" " * len(_SIGNS) + bytes(range(0x61, 0x7B)))


def terms(text: str | None) -> list[bytes]:
    """Maximal stretches without ASCII signs, only A-Z lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


def items_in_blocks(items: DataFrame) -> DataFrame:
    """(block, item_no, item_id, terms): each item's distinct terms; a block's
    terms have at most ``BLOCK_BYTES`` bytes, or it holds one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = 0, set()
        for batch in batches:
            for piece in slices(batch):
                found = [list(dict.fromkeys(terms(t))) for t in texts(piece)]
                blocks = []
                for new in found:
                    if held and sum(map(len, held.union(new))) > BLOCK_BYTES:
                        block, held = block + 1, set()
                    held.update(new)
                    blocks.append(block)
                yield pa.record_batch([pa.array(blocks, pa.int64()), piece.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["block", "item_id", "terms"])

    packed = items.select("item_id", "text").mapInArrow(run, f"block long, item_id {items.schema['item_id'].dataType.simpleString()}, terms array<binary>")
    return written(packed.filter("size(terms) > 0").select(
        ((F.spark_partition_id().cast("long") * (1 << 32)) + F.col("block")).alias("block"), F.monotonically_increasing_id().alias("item_no"), "item_id", "terms"), "items")


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): length in terms and the vocabulary's frequencies of every document that holds a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = known.value.get
        words = [terms(t) for t in texts(batch)]
        counts = [Counter(map(number, w)) for w in words]
        for c in counts:
            c.pop(None, None)
        return pa.record_batch([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.int32())),
                                pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, terms array<int>, tfs array<int>", kernel).filter("n > 0")


def score(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of each row of frequencies (64-bit integers, division rounds down)."""
    tf = tf.astype(np.int64)
    return (weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))).sum(1)


class Best:
    """The ``TOP`` best rows of one item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.id = top, np.empty(0, np.int64), np.empty(0, np.int64)

    def hopeless(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """True where no row of at most this score and at least this id can enter."""
        if len(self.score) < self.top:
            return bound <= 0
        return (bound < self.score[-1]) | ((bound == self.score[-1]) & (least_id >= self.id[-1])) | (bound <= 0)

    def add(self, score_: np.ndarray, id_: np.ndarray) -> None:
        good = ~self.hopeless(score_, id_)
        if good.any():
            all_, ids = np.concatenate((self.score, score_[good])), np.concatenate((self.id, id_[good]))
            order = np.lexsort((ids, -all_))[:self.top]
            self.score, self.id = all_[order], ids[order]


class Tree:
    """FP-tree of a block of documents.  ``rank``: columns in order of document
    frequency; vectors are (row, rank, tf) with the ranks of a row ascending."""

    def __init__(self, row: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, width: int):
        sizes = np.bincount(row, minlength=len(m))
        ends = np.cumsum(sizes)
        raw = rank.astype(">u4").tobytes()
        keys = [raw[4 * a:4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        order = np.array(sorted(range(len(m)), key=keys.__getitem__), np.int64)
        place = np.empty(len(m), np.int64)
        place[order] = np.arange(len(m))
        self.tf = np.zeros((len(m), width), np.int32)
        self.tf[place[row], rank] = tf
        self.m, self.ids = m[order], ids[order]
        self._nodes(self._shared(rank, (ends - sizes)[order], sizes[order]))

    @staticmethod
    def _shared(rank: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length of the path that each vector shares with the one before it."""
        most = np.minimum(size[1:], size[:-1])
        shared = np.zeros(len(most), np.int64)
        alive = np.flatnonzero(most > 0)
        depth = 0
        while len(alive):
            alive = alive[rank[start[alive] + depth] == rank[start[alive + 1] + depth]]
            depth += 1
            shared[alive] = depth
            alive = alive[most[alive] > depth]
        return shared

    def _nodes(self, shared: np.ndarray) -> None:
        """Branching nodes as ranges of the sorted vectors, children before parents."""
        n = len(self.m)
        low, high, inner, single = [], [], [], []  # per node: its range, its child nodes, its own documents
        stack: list[list] = [[0, 0, [], []]]  # depth, first document, child nodes, own documents

        def close(upto: int) -> int:
            _, first, kids, own = stack.pop()
            if upto - first <= LEAVES:  # scored at once: what is below is not needed
                kids, own = [], range(first, upto)
            low.append(first)
            high.append(upto)
            inner.append(kids)
            single.append(own)
            return len(low) - 1

        for i in range(n):
            now = int(shared[i]) if i < n - 1 else 0
            if now > stack[-1][0]:
                stack.append([now, i, [], [i]])
                continue
            stack[-1][3].append(i)
            while stack[-1][0] > now:
                first = stack[-1][1]
                node = close(i + 1)
                if stack[-1][0] < now:
                    stack.append([now, first, [], []])
                stack[-1][2].append(node)
        close(n)
        self.inner, self.single = [np.array(x, np.int64) for x in inner], [np.array(x, np.int64) for x in single]
        # nodes inside a subtree that is scored at once keep no maxima
        used = np.zeros(len(low), bool)
        used[-1] = True
        for node in range(len(low) - 1, -1, -1):
            if used[node]:
                used[self.inner[node]] = True
        slot = np.cumsum(used) - 1
        self.slot = slot
        self.most = np.zeros((int(used.sum()), self.tf.shape[1]), np.int32)
        self.least_m, self.least_id = np.empty(len(self.most), np.int64), np.empty(len(self.most), np.int64)
        for node in np.flatnonzero(used).tolist():
            at, kids, own = slot[node], slot[self.inner[node]], self.single[node]
            for rows, part in ((kids, self.most), (own, self.tf)):
                if len(rows):
                    np.maximum(self.most[at], part[rows].max(0), out=self.most[at])
            a, b = low[node], high[node]
            self.least_m[at], self.least_id[at] = self.m[a:b].min(initial=_NO_ID), self.ids[a:b].min(initial=_NO_ID)

    def search(self, columns: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Depth-first branch and bound for one item; gives the number of documents scored."""
        scored = 0
        stack = [(len(self.inner) - 1, _NO_ID)]
        while stack:
            node, bound = stack.pop()
            at = self.slot[node]
            if best.hopeless(np.array([bound]), self.least_id[at:at + 1])[0]:
                continue
            own, kids = self.single[node], self.inner[node]
            if len(own):
                best.add(score(weight, self.tf[own[:, None], columns], self.m[own]), self.ids[own])
                scored += len(own)
            if len(kids):
                slots = self.slot[kids]
                bounds = score(weight, self.most[slots[:, None], columns], self.least_m[slots])
                order = np.argsort(bounds, kind="stable")  # the best is popped first
                order = order[~best.hopeless(bounds, self.least_id[slots])[order]]
                stack += zip(kids[order].tolist(), bounds[order].tolist())
        return scored


def search_block(found: DataFrame, rank: np.ndarray, items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, top: int, id_type: str) -> DataFrame:
    """(item_no, item_id, doc_id, score): the best rows of each task.  ``rank``: column of
    each term; ``items``: (item_no, item_id, terms); ``weights`` by term."""
    columns = [rank[np.array(t, np.int64)] for _, _, t in items]
    weight = [weights[np.array(t, np.int64)] for _, _, t in items]
    state = found.sparkSession.sparkContext.broadcast((rank, columns, weight, [(i, x) for i, x, _ in items]))
    id_arrow = to_arrow_type(DataType.fromDDL(id_type))
    width = max(1, len(rank))
    rows = max(1, CELLS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, columns, weight, named = state.value
        lists = [Best(top) for _ in columns]

        def trees(pieces: list[pa.RecordBatch]) -> None:
            batch = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            listed, counts = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            size = np.diff(listed.offsets.to_numpy())
            row, column = np.repeat(np.arange(batch.num_rows), size), rank[listed.flatten().to_numpy()]
            order = np.lexsort((column, row))
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
            tree = Tree(row[order], column[order], counts[order], m, batch.column("doc_id").fill_null(_NO_ID).to_numpy(), width)
            for c, w, best in zip(columns, weight, lists):
                tree.search(c, w, best)

        waiting, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, rows - held)
                waiting.append(piece)
                held, at = held + piece.num_rows, at + piece.num_rows
                if held == rows:
                    trees(waiting)
                    waiting, held = [], 0
        if waiting:
            trees(waiting)
        for (number, name), best in zip(named, lists):
            k = len(best.score)
            ids = pa.array(best.id, pa.int64(), mask=best.id == _NO_ID)
            yield pa.record_batch([pa.array([number] * k, pa.int64()), pa.array([name] * k, id_arrow), ids, pa.array(best.score, pa.int64())], names=["item_no", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, f"item_no long, item_id {id_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    id_type = items.schema["item_id"].dataType.simpleString()
    packed = items_in_blocks(items)
    out = None
    for (block,) in packed.select("block").distinct().orderBy("block").toLocalIterator():
        asked = [(r["item_no"], r["item_id"], [bytes(t) for t in r["terms"]]) for r in packed.filter(F.col("block") == block).collect()]  # of bounded bytes
        vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for _, _, found in asked for t in found))}
        found = written(vectors(docs, vocabulary), "vectors")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        holders = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        df = np.array([holders.get(k, 0) for k in range(len(vocabulary))], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = search_block(found.filter("size(terms) > 0"), rank, [(i, x, [vocabulary[t] for t in t_]) for i, x, t_ in asked], weights, n_docs, n_terms, top, id_type)
        best = written(best, "best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: DuckDB SQL: every document's score for every item that shares a term with it.
ORACLE = f"""
with d as (select doc_id, {_TERMS} w from documents),
i as (select distinct item_id, unnest({_TERMS}) term from benchmark),
n as (select count(*) nn, sum(len(w)) l from d where len(w) > 0),
x as (select doc_id, len(w) len_, unnest(w) term from d),
tf as (select doc_id, len_, term, count(*) tf from x where term in (select term from i) group by all),
df as (select term, count(*) df from tf group by all),
w as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) w from df, n),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len_ * nn) // l)))) as bigint) score from i join tf using (term) join w using (term), n group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) "rank", doc_id, score from s where score > 0)
select * from r where "rank" <= {TOP}
"""
