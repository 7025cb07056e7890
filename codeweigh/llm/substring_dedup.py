"""Substring deduplication by recompression.

A window is ``WINDOW`` consecutive words of one document.  Every word covered
by a window whose word sequence also starts in a document with a smaller
``doc_id`` is removed; windows are judged on the input.

1. ``anchor_runs``: every window has an anchor, a block of high-level symbols
   of its recompression that its own words settle (``recompression``).  Stretches of
   windows with one anchor make one row, with a name of all words they cover.
2. Anchors of one document only are dropped: equal windows have equal anchors.
3. Stretches that are equal as a whole to one in a smaller document are
   settled at once: inner parts of long repeats, and copies.
4. Where an anchor stands in stretches of different words (edges of repeats),
   their first documents are compared window by window, by 128-bit names.
5. Marked stretches are verified on the words of the document and cut.

Groups reach the shuffles pre-aggregated (least and greatest ``doc_id``), and
the joins back to rows are plain equi-joins that Spark can split where a third
of all documents share a passage.  Lists per document are bounded by its
length.

Rows: null, empty and blank texts have no words; texts of fewer than
``WINDOW`` words lose none.  A window repeated in one document only is kept.
Rows that share a ``doc_id`` are one document for "smaller", and each is cut
by what its own text repeats.  Rows without ``doc_id`` are neither cut nor
taken as first.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import documents, map_rows, texts, written
from codeweigh.llm.recompression import Names, anchors
from codeweigh.llm.superminhash import word_names

WINDOW = 50
#: Bytes of text whose windows are named together: some tens of bytes of memory for each.
SLICE = 2 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _batch_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of a batch, and each document's number of words."""
    found = [words(t) for t in texts(batch)]
    return word_names([w for row in found for w in row]), np.array([len(row) for row in found], np.int64)


def anchor_runs(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, at, n): ``n`` windows from word ``at`` on share
    an anchor; ``context`` names all ``n + WINDOW - 1`` words they cover."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names, sizes = _batch_words(batch)
        begins = np.cumsum(sizes) - sizes
        many = np.maximum(sizes - WINDOW + 1, 0)
        if not many.sum():
            return None
        doc = np.repeat(np.arange(len(sizes)), many)
        starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins, many)
        name, level, place = anchors(names, starts, WINDOW)
        new = np.ones(len(starts), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (level[1:] != level[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(starts)))
        context = Names(names)(starts[at], n + WINDOW - 1)
        ids = batch.column("doc_id").take(pa.array(doc[at]))
        return pa.record_batch([pa.array(name[at].view(np.int64)), pa.array(context.view(np.int64)), ids,
                                pa.array((starts[at] - begins[doc[at]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                               names=["anchor", "context", "doc_id", "at", "n"])

    return map_rows(docs.select("doc_id", "text"), "anchor long, context long, doc_id long, at int, n int", kernel, most=SLICE)


def _ranges(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("ranges"))


def window_names(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """(one, two, doc_id, at) of every window of the given runs."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names, sizes = _batch_words(batch)
        begins = np.cumsum(sizes) - sizes
        doc, at = [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            p = np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in ranges])
            p = p[p + WINDOW <= sizes[i]]
            at.append(p)
            doc.append(np.full(len(p), i))
        doc, at = np.concatenate(doc), np.concatenate(at)
        if not len(doc):
            return None
        starts = begins[doc] + at
        return pa.record_batch([pa.array(Names(names)(starts, WINDOW).view(np.int64)), pa.array(Names(names, True)(starts, WINDOW).view(np.int64)),
                                batch.column("doc_id").take(pa.array(doc)), pa.array(at.astype(np.int32))], names=["one", "two", "doc_id", "at"])

    return map_rows(docs.join(_ranges(open_runs, "at", "n"), "doc_id").select("doc_id", "text", "ranges"),
                    "one long, two long, doc_id long, at int", kernel, most=SLICE)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, at, n, context): stretches of ``n`` windows to remove."""
    runs = written(anchor_runs(docs), "anchor-runs")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("context") < F.max("context")).alias("mixed"))
    # grouped sides are written before they are joined: a join of two plain shuffles can be split at a hot key
    shared = written(shared.filter("lo < hi").select("anchor", "mixed"), "shared-anchors")
    runs = written(runs.join(shared, "anchor"), "shared-runs")
    first = written(runs.groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "first")
    runs = written(runs.join(first, ["anchor", "context"]), "judged-runs")
    names = written(window_names(docs, runs.filter("first = doc_id and mixed")), "windows")
    least = names.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("one", "two", "first")
    least = written(least, "least")
    single = names.join(least, ["one", "two"]).filter("first < doc_id").select("doc_id", "at", F.lit(1).alias("n"), F.col("one").alias("context"))
    return runs.filter("first < doc_id").select("doc_id", "at", "n", "context").unionByName(single)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of ``docs``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, sha, kept_text = [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            w = words(text)
            n_words.append(len(w))
            if ranges:
                at = np.array([r["at"] for r in ranges])
                size = np.array([r["n"] for r in ranges]) + WINDOW - 1
                context = np.array([r["context"] for r in ranges], np.int64).view(np.uint64)
                fits = at + size <= len(w)
                at, size, context = at[fits], size[fits], context[fits]
                same = Names(word_names(w))(at, size) == context  # verified on this text
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, at[same], 1)
                np.add.at(change, (at + size)[same], -1)
                w = [x for x, c in zip(w, np.cumsum(change)) if not c]
            n_removed.append(n_words[-1] - len(w))
            kept = b" ".join(w)
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        return pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    rows = docs.join(_ranges(found, "at", "n", "context"), "doc_id", "left").select("doc_id", "text", "ranges")
    return map_rows(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", kernel)


def deduplicate_substrings(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return remove(docs, marked(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(documents(spark, sf_dir)).drop("kept_text")


#: DuckDB SQL: every window by its words, the least doc_id of each, covered positions.
ORACLE = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) i from w where len(w) >= {WINDOW})),
least_id as (select g, min(doc_id) first from win group by g),
gone as (select distinct doc_id, p from (select doc_id, unnest(generate_series(i, i + {WINDOW - 1})) p from win join least_id using (g) where first < doc_id)),
word as (select doc_id, unnest(w) x, unnest(generate_series(1, len(w))) p from w),
kept as (select word.doc_id, string_agg(x, ' ' order by p) k, count(*) n from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by word.doc_id)
select w.doc_id, len(w.w) n_words, len(w.w) - coalesce(kept.n, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 from w left join kept on w.doc_id = kept.doc_id
"""
