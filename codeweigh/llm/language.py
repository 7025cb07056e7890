"""Language identification with language-bitmask n-gram filters.

Learning: character n-grams (2, 3 and 4 characters of the letter-only,
lower-cased text, one blank between words) are counted per language.  An
n-gram belongs to a language if its rate there is at least ``RELATIVE`` times
its highest rate in any language and at least ``FLOOR``.  Every language owns
one Bloom filter; the filters are stored bit-sliced, so slot ``i`` holds one
bit per language.  AND-ing the ``HASHES`` slots of an n-gram gives the set of
all languages that contain it.

Deciding: per language, the number of n-grams whose set has its bit is
corrected for the filter's false-positive rate ``f = fill ** HASHES``:
``(hits - n * f) / (1 - f)``, clipped at zero.  The largest wins (ties: the
first name in byte order); ``score`` is its part of the sum over languages,
``coverage`` its part of all n-grams of the text.

Fitting reads a bounded, deterministic sample of ``TRAIN_ROWS`` labelled rows;
each row's whole text counts.  The model has a fixed size: ``SLOTS`` slots of
one bit per language, however large the input.

Rows: null text or a text without a letter gives ``und`` and score 0; so does
any text if nothing could be learned.  A text that shares no n-gram with any
language gets the first language with score 0.  Repeated rows get equal
results.  Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import documents, held_out, keep_rows, map_rows, share_of, texts

SIZES = (2, 3, 4)
TRAIN_ROWS = 20_000
SLOTS = 1 << 20
HASHES = 3
RELATIVE = 0.5
FLOOR = 1e-5
UNKNOWN = "und"
#: Rejected: less of the text's n-grams than this belong to its language.
COVERED = 0.2
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(len(table)):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[cp] = ord(low[0])
    return table


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def grams(text: str) -> np.ndarray:
    """64-bit names of all n-grams of a text, empty if it has no letter."""
    cp = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = cp == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a word stays
    cp = cp[keep]
    if not (cp != 32).any():
        return np.empty(0, np.uint64)
    if cp[-1] != 32:
        cp = np.append(cp, np.uint32(32))
    cp = np.concatenate([np.array([32], np.uint32), cp[int(cp[0] == 32):]]).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _MIX[2] + cp[k:len(cp) - n + 1 + k]
        out.append(_mixed(h))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def gram_counts(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts; counted per batch before the shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            by.setdefault(lang, []).append(grams(text))
        names, gram, n = [], [], []
        for lang, found in by.items():
            g, c = np.unique(np.concatenate(found), return_counts=True)
            names += [lang] * len(g)
            gram.append(g.view(np.int64))
            n.append(c.astype(np.int64))
        return pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate(gram)), pa.array(np.concatenate(n))],
                               names=["lang", "gram", "n"])

    counted = map_rows(df, "lang string, gram long, n long", kernel)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Bit-sliced filters: ``slots[word, i]`` has one bit per language."""

    def __init__(self, langs: list[str], slots: np.ndarray):
        self.langs, self.slots = langs, slots
        fill = [np.count_nonzero(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots.shape[1] for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def predict(self, text: str | None) -> tuple[str, float, float]:
        g = grams(text or "")
        if not len(g) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        at = [(g >> np.uint64(20 * k)).astype(np.int64) & (SLOTS - 1) for k in range(HASHES)]
        hits = np.empty(len(self.langs))
        for word in range(self.slots.shape[0]):
            sets = self.slots[word][at[0]]
            for a in at[1:]:
                sets &= self.slots[word][a]
            for i in range(64 * word, min(64 * word + 64, len(self.langs))):
                hits[i] = np.count_nonzero(sets & np.uint64(1 << (i % 64)))
        true = np.clip((hits - len(g) * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None)
        best = int(np.argmax(true))
        total = true.sum()
        return self.langs[best], float(true[best] / total) if total else 0.0, min(1.0, float(true[best] / len(g)))


def fit(labelled: DataFrame) -> Model:
    """Learn from (doc_id, text, lang); rows without lang or text are skipped."""
    rows = labelled.filter("lang is not null and text is not null")
    n = rows.count()
    sample = rows.filter(share_of(F.col("doc_id"), "language", min(1.0, TRAIN_ROWS / max(n, 1)))) if n > TRAIN_ROWS else rows
    counts = gram_counts(sample.select("lang", "text"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= FLOOR)
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    member = top.select("gram", F.expr(f"transform(filter(all, x -> x.rate >= {RELATIVE} * top), x -> x.lang)").alias("langs"))
    at = F.array(*[F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)])
    slot = member.select("gram", F.explode("langs").alias("lang")).select("lang", F.explode(at).alias("slot"))
    # at most SLOTS slots x languages, and at most 1 / FLOOR n-grams a language: bounded by parameters
    found = slot.distinct().toPandas()
    langs = sorted(found["lang"].unique().tolist())
    slots = np.zeros((len(langs) // 64 + 1, SLOTS), np.uint64)
    for i, lang in enumerate(langs):
        slots[i // 64][found.loc[found["lang"] == lang, "slot"].to_numpy(np.int64)] |= np.uint64(1 << (i % 64))
    return Model(langs, slots)


def identify(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, coverage) per row of ``df`` (needs ``text``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column(key), pa.array([g[0] for g in got], pa.string()),
                                pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                               names=[key, "lang_pred", "score", "coverage"])

    return map_rows(df.select(key, "text"), f"{key} {kind}, lang_pred string, score double, coverage double", kernel)


def keep_known(df: DataFrame, model: Model) -> DataFrame:
    """Rows of ``df``, with all columns, whose text is in a learned language.
    Rejected: ``und``, and texts of which the language covers under ``COVERED``.
    If no language could be learned, nothing can be rejected but ``und``'s
    reason itself: texts without a letter."""
    if not model.langs:
        return keep_rows(df, lambda text: len(grams(text or "")) > 0)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def good(text: str | None) -> bool:
        lang, _, coverage = shared.value.predict(text)
        return lang != UNKNOWN and coverage >= COVERED

    return keep_rows(df, good)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def forget() -> None:
    """Drop what a worker keeps between batches."""
    _letters.cache_clear()
