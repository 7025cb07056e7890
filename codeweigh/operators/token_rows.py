"""Token rows: vocabulary, ids, slicing, decoding, padding (K1-K9).

The subword tokenizer of the original workflow needs downloaded files; here
ids come from a corpus vocabulary of lexemes: the ``vocab_size`` most frequent
lexemes of at most ``LONGEST_ENTRY`` bytes, ranked by count then text.  Every
other lexeme is written as its UTF-8 bytes (256 reserved ids), so nothing is
lost: ``decode(tokenize(text)) == text``.

Ids: ``0 .. vocab_size - 1`` lexemes, ``vocab_size + b`` byte ``b``,
``vocab_size + 256`` ``<eos>`` (used for padding, like the original pad = end
token).

The vocabulary is counted per Arrow batch before the shuffle.  It is a
parameter-bounded table (``vocab_size`` rows of ``LONGEST_ENTRY`` bytes), so it
is always broadcast; encoding and decoding are map-only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexing as L
from ..functions import stretches as S

DEFAULT_VOCAB = 50000
LONGEST_ENTRY = 64


def eos_id(vocab_size: int) -> int:
    return int(vocab_size) + 256


def lex_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, lexemes)``, lazily: lexing twice is cheaper than storing lexemes."""
    return df.select(key, L.py_lexemes(text).alias("lexemes"))


def lex_stretches(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, lexemes)`` with stretches of plain words left whole, for the vocabulary and the ids
    (``stretched=True``): the same result, fewer strings made and moved."""
    return df.select(key, L.py_stretches(text).alias("lexemes"))


def _count_stretches(batches):
    """``mapInArrow`` body: :func:`_count_lexemes` of a column of stretches."""
    for b in batches:
        yield from S.count(b.column(0)).combine_chunks().to_batches()


def _count_lexemes(batches):
    """``mapInArrow`` body: distinct lexemes of each batch with their counts."""
    for b in batches:
        col = b.column(0)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        vc = pc.value_counts(col.flatten())
        yield pa.RecordBatch.from_arrays([vc.field("values"), vc.field("counts")], names=["lexeme", "n"])


def vocab_from_lexemes(lexed: DataFrame, lexemes: str, vocab_size: int = DEFAULT_VOCAB, stretched: bool = False) -> DataFrame:
    """Vocabulary from a lexeme-array column (``stretched``: of :func:`lex_stretches`).  Each Arrow
    batch is counted in its worker first, so only distinct lexemes per batch reach the shuffle and
    a very frequent lexeme never piles up in one task."""
    partial = lexed.select(lexemes).mapInArrow(_count_stretches if stretched else _count_lexemes, "lexeme string, n bigint")
    short = partial.where(F.octet_length("lexeme") <= LONGEST_ENTRY)
    counts = short.groupBy("lexeme").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("lexeme")).limit(int(vocab_size))
    # numbering at most vocab_size rows: bounded, one small task
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("lexeme"))) - 1
    return top.select("lexeme", rank.cast("int").alias("id"))


def tokenize_ids(df: DataFrame, key: str, text: str, vocab: DataFrame, vocab_size: int,
                 max_length: int | None = None) -> DataFrame:
    """K1 (+K2): ``(key, input_ids)``; null text gives null ids."""
    return tokenize_lexemes(lex_stretches(df, key, text), key, "lexemes", vocab, vocab_size, max_length, stretched=True)


_SETS: dict = {}


def _worker_table(bc, make):
    """What ``make`` builds from a broadcast value, once per worker."""
    key = (id(bc.value), make.__name__)
    if key not in _SETS:
        _SETS.clear()
        _SETS[key] = make(bc.value)
    return _SETS[key]


def _value_set(words):
    return pa.array(words, pa.string())


def tokenize_lexemes(lexed: DataFrame, key: str, lexemes: str, vocab: DataFrame, vocab_size: int,
                     max_length: int | None = None, stretched: bool = False) -> DataFrame:
    """K1 from a lexeme-array column: one vectorized hash lookup per Arrow
    batch (``index_in``; position = id); what it misses becomes bytes.  Of ``stretched`` lexemes
    (:func:`lex_stretches`) each distinct word of a piece of the batch is looked up once."""
    words = [r["lexeme"] for r in vocab.orderBy("id").limit(int(vocab_size)).collect()]
    bc = lexed.sparkSession.sparkContext.broadcast(words)
    first_byte = int(vocab_size)

    def look_up(flat: pa.Array):
        """The ids of some lexemes, in order, and where those of each begin (and all end)."""
        ids = pc.fill_null(pc.index_in(flat, value_set=_worker_table(bc, _value_set)), -1)
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int32)
        missing = np.flatnonzero(ids < 0)
        raw = flat.take(pa.array(missing)).cast(pa.binary())
        size = np.ones(len(ids), np.int64)
        size[missing] = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.int32)
        out[out < 0] = data + first_byte
        return out, ends

    def ids_of(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten()
        offsets = arrays.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        if stretched:
            parts, before = S.cut(flat)
            coded = parts.dictionary_encode()
            lexemes_, many = S.lexemes_of(coded.dictionary)
            known, starts = look_up(lexemes_)
            starts = starts[np.concatenate(([0], np.cumsum(many)))]
            word = coded.indices.to_numpy(zero_copy_only=False)
            size = np.diff(starts)[word]
            ends = np.concatenate(([0], np.cumsum(size)))
            out = known[np.repeat(starts[word] - ends[:-1], size) + np.arange(ends[-1])]
            offsets = before[offsets]
        else:
            out, ends = look_up(flat)
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(out), mask=arrays.is_null())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(arrays: pa.Array) -> pa.Array:
        if isinstance(arrays, pa.ChunkedArray):
            arrays = arrays.combine_chunks()
        if not stretched:
            return ids_of(arrays)
        return pa.concat_arrays([ids_of(piece) for piece in S.text_pieces(arrays)] or [ids_of(arrays)])

    ids = lexed.select(key, encode(F.col(lexemes)).alias("input_ids"))
    return ids if max_length is None else ids.withColumn("input_ids", truncate("input_ids", max_length))


def truncate(ids, max_length: int):
    """K2: keep the first ``max_length`` ids."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(ids, 1, int(max_length))


def max_input_length(context_size: int, max_new_tokens: int) -> int:
    """K3: room left for the prompt = context size - tokens to generate."""
    if max_new_tokens >= context_size:
        raise ValueError("max_new_tokens must be smaller than the context size")
    return int(context_size) - int(max_new_tokens)


def prompt_half_split(ids):
    """K4: ``k = n // 2``; prompt = ``ids[:-k]`` (empty when k is 0, as in Python)."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(ids)
    keep = F.when(n >= 2, n - F.floor(n / 2).cast("int")).otherwise(0)
    return F.slice(ids, 1, keep)


def response_tail(ids, k: int):
    """K5: ``ids[-k:]`` (Python semantics: all ids when fewer than k)."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - int(k) + 1), int(k))


def decode(df: DataFrame, ids: str, vocab: DataFrame, vocab_size: int, out: str = "decoded") -> DataFrame:
    """K6: ids back to text in position order.  Bytes that are no UTF-8 (a cut
    through a character) become U+FFFD; null ids give null."""
    words = [r["lexeme"] for r in vocab.orderBy("id").limit(int(vocab_size)).collect()]
    bc = df.sparkSession.sparkContext.broadcast(words)
    size = int(vocab_size)

    def _pieces(words):
        table = {i: w.encode() for i, w in enumerate(words)}
        table.update((size + b, bytes([b])) for b in range(256))
        table[eos_id(size)] = b"<eos>"
        return table

    @F.arrow_udf(T.StringType())
    def text(arrays: pa.Array) -> pa.Array:
        table = _worker_table(bc, _pieces)
        return pa.array([None if row is None else b"".join([table[i] for i in row]).decode("utf-8", "replace")
                         for row in arrays.to_pylist()], pa.string())

    return df.withColumn(out, text(F.col(ids)))


def left_pad(ids, width: int, pad_id: int):
    """K7: pad on the left with ``pad_id`` up to ``width`` (longer rows unchanged)."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array_repeat(F.lit(int(pad_id)), F.greatest(F.lit(0), int(width) - F.size(ids))), ids)


def argmax(v):
    """K8: 0-based index of the largest value (first one on ties)."""
    v = F.col(v) if isinstance(v, str) else v
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")


def shifted_matches(preds, labels):
    """K9 helper: ``(matches, compared)`` of ``preds[i] == labels[i+1]``."""
    preds = F.col(preds) if isinstance(preds, str) else preds
    labels = F.col(labels) if isinstance(labels, str) else labels
    m = F.least(F.size(preds), F.size(labels)) - 1
    p = F.slice(preds, 1, F.greatest(m, F.lit(0)))
    lab = F.slice(labels, 2, F.greatest(m, F.lit(0)))
    eq = F.zip_with(p, lab, lambda a, b: (a == b).cast("int"))
    return F.aggregate(eq, F.lit(0), lambda acc, x: acc + x), F.greatest(m, F.lit(0))


def shifted_accuracy(df: DataFrame, preds: str, labels: str) -> DataFrame:
    """K9: share of positions where ``preds[i] == labels[i+1]`` (one row)."""
    hit, total = shifted_matches(preds, labels)
    per = df.select(hit.alias("_hit"), total.alias("_n"))
    return per.agg(F.sum("_hit").cast("bigint").alias("matches"),
                   F.sum("_n").cast("bigint").alias("compared"),
                   F.round(F.try_divide(F.sum("_hit").cast("double"), F.sum("_n")), 6).alias("accuracy"))
