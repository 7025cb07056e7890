"""Token ids in binary files of directly addressable codes (DACs).

A segment holds whole documents in ascending ``doc_id`` order, about
``SEGMENT_IDS`` ids (a longer document has a segment of its own).  Its ids are
split into chunks of ``CHUNK`` bits, lowest first: level 0 has one byte per
id, level ``k`` one byte for each id that needs more than ``k`` chunks.  Each
level has a bitmap that says which of its entries continue, and a rank
directory: the number of continuing entries before every block of ``BLOCK``
entries.  So the id at any position is read with one byte, one bit and one
small popcount per level, and no block is decoded.

Layout (little-endian): magic ``DAC1``, then int64s (documents, ids, levels,
start within the part, part, entries of each level), doc_ids int64, ids per
document int64, and per level: bytes, bitmap, rank directory int64.

``write_segments`` range-partitions by ``doc_id`` (texts move, once) and
writes one file per segment through Spark's own committer, so lost tasks leave
nothing behind and any file system that Spark reaches will do.  ``read_documents``
reads the files back.  Global starts need the ids per part: one row per part
reaches the driver.

Rows: null and empty texts have only the end id; repeated rows are written
each; equal ``doc_id`` rows are ordered by text, rows without one come first.
An empty table gives no file
and an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweigh.llm.common import documents, slices
from codeweigh.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END = 1
CHUNK = 8
BLOCK = 512
SEGMENT_IDS = 1 << 20
MAGIC = b"DAC1"
HEAD = 4 + 5 * 8
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)
#: Known pieces of text per worker; beyond this only short ones are kept.
CACHE = 1 << 20
SHORT = 8
LOT = 250
#: Bytes of text whose pieces are looked up together.
LOOKED_UP = 8 << 20


# ---------------------------------------------------------------- format


def pack(doc_ids: list[int], sizes: list[int], ids: np.ndarray, part: int, start: int) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK)
        going = more > 0
        counts = np.add.reduceat(going, np.arange(0, len(going), BLOCK)) if len(going) else np.empty(0, np.int64)
        rank = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<i8") if len(going) else np.empty(0, "<i8")
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), np.packbits(going, bitorder="little").tobytes(), rank.tobytes()))
        if not going.any():
            break
        rest = more[going]
    head = np.array([len(doc_ids), len(ids), len(levels), start, part, *(n for n, *_ in levels)], "<i8").tobytes()
    return b"".join([MAGIC, head, np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), *(b for _, *bs in levels for b in bs)])


class Segment:
    """A packed segment; ``segment[i]`` reads one id, ``all()`` every id."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = 4
        docs, self.ids, n_levels, self.start, self.part = (int(x) for x in np.frombuffer(blob, "<i8", 5, at))
        at += 40
        entries = np.frombuffer(blob, "<i8", n_levels, at)
        at += 8 * n_levels
        self.doc_ids = np.frombuffer(blob, "<i8", docs, at)
        at += 8 * docs
        self.sizes = np.frombuffer(blob, "<i8", docs, at)
        at += 8 * docs
        self.levels = []
        for n in entries.tolist():
            level = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            blocks = (n + BLOCK - 1) // BLOCK
            self.levels.append((level, bits, np.frombuffer(blob, "<i8", blocks, at)))
            at += 8 * blocks

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, bits, rank in self.levels:
            value |= int(level[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8:i // 8 + 1], bitorder="little")[:i - block * BLOCK]
            i = int(rank[block]) + int(before.sum())
            shift += CHUNK
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.ids, np.uint32)
        where = np.arange(self.ids)
        for k, (level, bits, _) in enumerate(self.levels):
            out[where] |= level.astype(np.uint32) << np.uint32(CHUNK * k)
            where = where[np.unpackbits(bits, count=len(level), bitorder="little").astype(bool)]
        return out


# ---------------------------------------------------------------- encoding


class Encoder:
    """Whole texts to ids.  Blanks and line feeds never lie inside a token, so
    a text is encoded as the pieces between them, and known pieces are reused:
    the distinct pieces of some texts are looked up once each, and their ids
    put in every place by array passes.
    The tokenizer also parts a letter or digit from punctuation after it, and
    lower-cases, so an unknown piece is looked up without both first."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[str, bytes] = {"": b""}
        ending, words = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)  # tokens that end a word
        self.last[[i for w, i in words.items() if ending and w.endswith(ending)]] = True

    def _ask(self, pieces: list[str]) -> None:
        """Encode unknown pieces with the library.  Plain words go in lots; the
        last token of a word, and no other, bears the vocabulary's word end."""
        known, plain = self.known, [p for p in pieces if p.isalpha() and (p.isascii() or max(p) < _LATIN and _DOTTED not in p)]
        for at in range(0, len(plain), LOT):
            lot = plain[at:at + LOT]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(lot)], add_special_tokens=False)[0].ids, np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(lot):  # another vocabulary: one by one, below
                continue
            data = ids.tobytes()
            for p, a, b in zip(lot, [0, *ends[:-1]], ends):
                known[p] = data[a:b]
        other = [p for p in pieces if p not in known]
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            known[p] = array("I", e.ids).tobytes()

    def __call__(self, found: list[str] | pa.Array) -> list[np.ndarray]:
        if not len(found):
            return []
        if len(self.known) > CACHE:
            self.known = {p: x for p, x in self.known.items() if len(p) <= SHORT}  # the common words
        known = self.known
        found = found if isinstance(found, pa.Array) else pa.array(found, pa.string())
        rows = pc.split_pattern(pc.replace_substring(found, "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # each distinct piece once
        blobs = [*map(known.get, pieces), _END]
        new = [i for i, x in enumerate(blobs) if x is None]
        if new:
            cut = [_parts(pieces[i]) for i in new]
            self._ask([x for x in set(chain.from_iterable(cut)) if x not in known])
            for i, parts in zip(new, cut):
                blobs[i] = known[pieces[i]] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])
        ids, size = np.frombuffer(b"".join(blobs), np.uint32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ends = rows.offsets.to_numpy()[1:] - rows.offsets[0].as_py()
        order = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(pieces))  # after each text the end
        count = size[order]
        last = np.cumsum(count)
        out = ids[np.repeat((np.cumsum(size) - size)[order] - (last - count), count) + np.arange(last[-1])]
        return np.split(out, last[ends + np.arange(len(ends))][:-1])


_END = array("I", [END]).tobytes()
#: Below are Latin letters: composed, with one rule for lower case.
_LATIN = "\u0250"
#: The one letter below whose lower case has two code points: its pieces go to the library whole.
_DOTTED = "\u0130"
#: Punctuation that ends a word; not the quote of contractions nor the signs of special tokens.
_AFTER = '.,;:!?%$&*#"'


def _parts(piece: str) -> tuple[str, ...]:
    if piece.isascii() and piece.isalpha():  # most pieces
        return (piece.lower(),)
    word = piece.rstrip(_AFTER)
    if not word or not word[-1].isalnum() or "<|" in word or _DOTTED in word:
        return (piece,)
    low = word.lower() if max(word) < _LATIN else word
    return (low,) if len(word) == len(piece) else (low, piece[len(word):])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(vocabulary.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


# ---------------------------------------------------------------- Spark jobs


def write_segments(df: DataFrame, path: str, vocabulary_path: str | None = None) -> None:
    """Encode (doc_id, text) and write the segments under ``path``."""
    with open(vocabulary_path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode = TaskContext.get().partitionId(), 0, _encoder(shared.value)
        doc_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            blob = pack(doc_ids, [len(x) for x in held], np.concatenate(held), part, start)
            return pa.record_batch([pa.array([blob], pa.binary())], names=["segment"])

        for batch in batches:
            for piece in slices(batch, LOOKED_UP):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encode(pc.fill_null(piece.column("text"), ""))):
                    if doc_ids and size + len(ids) > SEGMENT_IDS:
                        yield flush()
                        start += size
                        doc_ids, held, size = [], [], 0
                    doc_ids.append(NO_ID if doc_id is None else doc_id)
                    held.append(ids)
                    size += len(ids)
        if doc_ids:
            yield flush()

    ordered = df.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # the text writer puts a row's bytes down as they are; one row per file, and one line feed after the segment
    ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option(
        "pathGlobFilter", "part-*").load(path).select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files."""

    def heads(batches):
        for batch in batches:
            found = [np.frombuffer(b, "<i8", 5, 4).tolist() for b in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([h[4] for h in found], pa.int64()), pa.array([h[1] for h in found], pa.int64())], names=["part", "n"])

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                s = Segment(blob)
                ids, ends = s.all().astype("<u4"), np.cumsum(s.sizes)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for n, e in zip(s.sizes.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(s.doc_ids, pa.int64()), pa.array(np.full(len(crc), s.part), pa.int64()), pa.array(s.start + ends - s.sizes, pa.int64()),
                                       pa.array(s.sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    segments = _segments(spark, path)
    per_part = segments.select(F.substring("content", 1, HEAD).alias("content")).mapInArrow(heads, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    before = per_part.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row per part
    rows = segments.mapInArrow(run, "doc_id long, part long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_segments(documents(spark, sf_dir), path)
    return read_documents(spark, path)


def forget() -> None:
    """Drop what a worker keeps between batches."""
    _ENCODERS.clear()
