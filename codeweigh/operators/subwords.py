"""A subword vocabulary learned from the corpus: byte-pair merges (K1).

Words are the lexemes of the corpus, cut into pieces of at most ``PIECE``
characters; their symbols are at first the bytes of their UTF-8 form (ids 0-255).
Each merge joins the most frequent pair of neighbouring symbols (ties: the smallest
pair) into symbol ``256 + rank``; pairs are counted at every place, times the word's count.

A round of :func:`train` takes the best ``ahead`` pairs and, of every word, the stretches that
hang together by them (its contexts).  A pair that is made later counts no more than the pairs
it came from, so the contexts alone tell all merges that come before the last of these pairs:
:func:`learn` finds them one after the other, as if all words were there.  Distinct contexts are added up
before they reach the driver; ``ahead`` follows their number, which is bounded by ``CONTEXTS``.
Where they are more, the round takes the pairs that need no contexts (:func:`safe_prefix`).  So tens of thousands
of merges take some dozens of rounds.  The words are read twice a round, by maps over Arrow batches that
apply the merges not yet written; every ``ROUNDS`` rounds the merged symbols are written
anew.  What is stored is no larger than the words.  The driver holds the merges, the
best ``MOST_AHEAD`` pairs and the contexts, sizes bounded by parameters.

Encoding is map-only: the merges are broadcast (bounded by ``merges``) and
applied to the distinct lexemes of a piece of a batch, by passes over arrays: one for each
merge while they are few, else each pass joins in every word the earliest pair it holds.  ``decode(encode(text)) == text`` always,
for unseen texts too.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stretches
from ..functions.layout import in_pieces
from ..session import materialize
from .token_rows import _count_lexemes, _count_stretches

PIECE = 32
#: Best pairs looked at in the first round, and at most in any.
AHEAD = 64
MOST_AHEAD = 1 << 16
#: Distinct contexts that the driver takes in a round.
CONTEXTS = 1 << 17
#: Rounds between two writes of the words' symbols.
ROUNDS = 4
#: Up to so many merges are applied as passes over whole arrays, one for each.
FEW_MERGES = 512
#: Distinct lexemes encoded together.
TOGETHER = 1 << 15
#: Lexemes whose ids a worker remembers.
REMEMBERED = 1 << 16
_CUT = rf"[\s\S]{{1,{PIECE}}}"

Pair = tuple[int, int]


def count_words(lexed: DataFrame, lexemes: str, stretched: bool = False) -> DataFrame:
    """(word, n): distinct pieces of a lexeme-array column (``stretched``: with runs of plain words
    left whole, :mod:`..functions.stretches`).  Lexemes are counted per Arrow batch before the shuffle, then cut."""
    partial = lexed.select(lexemes).mapInArrow(_count_stretches if stretched else _count_lexemes, "lexeme string, n bigint")
    whole = partial.where("lexeme is not null").groupBy("lexeme").agg(F.sum("n").alias("n"))
    pieces = whole.select(F.explode(F.regexp_extract_all("lexeme", F.lit(_CUT), 0)).alias("word"), "n")
    return pieces.groupBy("word").agg(F.sum("n").alias("n"))


def safe_prefix(best: list[tuple[int, int, int]], complete: bool) -> list[Pair]:
    """How many of the best pairs (left, right, count; in order) can be merged at once.

    Merging (a, b) changes only counts of pairs that end in ``a`` or begin with ``b``,
    and a new pair counts at most as often as such a pair did.  So the next best
    pair stays the next best as long as no pair of its count or more ends in
    a left symbol, or begins with a right symbol, of a pair merged before.  The
    first pair is always right.  ``complete``: no pair is left behind the list."""
    lefts, rights, taken, at = set(), set(), 0, 0
    while at < len(best):
        end = at
        while end < len(best) and best[end][2] == best[at][2]:
            end += 1
        if end == len(best) and not complete:
            break  # the list may cut a group of ties
        lefts |= {p[0] for p in best[at:end]}
        rights |= {p[1] for p in best[at:end]}
        if lefts & rights:
            break
        taken = at = end
    return [(a, b) for a, b, _ in best[:max(taken, 1)]]


def join_pairs(symbols: list[int], ranks: dict[Pair, int], pairs: list[Pair]) -> list[int]:
    """Merge ``pairs`` one after the other, each from left to right."""
    for pair in pairs:
        out, at = [], 0
        while at < len(symbols):
            if at + 1 < len(symbols) and (symbols[at], symbols[at + 1]) == pair:
                out.append(256 + ranks[pair])
                at += 2
            else:
                out.append(symbols[at])
                at += 1
        symbols = out
    return symbols


def merge_pair(symbols: np.ndarray, owner: np.ndarray, pair: Pair, new: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`join_pairs` of one pair for many words at once: ``owner`` tells whose symbol each is."""
    hit = np.flatnonzero((symbols[:-1] == pair[0]) & (symbols[1:] == pair[1]) & (owner[1:] == owner[:-1]))
    if not hit.size:
        return symbols, owner
    if pair[0] == pair[1]:  # of overlapping places every other one, from the left
        first = np.concatenate(([True], np.diff(hit) != 1))
        hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
    keep = np.ones(len(symbols), dtype=bool)
    keep[hit + 1] = False
    symbols = symbols.copy()
    symbols[hit] = new
    return symbols[keep], owner[keep]


Ranked = tuple[np.ndarray, np.ndarray]


def ranked(merges: list[Pair], first: int = 0) -> Ranked:
    """Pairs as codes in ascending order, and the symbol that each becomes."""
    codes = np.array([a << 32 | b for a, b in merges], np.int64)
    order = np.argsort(codes)
    return codes[order], (256 + first + order).astype(np.int32)


def _which(left: np.ndarray, right: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of the pairs these symbols are, -1 if none."""
    if not len(codes):
        return np.full(len(left), -1)
    pairs = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
    return np.where(codes[at] == pairs, at, -1)


def merge_ranked(symbols: np.ndarray, owner: np.ndarray, table: Ranked) -> tuple[np.ndarray, np.ndarray]:
    """:func:`join_pairs` of all pairs of ``table`` for many words: a pass joins in each word the
    earliest pair it holds, and looks up only the pairs that this makes; words that hold none are done."""
    codes, becomes = table
    none = np.iinfo(np.int32).max
    new = np.full(len(symbols), none, np.int32)  # what each symbol becomes with the next

    def look(at: np.ndarray) -> None:
        which = _which(symbols[at], symbols[at + 1], codes)
        there = (which >= 0) & (owner[at] == owner[at + 1])
        new[at[there]] = becomes[which[there]]

    look(np.arange(len(symbols) - 1))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # symbols, their words, their places in these
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(starts, append=len(owner))
        least = np.minimum.reduceat(new, starts)
        live = np.repeat(least < none, sizes)
        place = np.arange(len(owner)) - np.repeat(starts, sizes)
        done.append((symbols[~live], owner[~live], place[~live]))
        symbols, owner, new, least = symbols[live], owner[live], new[live], np.repeat(least, sizes)[live]
        hit = np.flatnonzero(new == least)
        if not hit.size:
            break
        first = np.concatenate(([True], np.diff(hit) != 1))  # of overlapping places every other one, from the left
        hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        symbols[hit] = new[hit]
        symbols, owner, new = symbols[keep], owner[keep], new[keep]
        at = hit - np.arange(len(hit))
        at = np.concatenate((at[at > 0] - 1, at))
        new[at] = none
        look(at[at + 1 < len(symbols)])
    if not done:
        return symbols, owner
    symbols, owner, place = (np.concatenate(x) for x in zip(*done))
    sizes = np.bincount(owner)
    out = np.empty_like(symbols)
    out[(np.cumsum(sizes) - sizes)[owner] + place] = symbols
    return out, np.repeat(np.arange(len(sizes)), sizes)


def _merged(lists: pa.Array, pending: Ranked) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a list array after the merges, and the row of each."""
    symbols = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return merge_ranked(symbols, owner, pending) if len(pending[0]) else (symbols, owner)


def _lists(symbols: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(symbols.astype(np.int32)))


def _count_pairs(now: DataFrame, pending: Ranked) -> DataFrame:
    """(left, right, n) of the words' pairs after the pending merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, owner = _merged(batch.column("symbols"), pending)
            at = np.flatnonzero(owner[1:] == owner[:-1])
            codes, of = np.unique((symbols[at].astype(np.int64) << 32) | symbols[at + 1], return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, of, batch.column("n").to_numpy(zero_copy_only=False)[owner[at]])
            yield pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["left", "right", "n"])

    return now.mapInArrow(run, "left int, right int, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _contexts(now: DataFrame, pending: Ranked, best: list[Pair]) -> DataFrame:
    """(context, n): the longest stretches of the words after the pending merges in which every
    two neighbours are one of the pairs; symbols as 4 bytes each."""
    codes, _ = ranked(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, owner = _merged(batch.column("symbols"), pending)
            hit = np.flatnonzero((_which(symbols[:-1], symbols[1:], codes) >= 0) & (owner[1:] == owner[:-1]))
            inside = np.zeros(len(symbols), dtype=bool)
            inside[hit] = inside[hit + 1] = True
            follows = np.zeros(len(symbols), dtype=bool)
            follows[hit + 1] = True
            starts = np.flatnonzero(~follows[inside])
            ends = np.append(starts, np.count_nonzero(inside)) * 4
            data = symbols[inside].astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            n = pa.array(batch.column("n").to_numpy(zero_copy_only=False)[owner[inside][starts]], pa.int64())
            whole = pa.table([found, n], names=["context", "n"]).group_by("context").aggregate([("n", "sum")])
            yield from whole.rename_columns({"n_sum": "n"}).select(["context", "n"]).to_batches()

    return now.mapInArrow(run, "context binary, n bigint").groupBy("context").agg(F.sum("n").alias("n"))


def _write_merged(now: DataFrame, pending: Ranked) -> DataFrame:
    """The words after the pending merges; those of one symbol have no pairs any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _lists(*_merged(batch.column("symbols"), pending), batch.num_rows)
            out = pa.RecordBatch.from_arrays([batch.column("n"), lists], names=["n", "symbols"])
            yield out.filter(pc.greater(pc.list_value_length(lists), 1))

    return materialize(now.mapInArrow(run, now.schema))


def learn(contexts: list[tuple[list[int], int]], last: tuple[int, int, int] | None, first: int, most: int, least: int = 2) -> list[Pair]:
    """The merges from number ``first`` on, ``most`` at most, that come no later than ``last`` (minus
    its count, left, right; None: all that occur ``least`` times), from contexts and their counts."""
    counts: dict[Pair, int] = defaultdict(int)
    where: dict[Pair, set[int]] = defaultdict(set)
    words = [w for w, _ in contexts]
    for k, (w, n) in enumerate(contexts):
        for p in zip(w, w[1:]):
            counts[p] += n
            where[p].add(k)
    heap = [(-n, *p) for p, n in counts.items() if n >= least]
    heapq.heapify(heap)
    learned: list[Pair] = []
    while heap and len(learned) < most:
        key = heapq.heappop(heap)
        if last is not None and key > last:
            break
        pair = key[1:]
        if counts.get(pair) != -key[0]:  # it has changed since
            continue
        ranks, changed = {pair: first + len(learned)}, set()
        learned.append(pair)
        for k in where.pop(pair):
            old, n = words[k], contexts[k][1]
            new = words[k] = join_pairs(old, ranks, [pair])
            if len(new) < len(old):
                for p in zip(old, old[1:]):
                    counts[p] -= n
                    changed.add(p)
                for p in zip(new, new[1:]):
                    counts[p] += n
                    where[p].add(k)
                    changed.add(p)
        for p in changed - {pair}:
            if counts[p] >= least:
                heapq.heappush(heap, (-counts[p], *p))
        del counts[pair]
    return learned


def train(words: DataFrame, merges: int, least: int = 2) -> list[Pair]:
    """The first ``merges`` merges of (word, n); fewer if no pair occurs ``least`` times any more."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def as_bytes(word: pa.Array) -> pa.Array:
        symbols, owner = _bytes(word)
        return _lists(symbols, owner, len(word))

    now = materialize(words.select("n", as_bytes("word").alias("symbols")))
    learned: list[Pair] = []
    written, rounds, ahead = 0, 0, AHEAD
    while len(learned) < merges:
        pending = ranked(learned[written:], written)
        counts = _count_pairs(now, pending)
        best = [tuple(r) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(ahead).collect()]
        if not best:
            break
        complete = len(best) < ahead
        found = _contexts(now, pending, [(a, b) for a, b, _ in best]).limit(CONTEXTS + 1).toArrow()
        if found.num_rows > CONTEXTS:
            learned += safe_prefix(best, complete)[:merges - len(learned)]
            ahead = max(ahead // 2, 1)
        else:
            contexts = [(np.frombuffer(c, np.int32).tolist(), n) for c, n in zip(found["context"].to_pylist(), found["n"].to_pylist())]
            a, b, n = best[-1]
            learned += learn(contexts, None if complete else (-n, a, b), len(learned), merges - len(learned), least)
            if 3 * found.num_rows <= CONTEXTS:
                ahead = min(2 * ahead, MOST_AHEAD)
        rounds += 1
        if rounds % ROUNDS == 0 and len(learned) < merges:
            now, written = _write_merged(now, ranked(learned[written:], written)), len(learned)
    return learned


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words' UTF-8 form, and the word of each."""
    raw = pc.fill_null(words.cast(pa.binary()), b"")
    _, offsets, data = raw.buffers()
    if not len(raw) or data is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, np.int32)[raw.offset:raw.offset + len(raw) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.int32), np.repeat(np.arange(len(raw)), np.diff(ends))


def encode_words(words: pa.Array, merges: list[Pair], table: Ranked | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many lexemes, one after the other, and how many each has.  An earlier merge
    finds no new places in what later ones made, so one pass for each merge does.
    ``table``: :func:`ranked` of the merges, if at hand."""
    symbols, word = _bytes(words)
    begins = np.cumsum((symbols & 0xC0) != 0x80)  # characters up to here
    first = np.concatenate(([True], word[1:] != word[:-1])) if word.size else np.zeros(0, dtype=bool)
    place = begins - begins[first][np.cumsum(first) - 1] if word.size else begins
    cut = first | ((place % PIECE == 0) & ((symbols & 0xC0) != 0x80))
    piece = np.cumsum(cut) - 1
    of = word[cut]
    if len(merges) <= FEW_MERGES:
        for k, pair in enumerate(merges):
            symbols, piece = merge_pair(symbols, piece, pair, 256 + k)
    else:
        symbols, piece = merge_ranked(symbols, piece, table or ranked(merges))
    return symbols, np.bincount(of[piece], minlength=len(words))


class Encoder:
    """Applies merges to lexemes, the earliest learned first; remembers common ones."""

    def __init__(self, merges: list[Pair]):
        self.ranks = {tuple(p): k for k, p in enumerate(merges)}
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        symbols = list(text.encode())
        while len(symbols) > 1:
            pair = min(zip(symbols, symbols[1:]), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if pair not in self.ranks:
                break
            symbols = join_pairs(symbols, self.ranks, [pair])
        return symbols

    def lexeme(self, text: str) -> list[int]:
        found = self.known.get(text)
        if found is None:
            found = [i for at in range(0, len(text), PIECE) for i in self.piece(text[at:at + PIECE])]
            if len(text) <= PIECE:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = found
        return found


_MADE: dict = {}


def _of_worker(merges, make):
    """What ``make`` makes of the merges, once per worker for the vocabulary in use."""
    if make not in _MADE or _MADE[make][0] is not merges.value:
        _MADE[make] = merges.value, make(merges.value)
    return _MADE[make][1]


def encode(lexed: DataFrame, key: str, lexemes: str, merges: list[Pair], stretched: bool = False) -> DataFrame:
    """``(key, input_ids)`` of a lexeme-array column (``stretched`` as for :func:`count_words`); null gives null."""
    shared = lexed.sparkSession.sparkContext.broadcast(list(merges))

    def some(arrays: pa.Array) -> pa.Array:
        parts, offsets = arrays.flatten(), arrays.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        if stretched:
            parts, before = stretches.cut(parts)
            offsets = before[offsets]
        coded = parts.dictionary_encode()  # each distinct part once
        words, many = stretches.lexemes_of(coded.dictionary) if stretched else (coded.dictionary, np.ones(len(coded.dictionary), np.int64))
        table = _of_worker(shared, ranked)
        found = [encode_words(words[k:k + TOGETHER], shared.value, table) for k in range(0, max(len(words), 1), TOGETHER)]
        ends = np.concatenate(([0], np.cumsum(np.concatenate([sizes for _, sizes in found]))))
        sizes = np.diff(ends[np.concatenate(([0], np.cumsum(many)))])
        out, ends = _taken(np.concatenate([flat.astype(np.int32) for flat, _ in found]), sizes, coded.indices.to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(out), mask=arrays.is_null())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(arrays: pa.Array) -> pa.Array:
        if not stretched:
            return in_pieces(arrays, some)
        return pa.concat_arrays([some(piece) for piece in stretches.text_pieces(arrays)] or [some(arrays)])

    return lexed.select(key, ids(F.col(lexemes)).alias("input_ids"))


def _taken(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` (of these sizes, one after the other in ``flat``) side by side, and where each begins and ends."""
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate(([0], np.cumsum(sizes[at]))).astype(np.int64)
    return flat[np.repeat(starts[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])], ends


def token_bytes(merges: list[Pair]) -> list[bytes]:
    """The bytes that each id stands for."""
    table = [bytes([b]) for b in range(256)]
    for a, b in merges:
        table.append(table[a] + table[b])
    return table


def _byte_table(merges: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`token_bytes` side by side, and how many each id has."""
    table = token_bytes(merges)
    return np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table], np.int64)


def decode(df: DataFrame, ids: str, merges: list[Pair], out: str = "decoded") -> DataFrame:
    """Ids back to text; bytes that are no UTF-8 become U+FFFD; null gives null."""
    shared = df.sparkSession.sparkContext.broadcast(list(merges))

    def some(arrays: pa.Array) -> pa.Array:
        data, ends = _taken(*_of_worker(shared, _byte_table), arrays.flatten().to_numpy(zero_copy_only=False))
        offsets = arrays.offsets.to_numpy(zero_copy_only=False)
        cuts = pa.py_buffer(ends[offsets - offsets[0]].astype(np.int32))
        there = pa.py_buffer(np.packbits(arrays.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
        raw = pa.Array.from_buffers(pa.binary(), len(arrays), [there, cuts, pa.py_buffer(data)])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    @F.arrow_udf(T.StringType())
    def text(arrays: pa.Array) -> pa.Array:
        return in_pieces(arrays, some)

    return df.withColumn(out, text(F.col(ids)))


def learned_table(spark, merges: list[Pair]) -> DataFrame:
    """(rank, left, right, token): the vocabulary as rows; ``token`` in hex."""
    table = token_bytes(merges)
    rows: Iterator = ((k, a, b, table[256 + k].hex()) for k, (a, b) in enumerate(merges))
    return spark.createDataFrame(list(rows), "rank int, left int, right int, token string")
