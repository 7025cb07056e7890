"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search runs over the boundaries of a text.  A boundary is reached by the
pieces that end there from boundaries reached before; only the last
``longest`` boundaries can start a further piece, so older ones matter only
through back pointers.  Whenever the back pointers of all boundaries in that
window meet in one boundary, everything before it is settled: its ids are
committed and forgotten.  Memory is bounded by the window and the stretch that
is still open, not by the text.

Path weights follow the model's kind.  Unigram: the sum of piece scores.  BPE:
a path is possible only if each two neighbouring pieces are what the model's
merges make of their joined characters; then exactly one path reaches a
boundary, and it is the ids that merging in order of score gives.  A character
outside the vocabulary becomes its UTF-8 bytes (byte pieces).

No piece holds ``SPACE`` after another character, nor a line feed, nor
punctuation after a letter, so all paths meet there; stretches between such
boundaries recur (words) and their ids are remembered.  Of a BPE model, stretches of
up to ``LONGEST_KNOWN`` characters are searched with the same rule over one table
of their boundaries; only longer ones commit ids before their end.  The vocabulary reaches the workers as one file's pieces
and scores, a fixed size.

Rows: null and empty texts have no ids and decode to the empty text; repeated
rows give equal ids; an empty table gives no rows; extra columns are not read.  Decoding gives the text back exactly, but for U+2581
itself, which the format reads as a space.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeweigh.llm.common import documents, map_rows, texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Known stretches per worker; beyond this only short ones are kept.
CACHE = 1 << 18
SHORT = 8
LONGEST_KNOWN = 64
_PUNCTUATION = string.punctuation


class Viterbi:
    """Streaming search over one vocabulary.  ``merges``: BPE rather than unigram."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], merges: bool = True):
        self.ids, self.scores, self.byte_ids, self.merges = pieces, scores, byte_ids, merges
        self.longest = max(map(len, pieces), default=1)
        # last three characters -> lengths of the pieces that may end there, longest first
        self.sizes: dict[str, tuple[int, ...]] = {}
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        for tail, found in lengths.items():
            self.sizes[tail] = (*sorted(found, reverse=True), *((2, 1) if tail[1:] in pieces else (1,)))
        self.worst = min(scores.values(), default=0.0) - 10.0
        self.fitting: dict[tuple[str, str], bool] = {}
        # longer pieces by score: the best is merged first
        self.rank = {p: k for k, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=lambda p: -scores.get(p, self.worst)), 1)}
        self.halves: dict[str, tuple[str, str] | None] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first, then leftmost: the rule itself, used on two joined pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) > CACHE:
                self.fitting.clear()
            known = self.fitting[left, right] = self.apart(left, right)
        return known

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece's last merge joined; none if merging never gives the piece."""
        if piece not in self.halves:
            cuts = [k for k in range(1, len(piece)) if self.merged(piece[:k]) == [piece[:k]] and self.merged(piece[k:]) == [piece[k:]]]
            whole = self.merged(piece) == [piece]
            # the last merge joined two parts that fit side by side up to then
            self.halves[piece] = next(((piece[:k], piece[k:]) for k in cuts if self.apart(piece[:k], piece[k:], self.rank[piece])), None) if whole else None
        return self.halves[piece]

    def apart(self, left: str, right: str, limit: float = float("inf")) -> bool:
        """Whether merging the joined text of two pieces gives these two (before the merge of rank ``limit``).

        Undoes the merges of both sides from the last to the first, always the later
        one.  Two neighbours at the seam stood side by side until the merge undone last;
        had their own merge come before it, the seam would be gone.  Of
        merges of one rank the left one comes first."""
        rank = self.rank
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if not a and not b:
                return len(left) == len(right) == 1
            if a > b:
                parts, limit = self.split(left), a
                if parts is None:
                    return False
                left = parts[1]
            else:
                parts, limit = self.split(right), b + 1
                if parts is None:
                    return False
                right = parts[0]

    def encode(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters, committed as soon as they are settled."""
        ids, scores, sizes, longest = self.ids, self.scores, self.sizes, self.longest
        window = ""
        # boundary -> (weight, boundary before, piece between): the open stretch
        reached: dict[int, tuple[float, int, str]] = {0: (0.0, -1, "")}
        settled = end = 0
        for c in chars:
            end += 1
            window = (window + c)[-longest:]
            best: tuple[float, int, str] | None = None
            for size in sizes.get(window[-3:]) or ((2, 1) if window[-2:] in ids else (1,)):
                piece = window[-size:]
                if size > 1 and piece not in ids:
                    continue
                before = reached.get(end - size)
                if before is None:
                    continue
                if self.merges:
                    if not before[2] or self.fits(before[2], piece):
                        best = (0.0, end - size, piece)
                        break
                else:
                    weight = before[0] + scores.get(piece, self.worst)
                    if best is None or weight > best[0]:
                        best = (weight, end - size, piece)
            if best is not None:
                reached[end] = best
            if end - settled >= 4 * longest:
                meet = self._meeting(reached, end)
                if meet > settled:
                    yield from self._path(reached, settled, meet)
                    reached = {b: x for b, x in reached.items() if b >= meet}
                    settled = meet
        yield from self._path(reached, settled, end)

    def encode_short(self, text: str) -> list[int]:
        """The same search where the whole text is one window (BPE only)."""
        ids, sizes, fitting = self.ids, self.sizes, self.fitting
        ending: list[str | None] = [""] + [None] * len(text)  # the piece that ends at each boundary
        for end in range(1, len(text) + 1):
            tail = text[end - 3:end] if end > 3 else text[:end]
            for size in sizes.get(tail) or ((2, 1) if text[max(0, end - 2):end] in ids else (1,)):
                start = end - size
                if start < 0:
                    continue
                left, piece = ending[start], text[start:end]
                if left is None or (size > 1 and piece not in ids):
                    continue
                fits = not left or fitting.get((left, piece))
                if fits is None:
                    fits = self.fits(left, piece)
                if fits:
                    ending[end] = piece
                    break
        out, end = [], len(text)
        while end:
            piece = ending[end]
            out.append(piece)
            end -= len(piece)
        return [i for piece in reversed(out) for i in self._piece_ids(piece)]

    def _meeting(self, reached: dict[int, tuple[float, int, str]], end: int) -> int:
        """The last boundary that all paths into the window share."""
        live = {b for b in range(max(0, end - self.longest), end + 1) if b in reached}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(reached[last][1])
        return live.pop()

    def _path(self, reached: dict[int, tuple[float, int, str]], start: int, end: int) -> list[int]:
        path, at = [], end
        while at > start:
            _, at, piece = reached[at]
            path.append(piece)
        return [i for piece in reversed(path) for i in self._piece_ids(piece)]

    def _piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]


class Codec:
    """Texts to ids and back, for a model given as (piece, score, is_byte, is_plain) per id."""

    def __init__(self, table: list[tuple[str, float, bool, bool]], unigram: bool = False):
        plain = {p: i for i, (p, _, _, ok) in enumerate(table) if ok}
        byte_ids = [i for i, row in enumerate(table) if row[2]]
        self.search = Viterbi(plain, {p: table[i][1] for p, i in plain.items()}, byte_ids, merges=not unigram)
        # text of every id; bytes beyond ASCII stand as escapes until their run is complete
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.texts = [p if ok else chr(b if b < 128 else 0xDC00 + b) if (b := byte_of.get(i)) is not None else "" for i, (p, _, _, ok) in enumerate(table)]
        self.known: dict[str, bytes] = {}
        # all paths meet before SPACE, around a line feed, and between a word and
        # punctuation, unless a piece joins such characters (then not after that one)
        joined = {x for p in plain for x, y in zip(p, p[1:]) if y in _PUNCTUATION and x not in _PUNCTUATION + SPACE}
        marks, odd = re.escape(_PUNCTUATION), re.escape("".join(sorted(joined)))
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n{marks}{odd}]++(?=[{marks}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        stretches = self.stretch.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.known.get, stretches))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._stretch_ids(stretches[k])
        return b"".join(found)

    def _stretch_ids(self, stretch: str) -> bytes:
        ids = self.known.get(stretch)
        if ids is None:
            short = len(stretch) <= LONGEST_KNOWN
            ids = array("i", self.search.encode_short(stretch) if short and self.search.merges else self.search.encode(stretch)).tobytes()
            if short:
                if len(self.known) > CACHE:
                    self.known = {s: x for s, x in self.known.items() if len(s) <= SHORT}  # the common words
                self.known[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        if not text.isascii():
            raw = text.encode("utf-8", "surrogateescape")
            text = raw.decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:]


def model_table(path: str | None = None) -> list[tuple[str, float, bool, bool]]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    return [(m.id_to_piece(i), m.get_score(i), m.is_byte(i), not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
            for i in range(m.vocab_size())]


_CODECS: dict[int, Codec] = {}


def _codec(table: list, unigram: bool) -> Codec:
    key = id(table)  # a broadcast value lives as long as its worker
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(table, unigram)
    return _CODECS[key]


def encode(df: DataFrame, model_path: str | None = None, unigram: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) per row of ``df``: ids and the text they decode to.
    ``unigram`` names the kind of the model, which its pieces do not show."""
    shared = df.sparkSession.sparkContext.broadcast(model_table(model_path))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, unigram)
        packed = [codec.packed(t) for t in texts(batch)]
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        decoded = [codec.decode(array("i", p)) for p in packed]
        return pa.record_batch([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_rows(df.select("doc_id", "text"), "doc_id long, ids array<int>, decoded string", kernel)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).selectExpr("doc_id", "cast(size(ids) as bigint) n_tokens", "ids", "decoded")


def forget() -> None:
    """Drop what a worker keeps between batches."""
    _CODECS.clear()
