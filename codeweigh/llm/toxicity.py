"""Toxicity: noisy-channel deobfuscation, then a learned lexicon.

Restoring: a token written with digits or signs for letters, with separators
between its letters or with letters repeated opens a lattice of characters
(each sign may stand for a letter, a repetition or separator may be nothing),
and Viterbi decoding under a character language model of order ``ORDER`` picks
the likeliest reading, paying a channel cost per change.  Letters and signs
standing alone in a row open one lattice of the same kind, in which every blank
may be one or nothing, so spacing, signs and repetition are decoded together.
All other tokens have one path through their lattice and stay as they are:
numbers, and rows of which less than a quarter are letters.

The model's counts are taken over the words of all learning rows, whole
texts: one row per n-gram in a table of the shared folder, which grows with the
input and never meets in one place.  What may be disguised (a *unit*: a token
that opens a lattice, or a row of single letters) is restored once per distinct
unit: it names the n-grams its lattice needs, is joined with their counts, and
its reading is joined with the documents that hold it.

Scoring: words of the restored text and their beginnings are looked up in a
lexicon of items with the part of labelled documents holding them that are
toxic, shrunk towards the mean (``PRIOR_ROWS``); a beginning counts without
its commonest word.  The score is one minus the
product of the doubts about all distinct items of 1/2 or more, or the best item
below that.  The lexicon is fitted on a bounded, deterministic sample of
``TRAIN_ROWS`` labelled rows.

Rows: null and empty texts score 0; unlabelled rows are scored like others;
repeated rows get equal scores; labels, lang, source and doc_id are no input
of a score.  Of several labels of a row the greatest counts.  Without labels
every score is 0; without documents there are no rows.  Texts and units of any
length take time and memory in proportion.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import claim, documents, held_out, map_rows, share_of, slices, texts, written

ORDER = 4
TRAIN_ROWS = 20_000
PRIOR_ROWS = 10
SUPPORT = 5
ODDS = 2.5
BEGINNINGS = range(3, 9)
CACHE = 1 << 18
#: Distinct n-grams that one task holds before it hands their counts on.
HELD = 1 << 18
#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
COST_SIGN, COST_DROP, OUTSIDE = -1.0, -0.7, -16.0
SEPARATORS = frozenset(".-_*~'")
_EDGES = ".,;:!?%&*#\"'()[]{}|$<>=`~_-+"
#: Three or more letters (or signs that mostly stand for letters) alone, one or two blanks
#: apart, and what follows the last without a blank.
_ONE = r"(?:[^\W\d_]|[0-9@$€£])"
_ROW = re.compile(rf"((?<!\S)(?:{_ONE} {{1,2}}){{2,}}{_ONE}(?![^\s.,;:!?]))(\S*)")
_ODD = re.compile(r"(.)\1\1|[0-9@$!|+(€£.\-_*~]")
_BLANK = re.compile(r"\s")
#: Two dollar signs at an edge may be letters; three or more are decoration.
_DOLLARS_BEFORE, _DOLLARS_AFTER = re.compile(r"(?:(?<!\$)\${2})?\Z"), re.compile(r"(?:\${2}(?!\$))?")
_EDGES_ONLY = re.compile(rf"(?<!\S)[{re.escape(_EDGES)}]+(?!\S)")


# ---------------------------------------------------------------- language model


def _slot(chars: str) -> str:
    """The key of an n-gram: itself."""
    return chars


@functools.cache
def _kinds() -> np.ndarray:
    """Flags of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isspace():
            table[code] = WHITE
        elif c.isalnum() and not c.isdecimal():
            table[code] = LETTER | ALONE
    for c in "0123456789@$!|+(€£.-_*~":
        table[ord(c)] |= SIGN
    for c in "0123456789@$€£İ":  # these count at the end of a token too
        table[ord(c)] |= SIGN | FIRM
    for c in "0123456789@$€£":
        table[ord(c)] |= ALONE
    return table


@functools.cache
def _lower() -> np.ndarray:
    """The lower case of every code point, where it is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        low = chr(code).lower()
        if len(low) == 1:
            table[code] = ord(low)
    return table


WHITE, LETTER, SIGN, FIRM, ALONE = 1, 2, 4, 8, 16


def forget() -> None:
    """Give back what a worker remembers (see ``claim``)."""
    _kinds.cache_clear()
    _lower.cache_clear()
    _OPENS.clear()
    _BEST.clear()
    _BEST_OF.clear()
    _MARKS.clear()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(found: list[str]) -> Iterator[tuple[str, int]]:
    """N-grams (1 to ORDER) of the texts' words with counts, one blank around each
    word; the blank after it counts as its own.  An n-gram may come up several times."""
    codes = _codes("\n".join(["", *found, ""]).lower())
    letter = _kinds()[codes] & LETTER != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    stream = np.concatenate([[32], np.where(letter, codes, 32)[keep]]).astype(np.uint32)
    here = np.unique(stream)
    # 16 bits hold a character's number; beyond that many characters, shorter parts have fewer
    step = len(stream) if len(here) < 1 << 16 else 60_000
    number = np.zeros(0x110000, np.uint64)
    for start in range(0, len(stream), step):
        part = stream[start:start + step + ORDER - 1]
        chars = np.concatenate([[32], np.setdiff1d(part, [32])]).astype(np.uint32)
        number[chars] = np.arange(len(chars), dtype=np.uint64)
        ids = number[part]
        for n in range(1, ORDER + 1):
            rows = min(step, len(ids) - n + 1)
            if rows <= 0:
                continue
            key, good = np.zeros(rows, np.uint64), np.ones(rows, bool)
            for k in range(n):
                key = key << np.uint64(16) | ids[k:k + rows]
                if 0 < k < n - 1:
                    good &= ids[k:k + rows] != 0
            if n == 1:
                good[0] = start > 0  # the blank before the first word is no word's end
            keys, counts = np.unique(key[good], return_counts=True)
            places = np.arange(n - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
            letters = np.ascontiguousarray(chars[(keys[:, None] >> places & np.uint64(0xFFFF)).astype(np.int64)])
            yield from zip(letters.view(f"<U{n}").ravel().tolist() if len(keys) else [], counts.tolist())


class Counts:
    """(gram, n) as a table in the shared folder; ``most`` is the largest n."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.most = table.agg(F.max("n")).first()[0] or 0

    def __getitem__(self, gram: str) -> int:
        row = self.table.filter(F.col("gram") == gram).first()
        return row["n"] if row else 0


def character_counts(df: DataFrame) -> Counts:
    """Exact counts of the n-grams (1 to ORDER) of all words, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        for batch in batches:
            for piece in slices(batch):
                for gram, n in _grams(texts(piece)):
                    counts[gram] += n
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    counted = df.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counts(written(counted, "grams"))


class Letters:
    """Character language model over counts of n-grams; backs off to shorter contexts."""

    def __init__(self, table: dict[str, int], most: int):
        self.table, self.most = table, most
        self.known: dict[str, float] = {}

    def _p(self, chars: str) -> float:
        """Chance of the last character after the ones before it."""
        if not chars:
            return 1e-4
        shorter, n = self._p(chars[1:]), self.table.get(chars, 0)
        if len(chars) == 1:
            return (n * 1e4 / max(self.most, 1) + 2 * shorter) / (1e4 + 2)
        return (n + 2 * shorter) / (max(self.table.get(chars[:-1], 0), n) + 2)

    def log_p(self, before: str, c: str) -> float:
        chars = (before + c)[-ORDER:]
        value = self.known.get(chars)
        if value is None:
            if len(self.known) > CACHE:
                self.known.clear()
            value = self.known[chars] = log(max(self._p(chars), 1e-12)) if c.isalpha() or c == " " else OUTSIDE
        return value

    def word(self, w: str) -> float:
        total, before = 0.0, " "
        for c in w + " ":
            total += self.log_p(before, c)
            before = (before + c)[1 - ORDER:]
        return total


class Asked(Letters):
    """Notes the n-grams it is asked for instead of weighing them."""

    def __init__(self):
        super().__init__({}, 0)
        self.grams: set[str] = set()

    def log_p(self, before: str, c: str) -> float:
        chars = (before + c)[-ORDER:]
        if chars not in self.known:
            self.known[chars] = 0.0
            if c.isalpha() or c == " ":
                self.grams.update(chars[i:j] for i in range(len(chars)) for j in range(i + 1, len(chars) + 1))
        return 0.0


def lattice(token: str) -> str:
    """The part of a token that opens a lattice, lower case, or nothing.  At least two
    fifths of it can be read as letters, and one is a letter or no digit is among them."""
    low = token.lower()
    core = low.strip(_EDGES)
    lead, _, tail = low.partition(core) if core else (low, "", "")
    if lead in LEET and lead not in "(|":  # one sign at the edge may be a letter
        core = lead + core
    else:
        core = _DOLLARS_BEFORE.search(lead).group() + core if core else ""
    if tail in LEET and tail not in "!|+(":
        core += tail
    else:
        core += _DOLLARS_AFTER.match(tail).group()
    letters, digits = sum(c.isalpha() for c in core), sum("0" <= c <= "9" for c in core)
    readable = sum(c.isalpha() or c in LEET for c in core)
    if len(core) < 3 or not _ODD.search(core) or readable * 5 < len(core) * 2 or (digits and not letters):
        return ""
    return core


def is_row(m: re.Match) -> bool:
    """Whether single signs in a row may be a disguised text: a quarter of them are letters."""
    alone = [c for c in m[1] if not c.isspace()]
    return sum(c.isalpha() for c in alone) * 4 >= len(alone)


_OPENS: dict[str, bool] = {}


def opens(token: str) -> bool:
    """Whether a token opens a lattice, remembered per worker."""
    got = _OPENS.get(token)
    if got is None:
        if len(_OPENS) > CACHE:
            _OPENS.clear()
        got = _OPENS[token] = bool(lattice(token))
    return got


def without_rows(text: str) -> tuple[set[str], str]:
    """(rows of single signs, the text without them)."""
    rows = {m.group() for m in _ROW.finditer(text) if is_row(m)}
    return rows, _ROW.sub(lambda m: " " if is_row(m) else m.group(), text) if rows else text


def divided(text: str) -> tuple[set[str], set[str]]:
    """(tokens as they stand, units) of a text, distinct."""
    units, rest = without_rows(text)
    found = set(rest.split())
    units.update(t for t in found if opens(t))
    return found - units, units


def units_in(found: list[str], rows: bool = True) -> list[tuple[set[str], str]]:
    """(units, the text without rows of single signs) of each text, the units as
    ``divided`` gives them: only tokens with a sign that may disguise or a character three
    times, and texts with three single signs in a row, are looked at one by one."""
    whole = "\n".join(found)
    codes = _codes(whole)
    out: list[tuple[set[str], str]] = [(set(), t) for t in found]
    if not len(codes):
        return out
    kinds, low = _kinds()[codes], _lower()[codes]
    white = kinds & WHITE != 0
    last, first = np.append(white[1:], True) & ~white, np.append(True, white[:-1]) & ~white
    odd = (kinds & SIGN != 0) & (~last | (kinds & FIRM != 0))
    odd[:-2] |= (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & ~white[:-2]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.cumsum([len(t) + 1 for t in found])
    again = []  # texts that hold rows: their tokens are looked for in the rest
    if rows:
        alone = kinds[starts] & ALONE != 0
        single = alone & (ends - starts == 1)
        for k in np.unique(np.searchsorted(bounds, starts[:-2][single[:-2] & single[1:-1] & alone[2:]], "right")).tolist():
            out[k] = without_rows(found[k])
            if out[k][0]:
                again.append(k)
        for k, (units, _) in zip(again, units_in([out[k][1] for k in again], False) if again else ()):
            out[k][0].update(units)
    for token in np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1).tolist():
        a, b = int(starts[token]), int(ends[token])
        if opens(whole[a:b]):
            k = int(np.searchsorted(bounds, a, "right"))
            if k not in again:
                out[k][0].add(whole[a:b])
    return out


class Restorer:
    def __init__(self, letters: Letters):
        self.letters = letters
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        """The likeliest reading of one token."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[token] = self._token(token)
        return got

    def _token(self, token: str) -> str:
        core = lattice(token)
        if not core:
            return token
        at = token.lower().find(core)
        return token[:at] + self._decode(core) + token[at + len(core):]

    def _decode(self, core: str) -> str:
        # context -> (score, reading as a chain); the context is all the model looks at
        paths: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
        for k, c in enumerate(core):
            options = _options(core, k)
            if c in SEPARATORS and 0 < k < len(core) - 1:
                options.append(("", COST_DROP))
            after: dict[str, tuple[float, tuple | None]] = {}
            for before, (score, reading) in paths.items():
                for x, cost in options:
                    _keep(after, (before + x)[1 - ORDER:], score + cost + (self.letters.log_p(before, x) if x else 0.0), (reading, x) if x else reading)
            paths = after
        return self._best(paths)

    def join(self, run: str) -> str:
        """Letters and signs standing alone: the likeliest letters and their division into
        words of any length, in one lattice.  A word of several letters pays for the blanks taken out once."""
        alone = "".join(c for c in run.lower() if c.isalpha() or c in LEET)
        paths: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
        for k in range(len(alone)):
            options = _options(alone, k)
            after: dict[str, tuple[float, tuple | None]] = {}
            for before, (score, reading) in paths.items():
                ended = score + (self.letters.log_p(before, " ") if before else 0.0)
                for x, cost in options:
                    if not x:
                        _keep(after, before, score + cost, reading)
                        continue
                    _keep(after, " " + x, ended + cost + self.letters.log_p(" ", x), ((reading, " ") if before else None, x))
                    if before:
                        second = len(before) == 2  # the word had one letter: a blank and it
                        _keep(after, (before + x)[1 - ORDER:], score + cost + self.letters.log_p(before, x) + (COST_SIGN if second else 0.0), (reading, x))
            paths = after
        return self._best(paths)

    def _best(self, paths: dict[str, tuple[float, tuple | None]]) -> str:
        """The reading of the likeliest path; of equal ones, that with the greatest context."""
        context = max(paths, key=lambda c: (paths[c][0] + (self.letters.log_p(c, " ") if c else 0.0), c))
        out, chain = [], paths[context][1]
        while chain is not None:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))

    def unit(self, unit: str) -> str:
        """The likeliest reading of a unit."""
        row = _ROW.fullmatch(unit)
        return self.join(row[1]) + row[2] if row else self._token(unit)


def _options(core: str, k: int) -> list[tuple[str, float]]:
    """What the character at ``k`` may stand for, and the cost: itself, a letter it looks like, or, repeated, nothing."""
    c = core[k]
    options = [(c, 0.0)] + [(x, COST_SIGN) for x in LEET.get(c, "")]
    if c.isalpha() and c * 3 in core[max(0, k - 2):k + 3] and core[k - 1:k] == c:
        options.append(("", COST_DROP))
    return options


def _keep(paths: dict[str, tuple[float, tuple | None]], context: str, score: float, reading: tuple | None) -> None:
    if context not in paths or score > paths[context][0]:
        paths[context] = (score, reading)


def needed(unit: str) -> set[str]:
    """All n-grams that reading a unit can ask for: no context is left out, whatever its score."""
    asked = Asked()
    Restorer(asked).unit(unit)
    return asked.grams


def units_of(df: DataFrame) -> DataFrame:
    """(unit), distinct, of all texts."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set().union(*(units for units, _ in units_in(texts(batch))))
        return pa.record_batch([pa.array(list(found), pa.string())], names=["unit"])

    return map_rows(df.select("text"), "unit string", kernel).distinct()


def readings(units: DataFrame, counts: Counts) -> DataFrame:
    """(unit, reading) by exact counts of the n-grams each unit needs."""
    most = counts.most

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = batch.column("unit").to_pylist()
        return pa.record_batch([batch.column("unit"), pa.array([sorted(needed(u)) for u in units], pa.list_(pa.string()))], names=["unit", "grams"])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for unit, known in zip(batch.column("unit").to_pylist(), batch.column("known").to_pylist()):
            out.append(Restorer(Letters({k["gram"]: k["n"] for k in known or ()}, most)).unit(unit))
        return pa.record_batch([batch.column("unit"), pa.array(out, pa.string())], names=["unit", "reading"])

    asked = map_rows(units, "unit string, grams array<string>", ask, 1 << 18)
    key = F.sha2("unit", 256).alias("key")  # units can be as long as a text
    pairs = asked.select(key, F.explode("grams").alias("gram")).join(counts.table, "gram")
    known = pairs.groupBy("key").agg(F.collect_list(F.struct("gram", "n")).alias("known"))
    return written(map_rows(units.select("unit", key).join(known, "key", "left"), "unit string, reading string", read), "readings")


# ---------------------------------------------------------------- lexicon


def items(word: str) -> list[str]:
    return [word + "$"] + [word[:n] for n in BEGINNINGS if n <= len(word)]


def word_of(token: str) -> str:
    return token.strip(_EDGES).lower()


def best_item(word: str, lexicon: dict[str, float]) -> tuple[float, str]:
    """The worst item of a word, and how bad it is."""
    return max(((lexicon.get(i, 0.0), i) for i in items(word)), default=(0.0, ""))


def combined(found: dict[str, float]) -> float:
    sure = [found[i] for i in sorted(found) if found[i] >= 0.5]
    return float(1 - np.prod([1 - p for p in sure])) if sure else max(found.values(), default=0.0)


def _item_counts(df: DataFrame, read, only=None) -> DataFrame:
    """(item, n): documents with each item, restored; counted per batch first."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for t in texts(batch):
            plain, units = divided(t)
            words = {word_of(w) for w in plain} | {word_of(w) for u in units for w in read.value.get(u, u).split()}
            counts.update({i for w in words for i in items(w) if only is None or i in only.value})
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["item", "n"])

    return map_rows(df.select("text"), "item string, n long", kernel).groupBy("item").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame):
    """(readings of all units, lexicon); counts and lexicon from learning rows only."""
    spark = docs.sparkSession
    learning = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    read = readings(written(units_of(docs), "units"), character_counts(learning))
    truth = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bad = truth.filter(~held_out(F.col("doc_id"))).agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not bad:
        return read, {}
    if n > TRAIN_ROWS:
        truth = truth.filter(share_of(F.col("doc_id"), "toxic", TRAIN_ROWS / n))
    rows = learning.join(F.broadcast(truth.filter(~held_out(F.col("doc_id")))), "doc_id")  # at most about TRAIN_ROWS ids
    # readings of the sample's units that differ from them: bounded by TRAIN_ROWS texts
    of_sample = read.filter("reading <> unit").join(units_of(rows), "unit", "left_semi").collect()
    table = spark.sparkContext.broadcast({r["unit"]: r["reading"] for r in of_sample})
    toxic = _item_counts(rows.filter("toxic = 1"), table).filter(F.col("n") >= SUPPORT).toPandas()  # bounded by TRAIN_ROWS texts
    only = spark.sparkContext.broadcast(set(toxic["item"]))
    clean = dict(map(tuple, _item_counts(rows.filter("toxic = 0"), table, only).collect()))
    return read, lexicon(dict(zip(toxic["item"], toxic["n"])), clean, bad / n)


def lexicon(toxic: dict[str, int], clean: dict[str, int], mean: float) -> dict[str, float]:
    """Items with at least ``ODDS`` times the mean's odds of being toxic.  A beginning counts
    without its commonest word: it must be a sign in other words too."""
    top: dict[str, str] = {}
    for word in (i for i in toxic if i[-1] == "$"):
        for begin in items(word[:-1])[1:]:
            if begin not in top or toxic[word] > toxic[top[begin]]:
                top[begin] = word
    out = {}
    for item, bad in toxic.items():
        good = clean.get(item, 0)
        if item in top:
            bad, good = max(0, bad - toxic[top[item]]), max(0, good - clean.get(top[item], 0))
        p = (bad + PRIOR_ROWS * mean) / (bad + good + PRIOR_ROWS)
        if p * (1 - mean) >= ODDS * mean * (1 - p):
            out[item] = p
    return out


def score(docs: DataFrame, read: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    hits = pa.list_(pa.struct([("item", pa.string()), ("p", pa.float64())]))

    def found(words: Iterable[str]) -> list[dict]:
        return [{"item": i, "p": p} for p, i in {_best(w, shared.value) for w in words} if p]

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        here, marks = uuid.uuid4().hex, _marks(shared.value)
        both = units_in(texts(batch))
        seen = [[{"item": i, "p": p} for p, i in marks.of(rest)] for _, rest in both]
        return pa.record_batch([pa.array([f"{here}{k}" for k in range(len(both))]), batch.column("doc_id"), pa.array(seen, hits),
                                pa.array([sorted(units) for units, _ in both], pa.list_(pa.string()))], names=["row", "doc_id", "found", "units"])

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [found(r.split()) for r in batch.column("reading").to_pylist()]
        return pa.record_batch([batch.column("unit"), pa.array(out, hits)], names=["unit", "marks"])

    def total(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [combined({x["item"]: x["p"] for x in (a or []) + [x for m in b or [] for x in m]})
               for a, b in zip(batch.column("found").to_pylist(), batch.column("marks").to_pylist())]
        return pa.record_batch([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = "array<struct<item:string,p:double>>"
    rows = written(map_rows(docs.select("doc_id", "text"), f"row string, doc_id long, found {kind}, units array<string>", plain), "rows")
    marks = written(map_rows(read, f"unit string, marks {kind}", marked).filter("size(marks) > 0"), "marks")
    more = rows.select("row", F.explode("units").alias("unit")).join(marks, "unit").groupBy("row").agg(F.collect_list("marks").alias("marks"))
    return map_rows(rows.join(written(more, "more"), "row", "left").select("doc_id", "found", "marks"), "doc_id long, score double", total)


class Marks:
    """Finds the lexicon's items in a whole text: one automaton, and a look at the
    token around each hit."""

    def __init__(self, lexicon: dict[str, float]):
        patterns: dict[str, list[tuple[float, str, bool]]] = {}
        for item, p in lexicon.items():
            if p and item[-1] == "$" and item != "$":
                patterns.setdefault(item[:-1], []).append((p, item, True))
            if p and len(item) in BEGINNINGS:
                patterns.setdefault(item, []).append((p, item, False))
        self.edges = lexicon.get("$", 0.0)  # the word of a token of edge signs only
        self.automaton = ahocorasick.Automaton() if patterns else None
        for pattern, items in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), items))
        if patterns:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[tuple[float, str]]:
        """``best_item`` of every token that opens no lattice, if any."""
        low = text.lower()
        best: dict[int, tuple[float, str]] = {}
        for end, (size, items) in self.automaton.iter(low) if self.automaton else ():
            start = at = end + 1 - size
            while at and low[at - 1] in _EDGES:
                at -= 1
            if at and not low[at - 1].isspace():
                continue
            stop = _BLANK.search(low, end + 1)
            token = low[at:stop.start() if stop else len(low)]
            word = token[start - at:].rstrip(_EDGES)
            if len(word) < size or opens(token):
                continue
            for p, item, only_whole in items:
                if (len(word) == size or not only_whole) and (p, item) > best.get(start, (0.0, "")):
                    best[start] = (p, item)
        out = set(best.values())
        if self.edges and any(not opens(t) for t in _EDGES_ONLY.findall(low)):
            out.add((self.edges, "$"))
        return out


_MARKS: list = []


def _marks(lexicon: dict[str, float]) -> Marks:
    if not _MARKS or _MARKS[0] is not lexicon:
        _MARKS[:] = [lexicon, Marks(lexicon)]
    return _MARKS[1]


_BEST: dict[str, tuple[float, str]] = {}
_BEST_OF: list[dict] = []


def _best(token: str, lexicon: dict[str, float]) -> tuple[float, str]:
    """``best_item`` of a token's word, remembered per worker and lexicon."""
    if not _BEST_OF or _BEST_OF[0] is not lexicon:
        _BEST_OF[:] = [lexicon]
        _BEST.clear()
    got = _BEST.get(token)
    if got is None:
        if len(_BEST) > CACHE:
            _BEST.clear()
        got = _BEST[token] = best_item(word_of(token), lexicon)
    return got


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, *train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
