"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period ``q`` and at least
``EXPONENT * q`` words that no neighbour extends.  All texts of an Arrow batch
lie behind one another in one array of word numbers; at each dyadic scale
``tau`` the following steps find the runs with ``tau < q <= 2 * tau``:

1. Every stretch of ``tau`` words has a hash of its content.  Position ``i`` is
   synchronising if the least hash among the stretches that start in
   ``i .. i + tau`` is that of the first or of the last of them.  This depends
   only on the ``2 * tau`` words after ``i`` (its context), so equal contexts are
   chosen alike, and of any ``tau`` positions one is chosen unless all around
   is highly periodic.
2. Highly periodic stretches (period up to ``tau / 4``) lie inside runs that
   smaller scales have found already; they are left out of the minimum.  Period
   1 is read off directly.
3. Two consecutive positions with equal contexts propose their distance as a
   period.  In a run of period ``q`` a context holds a whole period, so equal
   contexts are exactly multiples of ``q`` apart, and some position among the
   first ``tau`` words of the run and its successor propose ``q``.
4. A proposal is extended on the words themselves, once for each stretch.

A proposal is always a square of the text, so extensions cost in all about one
pass for each scale: the whole is O(n log^2 n) in numpy.  Two different contexts
of one text share a 64-bit hash with a probability of about n^2 / 2^64; that
could hide a run, never invent one.

The job is map-only; a batch is cut to a few MB, so memory is bounded by the
longest text (about 100 bytes a word).  Null, empty and blank texts have no
words and no runs: four nulls and the hashes of the empty text.  Repeated rows
and equal texts give equal results; ties for the longest run go to the smallest
start, then period.  A row without ``doc_id`` is judged like any other.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeweigh.llm.common import documents, map_rows, texts

#: A run has at least so many periods (the density argument above needs 4) and so many words.
EXPONENT = 4
SHORTEST = 6
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_PRIME, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _later(values: np.ndarray, by: int, fill: np.uint64) -> np.ndarray:
    """``values[i + by]`` at ``i``."""
    out = np.full_like(values, fill)
    if by < len(values):
        out[:len(values) - by] = values[by:]
    return out


def synchronising(content: np.ndarray, room: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """Which positions are chosen at scale ``tau``.  ``content``: hash of the next
    ``tau`` words; ``room``: words up to the end of the text; ``periodic``:
    positions left out of the minimum."""
    key = np.where(periodic | (room < tau), _TOP, np.minimum(content, _TOP - np.uint64(1)))
    least, width = key, 1
    while width < tau:
        least = np.minimum(least, _later(least, width, _TOP))
        width *= 2
    least = np.minimum(least, _later(least, 1, _TOP))
    return (room >= 2 * tau) & (least < _TOP) & ((least == key) | (least == _later(key, tau, _TOP)))


def _agreeing(word: np.ndarray, at: int, by: int, end: int) -> int:
    """The first ``k >= at`` with ``word[k] != word[k + by]`` (or the last possible)."""
    step = 64
    while at + by < end:
        top = min(at + step, end - by)
        same = word[at:top] == word[at + by:top + by]
        if not same.all():
            return at + int(same.argmin())
        at, step = top, step * 2
    return at


def _agreeing_before(word: np.ndarray, at: int, by: int, start: int) -> int:
    """The least ``k`` such that ``word[x] == word[x + by]`` for all x in ``k .. at - 1``."""
    step = 64
    while at > start:
        low = max(at - step, start)
        same = (word[low:at] == word[low + by:at + by])[::-1]
        if not same.all():
            return at - int(same.argmin())
        at, step = low, step * 2
    return at


def _proposals(context: np.ndarray, text: np.ndarray, at: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of consecutive equal contexts, by period, then position."""
    group = _mix(context + text.astype(np.uint64) * _PRIME)
    order = np.argsort(group, kind="stable")  # positions stay in order within a group
    one, two = order[:-1], order[1:]
    near = at[two] - at[one]
    good = (group[one] == group[two]) & (text[one] == text[two]) & (near > tau) & (near <= 2 * tau)
    where, period = at[one[good]], near[good]
    order = np.lexsort((where, period))
    return where[order], period[order]


def batch_runs(word: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start in ``word``, length, period) of all runs of ``EXPONENT`` periods or
    more in texts that lie behind one another."""
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(word))
    found: list[tuple[int, int, int]] = []
    if not len(word):
        return found
    # period 1: neighbours that are equal, in stretches
    breaks = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1]), [True])))
    long = np.diff(breaks) >= EXPONENT
    found += [(int(s), int(n), 1) for s, n in zip(breaks[:-1][long], np.diff(breaks)[long])]

    room, content = ends[text] - at, _mix(word.astype(np.uint64) + _PRIME)
    tau = 1
    while True:
        wide = sizes[text] >= EXPONENT * (tau + 1)  # no period above tau fits into the other texts
        if not wide.all():
            text, at, room, content = text[wide], at[wide], room[wide], content[wide]
        if not len(at):
            return found
        periodic = np.zeros(len(at), bool)
        inside = [(s, n) for s, n, q in found if EXPONENT * q <= tau <= n]
        if inside:
            edges = np.zeros(len(word) + 1, np.int64)
            np.add.at(edges, [s for s, _ in inside], 1)
            np.add.at(edges, [s + n - tau + 1 for s, n in inside], -1)
            periodic = np.cumsum(edges)[at] > 0
        chosen = np.flatnonzero(synchronising(content, room, tau, periodic))
        content = _mix(content * _PRIME + _later(content, tau, _TOP))  # now of 2 * tau words, the context
        where, period = _proposals(content[chosen], text[chosen], at[chosen], tau)
        known, last = 0, 0
        for k, q in zip(where.tolist(), period.tolist()):
            if q == last and k < known:  # in the stretch extended last
                continue
            t = int(np.searchsorted(ends, k, "right"))
            known, last = _agreeing(word, k, q, int(ends[t])), q
            first = _agreeing_before(word, k, q, int(ends[t] - sizes[t]))
            if known + q - first >= EXPONENT * q:
                found.append((first, known + q - first, q))
        tau *= 2


def per_text(word: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """For each text its runs (start, length, period) by start, then period, and
    which of its words stay when each run is cut to its first period."""
    starts = np.cumsum(sizes) - sizes
    runs = sorted(r for r in batch_runs(word, sizes) if r[1] >= SHORTEST)
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, [s + q for s, _, q in runs], 1)
    np.add.at(edges, [s + n for s, n, _ in runs], -1)
    stays = np.cumsum(edges) == 0
    cuts = np.searchsorted([r[0] for r in runs], np.concatenate((starts, [len(word)])))
    for t, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        yield [(a - s, m, q) for a, m, q in runs[cuts[t]:cuts[t + 1]]], stays[s:s + n]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string")
DIGESTS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def detect(docs: DataFrame, rewrite: Rewrite | None = None, whole: bool = True) -> DataFrame:
    """Per row its longest run, digests, and (with ``whole``) all runs and the text
    with every run cut to its first period.  ``rewrite`` may change a document's
    words first."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.encode().split() for t in texts(batch)]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), words)]
        sizes = np.array([len(w) for w in words], np.int64)
        numbers = _Numbers()
        word = np.fromiter((numbers[x] for w in words for x in w), np.int64, int(sizes.sum()))
        columns: list[list] = [[] for _ in range(9)]
        for w, (runs, stays) in zip(words, per_text(word, sizes)):
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            kept = b" ".join(w if stays.all() else list(compress(w, stays.tolist())))
            listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
            row = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(),
                   hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode() if whole else None)
            for column, value in zip(columns, row):
                column.append(value)
        long, pair = pa.int64(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        kinds = [long] * 5 + [pa.string()] * 2 + [pair, pa.string()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in (*DIGESTS, "runs", "collapsed")])

    return map_rows(docs.select("doc_id", "text"), SCHEMA, kernel)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted runs: in one document of ten the words from some
    place on repeat with some period."""
    n = len(words)
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), periodic_tail, whole=False).select(*DIGESTS)


#: DuckDB SQL: every pair of equal words at a distance, stretches of such pairs, the least period of each stretch.
#: The checksum is folded bit by bit.
ORACLE = f"""
with c as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w,
  xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda crc, x:
    list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, _b: xor(r >> 1, (r & 1) * 3988292384)), 4294967295), 4294967295) h from documents),
g as (select *, len(w) n, h // 10 g, h % 10 = 0 and len(w) > 0 and doc_id is not null planted from c),
p as (select *, case when planted then g % n end a, case when planted then 1 + (n - g % n) // (3 + g % 8) end p from g),
t as (select doc_id, n, case when planted then list_transform(range(n), lambda i: w[case when i >= a then a + (i - a) % p else i end + 1]) else w end w from p),
u as (select doc_id, n, unnest(w) x, generate_subscripts(w, 1) - 1 i from t),
m as (select a.doc_id, b.i - a.i q, a.i from u a join u b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and {EXPONENT} * (b.i - a.i) <= a.n),
s as (select *, i - row_number() over (partition by doc_id, q order by i) k from m),
r as (select doc_id, q, min(i) s, count(*) + q len from s group by doc_id, q, k having count(*) + q >= greatest({SHORTEST}, {EXPONENT} * q)),
o as (select doc_id, s, len, min(q) q from r group by all),
best as (select doc_id, count(*) n_runs, arg_min(row(s, len, q), (-len, s, q)) b, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q)) h from o group by doc_id),
cut as (select distinct doc_id, unnest(generate_series(s + q, s + len - 1)) i from o),
kept as (select doc_id, sha256(string_agg(x, ' ' order by i)) h from u anti join cut using (doc_id, i) group by doc_id)
select t.doc_id, coalesce(n_runs, 0) n_runs, b[1] "start", b[2] length, b[3] period, cast(floor(1000 * b[2] / b[3]) as bigint) exponent_milli,
  coalesce(best.h, sha256('')) runs_sha256, coalesce(kept.h, sha256('')) collapsed_sha256
from t left join best using (doc_id) left join kept using (doc_id)
"""
