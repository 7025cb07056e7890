"""Benchmark decontamination with an Aho-Corasick automaton over word windows.

Texts are normalised to words: A-Z lower-cased, words are runs of digits,
letters a-z and everything beyond ASCII.  A window is ``WINDOW`` consecutive
words of a benchmark item; an item with fewer words (but not none) is one
window.  All windows go into one automaton whose alphabet is the benchmark's
own vocabulary (every other word is symbol 0), and each document is scanned
once.  Word positions are mapped back to code-point offsets of the original
text, so a hit can be shown or cut there.

A benchmark beyond ``BLOCK_WORDS`` words is split into blocks of whole items;
each document then passes one automaton per block in the same stage and the
hits are united, with the same result.  So what is broadcast is bounded by
``BLOCK_WORDS`` (plus one item), never by the table.

Rows: null or wordless texts have no words and no hits; items without words
are ignored, items without an id hit but are not named; repeated items and documents give repeated, equal results.  An
empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeweigh.llm.common import documents, keep_rows, map_rows

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Bytes -> lower-cased bytes, with a blank for every ASCII byte that is in no word.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A word in the original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode().translate(_NORMAL).split(b" ") if w]


class Scanner:
    """An automaton over the windows of ``items`` ((item_id, text) pairs)."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for at in range(max(1, len(w) - WINDOW + 1) if w else 0):
                owners.setdefault(tuple(w[at:at + WINDOW]), set()).update([] if item is None else [str(item)])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, who in owners.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(who))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) inside windows, and the items they belong to."""
        if self.empty:
            return [], set()
        get, ranges, items = self.ids.get, [], set()
        for end, (size, who) in self.automaton.iter(tuple([get(w, 0) for w in found])):
            ranges.append((end - size + 1, end + 1))
            items.update(who)
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point ranges [start, end) of the original text."""
    if not ranges:
        return []
    spans = np.array([m.span() for m in _WORD.finditer(text)])
    return [(int(spans[a, 0]), int(spans[b - 1, 1])) for a, b in ranges]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words(row["text"]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        if n:
            block.append((row["item_id"], row["text"]))
            size += n
    yield block


_READY: dict[str, Scanner] = {}


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, ranges, spans, items) per row of ``docs``: hit word
    ranges, the same as code-point spans of the original text, and item ids."""
    df = docs.selectExpr("doc_id", "text", "cast(0 as bigint) n_words", "cast(array() as array<bigint>) ranges", "cast(array() as array<bigint>) spans", "cast(array() as array<string>) items")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    for block in blocks(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(block)
        df = map_rows(df, schema, _kernel(shared, _name(block)))
    return df


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all columns, that hold no window of the benchmark."""
    for block in blocks(benchmark):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), _name(block)
        docs = keep_rows(docs, lambda text, shared=shared, name=name: not _scanner(shared, name).scan(words(text))[0])
    return docs


def _name(block: list) -> str:
    return hashlib.sha256(repr(block).encode()).hexdigest()


def _scanner(shared, name: str) -> Scanner:
    """One automaton per worker and block."""
    if name not in _READY:
        if len(_READY) > 4:
            _READY.clear()
        _READY[name] = Scanner(shared.value)
    return _READY[name]


def _kernel(shared, name: str):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(shared, name)
        n_words, ranges, spans, items = [], [], [], []
        for text, before, known in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "items"))):
            found = words(text)
            hit, who = scanner.scan(found)
            if before:
                hit = merged(hit + list(zip(before[::2], before[1::2])))
            n_words.append(len(found))
            ranges.append([x for r in hit for x in r])
            spans.append([x for r in offsets(text or "", hit) for x in r])
            items.append(sorted(who.union(known)))
        return pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                                pa.array(ranges, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64())),
                                pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    return kernel


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def summary(scanned: DataFrame) -> DataFrame:
    n_hit = "aggregate(sequence(0, size(ranges) div 2), 0L, (n, i) -> n + coalesce(get(ranges, 2 * i + 1) - get(ranges, 2 * i), 0L))"
    return scanned.selectExpr("doc_id", "n_words", f"{n_hit} n_hit", "cast(size(items) as bigint) n_items", "sha2(array_join(items, ','), 256) items_sha256", "size(ranges) > 0 contaminated")


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"list_filter(regexp_split_to_array(translate(text, '{_AZ}', '{_LOW}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: DuckDB SQL: windows of both tables by position, joined where they are equal.
ORACLE = f"""
with d as (select doc_id, coalesce({_SQL_WORDS}, []) w from documents),
b as (select item_id, {_SQL_WORDS} w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) n, array_to_string(w[i:i + {WINDOW - 1}], ' ') g
       from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g
       from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from hit) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
       from (select distinct doc_id, cast(item_id as varchar) item from hit) group by doc_id),
sp as (select doc_id, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items, '') items from d left join hits using (doc_id) left join it using (doc_id))
select d.doc_id, len(d.w) n_words, n_hit, n_items, sha256(items) items_sha256, n_hit > 0 contaminated
from d join sp using (doc_id)
"""


def forget() -> None:
    """Drop what a worker keeps between batches."""
    _READY.clear()
