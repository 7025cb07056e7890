"""Lexemes of stretches: runs of plain words that the JVM leaves whole (``lexing.py_stretches``).

A stretch is cut at its blanks by array passes over the bytes; its distinct words are lexed
once for each piece of a batch.  A stretch begins with a plain character and ends
with a blank, which no lexeme does (a comment begins with ``#``, a line break or join with
its own character), so the two are told apart by their first and last byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import grammar as G
from .layout import slices

#: Bytes of text cut at a time (a longer text is cut alone).
MOST_BYTES = 4 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
_PLAIN = np.arange(256) > 32
_PLAIN[[34, 35, 39, 92, 127]] = False
# More than one character, none of which opens a string, a comment or a join; and such that are one name.
_PLAIN_WORD = r"^[!$-&(-\[\]-~\x{80}-\x{10FFFF}]{2,}$"
_NAME = r"^[A-Za-z_\x{80}-\x{10FFFF}][0-9A-Za-z_\x{80}-\x{10FFFF}]*$"
_LEXEMES = re.compile(G.python_pattern("word")).findall


def text_pieces(lex: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch, in order, in slices of at most ``MOST_BYTES`` bytes."""
    if isinstance(lex, pa.ChunkedArray):
        lex = lex.combine_chunks()
    yield from slices(lex, _ends(lex.values)[lex.offsets.to_numpy(zero_copy_only=False)], MOST_BYTES)


def _ends(values: pa.Array) -> np.ndarray:
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(values.type)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
    return ends[values.offset:values.offset + len(values) + 1]


def cut(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words and blanks of stretches and the lexemes beside them, in order; and how many
    of them stand before each string of ``flat`` (and in all)."""
    ends = _ends(flat)
    if not len(flat) or ends[-1] == ends[0]:
        return flat.slice(0, 0).cast(pa.string()), np.zeros(len(flat) + 1, dtype=np.int64)
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    at = (ends - ends[0]).astype(np.int64)
    size = np.diff(at)
    some = size > 0
    stretch = np.zeros(len(size), dtype=bool)
    stretch[some] = _PLAIN[data[at[:-1][some]]] & _BLANK[data[at[1:][some] - 1]]
    blank = _BLANK[data]
    begins = np.concatenate(([True], blank[1:] != blank[:-1])) & np.repeat(stretch, size)
    begins[at[:-1][some]] = True
    begin = np.flatnonzero(begins)
    offsets = np.append(begin, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(begin, at)


def lexemes_of(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lexemes of some parts, in order, and how many each part has."""
    plain = pc.match_substring_regex(parts, _PLAIN_WORD).to_numpy(zero_copy_only=False)
    name = pc.match_substring_regex(parts, _NAME).to_numpy(zero_copy_only=False)
    mixed = plain & ~name
    found = [_LEXEMES(word) for word in parts.filter(pa.array(mixed)).to_pylist()]
    size = np.ones(len(parts), dtype=np.int64)
    size[mixed] = [len(f) for f in found]
    source = np.repeat(np.arange(len(parts)), size)
    inside = np.repeat(mixed, size)
    source[inside] = len(parts) + np.arange(np.count_nonzero(inside))
    every = pa.concat_arrays([parts, pa.array([x for f in found for x in f], parts.type)])
    return every.take(pa.array(source)), size


def count(lex: pa.Array) -> pa.Table:
    """(lexeme, n) of the distinct lexemes of a batch of stretches."""
    found = []
    for piece in text_pieces(lex):
        coded = cut(piece.flatten())[0].dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        lexemes, size = lexemes_of(coded.dictionary)
        found.append(pa.table({"lexeme": lexemes, "n": np.repeat(times, size).astype(np.int64)}))
    every = pa.concat_tables(found or [pa.table({"lexeme": pa.array([], pa.string()), "n": pa.array([], pa.int64())})])
    return every.group_by("lexeme", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lexeme", "n"])
