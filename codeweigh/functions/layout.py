"""Lexeme roles and the sequential half of the Python lexer, as Arrow UDFs.

Input: the lexeme arrays produced in the JVM by ``regexp_extract_all``.
Each Arrow batch is classified at once with ``pyarrow.compute`` (no Python
string objects), packed per lexeme as ``k + 32*(length > 1) + 64*indent``,
and folded per text: bracket depth, NEWLINE suppression, adjacency and line
numbering are numpy prefix sums; only emitted line breaks go through the
small indent-stack loop.

The arrays of a fold take some hundred bytes a lexeme, so a batch is folded in
pieces of whole texts (:func:`pieces`): a worker's memory is bounded by
``MOST_LEXEMES`` or the longest single text, not by the batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar as G

_OPS = [o for o, _ in G.PY_OPERATORS if o not in G.PY_OPENERS + G.PY_CLOSERS + [":", "@"]]
_OTHER_KW = [k for k, _ in G.PY_KEYWORDS if k not in G.PY_OPERAND_KEYWORDS + G.PY_CONTINUATION_KEYWORDS]
_NAME_START = r"^[_\p{L}\p{Nl}" + G.PY_ID_START_EXTRA + "]$"


_TABLE = G.PY_OPENERS + G.PY_CLOSERS + [":", "@"] + _OPS + G.PY_CONTINUATION_KEYWORDS + \
    G.PY_OPERAND_KEYWORDS + _OTHER_KW
_TABLE_CODE = np.array([6] * len(G.PY_OPENERS) + [7] * len(G.PY_CLOSERS) + [8, 11] + [9] * len(_OPS)
                       + [10] * len(G.PY_CONTINUATION_KEYWORDS) + [4] * len(G.PY_OPERAND_KEYWORDS)
                       + [9] * len(_OTHER_KW), dtype=np.int64)
_TABLE_ARROW = pa.array(_TABLE, pa.string())
_PREFIX_BYTES = np.array([ord(c) for c in "rRuUfFbB\'\""], dtype=np.uint8)


def _first_bytes(values: pa.Array) -> np.ndarray:
    """First UTF-8 byte of every (non-empty) string, read from the buffers."""
    wide = pa.types.is_large_string(values.type)
    offs = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(1, np.uint8)
    return data[np.minimum(offs[:-1], max(len(data) - 1, 0))]


def pack_roles(values: pa.Array, at_start: np.ndarray) -> np.ndarray:
    """Packed role of every lexeme of a flat string array (see module doc).

    ``at_start`` marks lexemes at offset 0 of their text.  Tests run in the
    order of a CASE: line breaks, blanks, comments and backslashes by first
    byte, then operators and keywords (one hash lookup), then strings vs
    names/numbers by length and quotes, then single characters.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    length = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    b = _first_bytes(values)
    longer = length > 1
    k = np.full(n, -1, dtype=np.int64)
    k[(b == 10) | (b == 13)] = 1
    k[b == 12] = 13
    blank = (b == 32) | (b == 9)
    k[blank] = np.where(at_start[blank], 14, 0)
    k[b == 35] = 12
    bsl = b == 92
    k[bsl] = np.where(longer[bsl], 2, 3)
    open_ = np.flatnonzero(k < 0)
    if open_.size:
        sub = values.take(pa.array(open_))
        pos = pc.index_in(sub, value_set=_TABLE_ARROW).fill_null(-1)
        pos = pos.to_numpy(zero_copy_only=False).astype(np.int64)
        hit = pos >= 0
        k[open_[hit]] = _TABLE_CODE[pos[hit]]
    multi = np.flatnonzero((k < 0) & longer)
    if multi.size:
        k[multi] = 4
        maybe = multi[np.isin(b[multi], _PREFIX_BYTES)]
        if maybe.size:
            sub = values.take(pa.array(maybe))
            quote = (pc.match_substring(sub, "'").to_numpy(zero_copy_only=False)
                     | pc.match_substring(sub, '"').to_numpy(zero_copy_only=False))
            k[maybe[quote]] = 5
    single = np.flatnonzero(k < 0)
    if single.size:
        bs = b[single]
        ascii_name = ((bs >= 48) & (bs <= 57)) | ((bs >= 65) & (bs <= 90)) | ((bs >= 97) & (bs <= 122)) | (bs == 95)
        k[single] = np.where(ascii_name, 4, 3)
        wide = single[bs >= 128]
        if wide.size:
            ok = pc.match_substring_regex(values.take(pa.array(wide)), _NAME_START).to_numpy(zero_copy_only=False)
            k[wide[ok]] = 4
    packed = k + 32 * longer
    nl_idx = np.flatnonzero((k == 1) | (k == 13) | (k == 14))
    if nl_idx.size:
        blanks = pc.replace_substring_regex(values.take(pa.array(nl_idx)), r"[\r\n\f]", "")
        widths = pc.utf8_length(blanks).to_numpy(zero_copy_only=False).astype(np.int64)
        tabbed = pc.match_substring(blanks, "\t").to_numpy(zero_copy_only=False)
        if tabbed.any():  # the width rule once per distinct run of blanks
            at = np.flatnonzero(tabbed)
            coded = blanks.take(pa.array(at)).dictionary_encode()
            by_code = np.array([len(x.expandtabs(8)) for x in coded.dictionary.to_pylist()], dtype=np.int64)
            widths[at] = by_code[coded.indices.to_numpy(zero_copy_only=False)]
        packed[nl_idx] += 64 * widths
    return packed


#: Lexemes folded at a time (a text of more is folded alone).
MOST_LEXEMES = 1 << 17


def pieces(lex: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The texts of a batch, in order, cut into slices of at most ``most`` lexemes."""
    if isinstance(lex, pa.ChunkedArray):
        lex = lex.combine_chunks()
    most = MOST_LEXEMES if most is None else most
    yield from slices(lex, lex.offsets.to_numpy(zero_copy_only=False), most)


def slices(lex: pa.Array, ends: np.ndarray, most: int) -> Iterator[pa.Array]:
    """The texts of a batch cut where ``ends`` (the size of all texts before each, and of all) passes ``most``."""
    at = 0
    while at < len(lex):
        end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
        yield lex.slice(at, end - at)
        at = end


def in_pieces(lex: pa.Array, fold: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``fold`` of a whole batch, computed a piece at a time."""
    return pa.concat_arrays([fold(piece) for piece in pieces(lex)] or [fold(lex)])


def _flat(lex: pa.Array):
    """Flat lexemes, per-text offsets and null mask of a list<string> array."""
    if isinstance(lex, pa.ChunkedArray):
        lex = lex.combine_chunks()
    offsets = lex.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    values = lex.flatten()
    nulls = lex.is_null().to_numpy(zero_copy_only=False)
    at_start = np.zeros(len(values), dtype=bool)
    starts = offsets[:-1][np.diff(offsets) > 0]
    at_start[starts] = True
    return values, offsets, nulls, at_start

PROFILE_FIELDS = ["tokens", "ntok", "nl", "ind", "ded", "final_depth", "max_depth",
                  "unmatched_closers", "open_left", "max_nesting", "stmts",
                  "e1", "e2", "e3", "e4", "e5", "errors"]
PROFILE_TYPE = T.StructType([T.StructField(f, T.IntegerType()) for f in PROFILE_FIELDS])


def _seg_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def _batch_emission(packed: np.ndarray, offsets: np.ndarray):
    """Vectorised over all texts of a batch: per kept lexeme, its text index,
    role, width, bracket depth after it and whether it is an emitted NEWLINE."""
    d = len(offsets) - 1
    n = packed.size
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(d), lengths)
    pos = np.arange(n) - offsets[:-1][doc]
    k = packed & 31
    longer = ((packed >> 5) & 1).astype(bool)
    width = packed >> 6
    last = pos == lengths[doc] - 1
    nxt_k = np.concatenate((k[1:], [-1]))
    nxt_long = np.concatenate((longer[1:], [False]))
    nxt_k[last] = -1
    nxt_long[last] = False
    quiet = ((nxt_k == 1) | (nxt_k == 12)) & (nxt_long | (pos + 2 < lengths[doc]))
    keep = ~((k == 0) | (k == 2) | (k == 12))
    ks, ws, qs, kd = k[keep], width[keep], quiet[keep], doc[keep]
    is_nl = (ks == 1) | (ks == 13) | (ks == 14)
    delta = (ks == 6).astype(np.int64) - (ks == 7)
    counts = np.bincount(kd, minlength=d)
    starts = _seg_starts(counts)
    cs = np.cumsum(delta)
    base = np.zeros(d, dtype=np.int64)
    has = counts > 0
    base[has] = (cs - delta)[starts[has]]
    depth = cs - base[kd]
    emit = is_nl & ((depth - delta) <= 0) & ~qs
    return k, doc, pos, keep, ks, ws, kd, is_nl, depth, emit, counts, starts


def _indent_moves(doc: np.ndarray, width: np.ndarray, d: int):
    """The indent stack over emitted line breaks (in document order): per break
    whether it opens a level and how many it closes; per document the levels
    left open and the deepest nesting."""
    push, pops = np.zeros(doc.size, dtype=bool), np.zeros(doc.size, dtype=np.int64)
    left, nest = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
    indented = np.unique(doc[width > 0])
    # one slice per document, found once
    lo, hi = np.searchsorted(doc, indented, "left"), np.searchsorted(doc, indented, "right")
    for di, a, b in zip(indented.tolist(), lo.tolist(), hi.tolist()):
        stack: list[int] = []
        deepest = 0
        for at, w in enumerate(width[a:b].tolist(), a):
            if w > (stack[-1] if stack else 0):
                stack.append(w)
                push[at] = True
                deepest = max(deepest, len(stack))
            else:
                while stack and stack[-1] > w:
                    stack.pop()
                    pops[at] += 1
        left[di], nest[di] = len(stack), deepest
    return push, pops, left, nest


def layout_rows(packed: np.ndarray, offsets: np.ndarray):
    """Layout tokens without text, in order: document, lexeme they follow,
    place after it and name id.  At the end of input the closing NEWLINE has
    place 0 of the position after the last lexeme."""
    d = len(offsets) - 1
    if not packed.size:
        return (np.zeros(0, dtype=np.int64),) * 4
    _, doc, pos, keep, _, ws, kd, _, _, emit, _, _ = _batch_emission(packed, offsets)
    where = np.flatnonzero(keep)[emit]
    push, pops, left, _ = _indent_moves(kd[emit], ws[emit], d)
    n = push + pops
    end = np.flatnonzero(left > 0)
    size = np.concatenate((n, left[end] + 1))
    docs = np.repeat(np.concatenate((doc[where], end)), size)
    at = np.repeat(np.concatenate((pos[where], np.diff(offsets)[end])), size)
    first = np.repeat(np.cumsum(size) - size, size)
    sub = np.arange(len(docs)) - first + np.repeat(np.concatenate((np.ones(len(n), dtype=np.int64), np.zeros(len(end), dtype=np.int64))), size)
    name = np.repeat(np.concatenate((np.where(push, INDENT, DEDENT), np.full(len(end), DEDENT))), size)
    name[sub == 0] = 1  # NEWLINE
    order = np.lexsort((sub, at, docs))
    return docs[order], at[order], sub[order], name[order]


def profile_batch(packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Profile rows (one per text, columns as ``PROFILE_FIELDS``) of a batch."""
    d = len(offsets) - 1
    out = np.zeros((d, len(PROFILE_FIELDS)), dtype=np.int64)
    if d == 0 or packed.size == 0:
        return out
    k, doc, pos, keep, ks, ws, kd, is_nl, depth, emit, counts, starts = _batch_emission(packed, offsets)
    unknown = k == 3
    prev_unknown = np.concatenate(([False], unknown[:-1])) & (pos > 0)
    e1 = np.bincount(doc[unknown & ~prev_unknown], minlength=d)

    has = counts > 0
    final_depth = np.zeros(d, dtype=np.int64)
    max_depth = np.zeros(d, dtype=np.int64)
    min_depth = np.zeros(d, dtype=np.int64)
    if has.any():
        final_depth[has] = depth[starts[has] + counts[has] - 1]
        max_depth[has] = np.maximum.reduceat(depth, starts[has])
        min_depth[has] = np.minimum.reduceat(depth, starts[has])
    max_depth = np.maximum(max_depth, 0)
    unmatched = np.maximum(-min_depth, 0)
    open_left = final_depth + unmatched

    seq = ~is_nl | emit
    t, e, wv, sd = ks[seq], emit[seq], ws[seq], kd[seq]
    m = np.bincount(sd, minlength=d)
    sstarts = _seg_starts(m)
    first = np.ones(t.size, dtype=bool)
    first[1:] = sd[1:] != sd[:-1]
    prev_t = np.concatenate(([-1], t[:-1]))
    prev_t[first] = -1
    prev_e = np.concatenate(([True], e[:-1]))
    prev_e[first] = True
    ntok = np.bincount(kd[~is_nl], minlength=d)
    nl = np.bincount(sd[e], minlength=d)
    operand = ((t == 4) | (t == 5)) & ~e
    prev_operand = np.concatenate(([False], operand[:-1])) & ~first
    pair = operand & prev_operand & ~((t == 5) & (prev_t == 5))
    line = np.cumsum(e | first)
    e5 = np.zeros(d, dtype=np.int64)
    if pair.any():
        _, idx = np.unique(line[pair], return_index=True)
        e5 = np.bincount(sd[pair][idx], minlength=d)
    stmts = np.bincount(sd[~e & prev_e & ~((t == 10) | (t == 11))], minlength=d)
    colon_before = (prev_t == 8) & ~prev_e

    idx_e = np.flatnonzero(e)
    doc_e, cb = sd[idx_e], colon_before[idx_e]
    push, pops, left, nest = _indent_moves(doc_e, wv[idx_e], d)
    ind = np.bincount(doc_e[push], minlength=d)
    ded = np.bincount(doc_e, pops, minlength=d).astype(np.int64)
    e3 = np.bincount(doc_e[push != cb], minlength=d)
    eof = left > 0
    send = sstarts + m - 1
    nonempty = m > 0
    last_tok = np.zeros(d, dtype=bool)
    last_colon = np.zeros(d, dtype=bool)
    last_tok[nonempty] = ~e[send[nonempty]]
    last_colon[nonempty] = last_tok[nonempty] & (t[send[nonempty]] == 8)
    nl = nl + eof
    ded = ded + left
    e3 = e3 + (eof & last_colon)
    e2 = unmatched + open_left
    e4 = (last_tok & ~eof & (open_left == 0)).astype(np.int64)
    tokens = ntok + nl + ind + ded
    cols = [tokens, ntok, nl, ind, ded, final_depth, max_depth, unmatched, open_left, nest, stmts,
            e1, e2, e3, e4, e5, e1 + e2 + e3 + e4 + e5]
    return np.stack(cols, axis=1).astype(np.int64)


def emit_batch(packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per lexeme of a batch: is it a line break the lexer emits as NEWLINE?"""
    out = np.zeros(packed.size, dtype=bool)
    if packed.size:
        r = _batch_emission(packed, offsets)
        keep, emit = r[3], r[9]
        out[np.flatnonzero(keep)] = emit
    return out


@F.arrow_udf(PROFILE_TYPE)
def profile_udf(lex: pa.Array) -> pa.Array:
    """Profile struct per text from its lexeme array."""
    return in_pieces(lex, _profiles)


def _profiles(lex: pa.Array) -> pa.Array:
    values, offsets, nulls, at_start = _flat(lex)
    cols = profile_batch(pack_roles(values, at_start), offsets)
    mask = pa.array(nulls)
    return pa.StructArray.from_arrays([pa.array(cols[:, j].astype(np.int32)) for j in range(cols.shape[1])],
                                      names=PROFILE_FIELDS, mask=mask)


ROLES_TYPE = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("emit", T.ArrayType(T.BooleanType())),
                           T.StructField("names", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(ROLES_TYPE)
def roles_udf(lex: pa.Array) -> pa.Array:
    """Per lexeme: packed role code, whether it is an emitted NEWLINE, and
    its token-name id (index into ``TOKEN_NAMES``)."""
    return in_pieces(lex, _roles)


def _roles(lex: pa.Array) -> pa.Array:
    values, offsets, nulls, at_start = _flat(lex)
    packed = pack_roles(values, at_start)
    emit = emit_batch(packed, offsets)
    names = name_ids(values, packed)
    off = pa.array(offsets.astype(np.int32))
    mask = pa.array(nulls)
    codes = pa.ListArray.from_arrays(off, pa.array(packed.astype(np.int32)), mask=mask)
    flags = pa.ListArray.from_arrays(off, pa.array(emit), mask=mask)
    ids = pa.ListArray.from_arrays(off, pa.array(names.astype(np.int32)), mask=mask)
    return pa.StructArray.from_arrays([codes, flags, ids], names=["codes", "emit", "names"])


BRACKETS_TYPE = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("match_pos", T.IntegerType()), T.StructField("same_kind", T.BooleanType())]))


def match_brackets(step: np.ndarray, doc: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Running depth after each bracket of a batch (``step`` is 1 or -1) and the index of
    its partner (-1: none).

    The depth is a prefix sum per text.  A bracket belongs to the level it opens or
    closes.  On one level openers and closers alternate (only the first may be
    a closer without opener), so sorted by level each opener's partner stands right behind it."""
    counts = np.bincount(doc, minlength=d)
    total = np.cumsum(step)
    depth = total - np.repeat((total - step)[_seg_starts(counts)[counts > 0]], counts[counts > 0])
    level = np.where(step > 0, depth, depth + 1)
    order = np.lexsort((np.arange(step.size), level, doc))
    one, two = order[:-1], order[1:]
    paired = (doc[one] == doc[two]) & (level[one] == level[two]) & (step[one] > 0)
    partner = np.full(step.size, -1, dtype=np.int64)
    partner[one[paired]], partner[two[paired]] = two[paired], one[paired]
    return depth, partner


@F.arrow_udf(BRACKETS_TYPE)
def brackets_udf(lex: pa.Array) -> pa.Array:
    """Every bracket of a text: place, running depth after it, place of its partner
    (null: none) and whether both are of one kind."""
    return in_pieces(lex, _brackets)


def _brackets(lex: pa.Array) -> pa.Array:
    values, offsets, nulls, at_start = _flat(lex)
    k = pack_roles(values, at_start) & 31
    d = len(offsets) - 1
    doc = np.repeat(np.arange(d), np.diff(offsets))
    at = np.flatnonzero((k == 6) | (k == 7))
    of, pos = doc[at], at - offsets[:-1][doc[at]]
    depth, partner = match_brackets(np.where(k[at] == 6, 1, -1), of, d)
    kind = _first_bytes(values)[at]
    kind = np.where((kind == 40) | (kind == 41), 0, np.where((kind == 91) | (kind == 93), 1, 2))
    alone = partner < 0
    rows = pa.StructArray.from_arrays([
        pa.array(pos.astype(np.int32)), values.take(pa.array(at)), pa.array(depth.astype(np.int32)),
        pa.array(pos[partner].astype(np.int32), mask=alone), pa.array(kind == kind[partner], mask=alone)], names=["pos", "text", "depth", "match_pos", "same_kind"])
    cuts = np.searchsorted(of, np.arange(d + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), rows, mask=pa.array(nulls))


TOKENS_SCHEMA = "pos int, sub int, name int, text string, hidden boolean"


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: (key, lexemes) to all tokens of the texts in order, layout
    tokens included; one batch of rows for each piece of an input batch."""
    for batch in batches:
        key, lex, at = batch.column(0), batch.column(1), 0
        for piece in pieces(lex):
            docs, rows = _tokens(piece)
            yield pa.RecordBatch.from_arrays([key.slice(at, len(piece)).take(pa.array(docs)), *rows],
                                             names=[batch.schema.names[0], "pos", "sub", "name", "text", "hidden"])
            at += len(piece)


def _tokens(lex: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Per token of some texts, in order: the text's place, and the columns of ``TOKENS_SCHEMA``."""
    values, offsets, _, at_start = _flat(lex)
    packed = pack_roles(values, at_start)
    k = packed & 31
    hidden = np.isin(k, (0, 2, 12)) | (np.isin(k, (1, 13, 14)) & ~emit_batch(packed, offsets))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    docs, at, sub, name = (np.concatenate(both) for both in zip(
        (doc, np.arange(len(doc)) - offsets[:-1][doc], np.zeros(len(doc), dtype=np.int64), name_ids(values, packed)), layout_rows(packed, offsets)))
    text = pa.concat_arrays([values, pa.array([""] * (len(docs) - len(doc)), values.type)])
    hidden = np.concatenate((hidden, np.zeros(len(docs) - len(doc), dtype=bool)))
    order = np.lexsort((sub, at, docs))
    return docs[order], [*(pa.array(x[order].astype(np.int32)) for x in (at, sub, name)), text.take(pa.array(order)), pa.array(hidden[order])]


def unknown_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: characters no rule accepts, counted for each piece of an input batch."""
    for batch in batches:
        for piece in pieces(batch.column(0)):
            values, _, _, at_start = _flat(piece)
            unknown = np.flatnonzero((pack_roles(values, at_start) & 31) == 3)
            found = pc.value_counts(values.take(pa.array(unknown)))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["ch", "n"])


# Token names by id: fixed classes first, then the grammar's keyword and
# operator names in grammar order.
_FIXED_NAMES = ["SKIP_", "NEWLINE", "STRING", "NUMBER", "NAME", "UNKNOWN_CHAR"]
_KW_OPS = G.PY_KEYWORDS + G.PY_OPERATORS
TOKEN_NAMES = _FIXED_NAMES + [n for _, n in _KW_OPS] + ["INDENT", "DEDENT"]
INDENT, DEDENT = len(TOKEN_NAMES) - 2, len(TOKEN_NAMES) - 1
_KW_OPS_ARROW = pa.array([t for t, _ in _KW_OPS], pa.string())
HISTOGRAM_SCHEMA = "name string, n bigint"


def name_ids(values: pa.Array, packed: np.ndarray) -> np.ndarray:
    """Index into ``TOKEN_NAMES`` of every lexeme (SKIP_ for blanks,
    comments and line joins; NEWLINE for every line-break candidate)."""
    k = packed & 31
    out = np.full(k.size, 4, dtype=np.int64)  # NAME
    out[(k == 0) | (k == 2) | (k == 12)] = 0
    out[(k == 1) | (k == 13) | (k == 14)] = 1
    out[k == 5] = 2
    out[k == 3] = 5
    cand = np.flatnonzero((k == 4) | ((k >= 6) & (k <= 11)))
    if cand.size:
        sub = values.take(pa.array(cand))
        pos = pc.index_in(sub, value_set=_KW_OPS_ARROW).fill_null(-1)
        pos = pos.to_numpy(zero_copy_only=False).astype(np.int64)
        known = pos >= 0
        out[cand[known]] = len(_FIXED_NAMES) + pos[known]
        rest = cand[~known]
        if rest.size:
            b = _first_bytes(values.take(pa.array(rest)))
            longer = ((packed[rest] >> 5) & 1).astype(bool)
            number = ((b >= 48) & (b <= 57)) | ((b == 46) & longer)
            out[rest[number]] = 3
    return out


def name_counts(lex: pa.Array) -> dict:
    """Token-name counts of a batch of lexeme arrays, layout tokens included."""
    values, offsets, nulls, at_start = _flat(lex)
    packed = pack_roles(values, at_start)
    ids = name_ids(values, packed)
    counts: dict = {}
    visible = ids[(ids != 0) & (ids != 1)]
    if visible.size:
        for j, c in zip(*np.unique(visible, return_counts=True)):
            counts[TOKEN_NAMES[int(j)]] = int(c)
    prof = profile_batch(packed, offsets)
    for j, name in ((2, "NEWLINE"), (3, "INDENT"), (4, "DEDENT")):
        v = int(prof[~nulls, j].sum()) if len(nulls) else 0
        if v:
            counts[name] = counts.get(name, 0) + v
    return counts


def histogram_batches(batches):
    """``mapInArrow`` body: one small (name, n) table per input batch."""
    for b in batches:
        counts: Counter = Counter()
        for piece in pieces(b.column(0)):
            counts.update(name_counts(piece))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["name", "n"])
