"""Recompression of token sequences, vectorised over a batch of documents.

A round names what stands next to each other: the first names maximal runs of
one symbol by (symbol, length), and every round names pairs of a
"left" symbol followed by a "right" one, where a bit of the symbol's own name
decides its side.  A name is a hash of what it stands for, so all tasks of all
Spark jobs give the same name to the same string without asking each other;
whatever is found by names is verified on the words.

What becomes of a symbol depends on its neighbours alone, so in two equal
windows the same interior symbols arise, whatever stands around them.  Per
window we follow the range of symbols that its own words settle (its core):
the naming of runs takes one run off either end, each naming of pairs takes a
right symbol off the start and a left one off the end.  On the last round that
leaves a core of ``BLOCK`` symbols, blocks of so many neighbouring symbols get
a name too, and the core's block of the least name is the window's anchor: a
function of the window's words only.  Neighbouring windows mostly share it, so
a text has far fewer anchors than words, and an anchor spans many words.
"""

from __future__ import annotations

import numpy as np

from codeweigh.llm.superminhash import mix

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mod(x: int) -> np.uint64:
    return np.uint64(x % (1 << 64))


class Names:
    """64-bit names of any word range of a sequence, from prefix sums."""

    _base, _back = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray, second: bool = False):
        n = len(words) + 1
        if len(Names._powers) < n:
            Names._powers, Names._inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
                                             for b in (np.uint64(Names._base), np.uint64(Names._back)))
        if second:
            words = mix(words ^ _P[3])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * Names._powers[:n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * Names._inverse[start]
        return mix(h + np.asarray(size).astype(np.uint64) * _P[0])


#: Rounds of naming, and symbols in a block.
ROUNDS = 3
BLOCK = 8


def anchors(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of a window: the anchor's name, round and first word."""
    symbol, first = words, np.arange(len(words))
    name = np.zeros(len(starts), np.uint64)
    level = np.zeros(len(starts), np.int16)
    place = np.zeros(len(starts), np.int64)
    active, lo, hi = np.arange(len(starts)), starts, starts + window
    settled = []  # per round: windows with a core, their core, and the symbols
    for round_ in range(ROUNDS + 1):
        keep = hi - lo >= BLOCK
        active, lo, hi = active[keep], lo[keep], hi[keep]
        if not len(active):
            break
        settled.append((active, lo, hi, symbol, first))
        if round_ == 0:
            new = np.empty(len(symbol), bool)
            new[0], new[1:] = True, symbol[1:] != symbol[:-1]
            run = np.cumsum(new) - 1
            lo, hi = run[lo] + 1, run[hi - 1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(symbol)))
            symbol, first = symbol[at], first[at]
            symbol = np.where(size > 1, mix(symbol * _P[1] + size.astype(np.uint64)), symbol)
            keep = lo < hi
            active, lo, hi = active[keep], lo[keep], hi[keep]
            if not len(active):
                break
        right = (mix(symbol ^ _mod((round_ + 1) * int(_P[0]))) & np.uint64(1)).astype(bool)
        second = np.zeros(len(symbol), bool)
        second[1:] = right[1:] & ~right[:-1]
        index = np.cumsum(~second) - 1
        lo = lo + right[lo]
        hi = hi - ~right[hi - 1]
        keep = lo < hi
        active, lo, hi = active[keep], lo[keep], hi[keep]
        lo, hi = index[lo], index[hi - 1] + 1
        at = np.flatnonzero(~second)
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = second[1:]
        following = np.append(symbol[1:], np.uint64(0))
        symbol, first = np.where(pair, mix(symbol * _P[0] + following * _P[2]), symbol)[at], first[at]
    done = np.zeros(len(starts), bool)
    for round_ in range(len(settled) - 1, -1, -1):
        active, lo, hi, symbol, first = settled[round_]
        open_ = ~done[active]
        active, lo, hi = active[open_], lo[open_], hi[open_]
        if len(active):
            block = _blocks(symbol, round_)
            at = _least(block, lo, hi - BLOCK + 1)
            name[active], level[active], place[active] = block[at], round_, first[at]
            done[active] = True
    return name, level, place


def _blocks(symbol: np.ndarray, round_: int) -> np.ndarray:
    """Names of all blocks of neighbouring symbols."""
    h = np.full(len(symbol) - BLOCK + 1, round_ + 1, np.uint64)
    for k in range(BLOCK):
        h = h * _P[1] + symbol[k:len(symbol) - BLOCK + 1 + k]
    return mix(h)


def _least(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the (leftmost) least value in each range [lo, hi), by doubling."""
    out = np.empty(len(lo), np.int64)
    table, width = np.arange(len(value)), 1
    size = hi - lo
    while True:
        now = (size >= width) & (size < 2 * width)
        if now.any():
            a, b = table[lo[now]], table[hi[now] - width]
            out[now] = np.where(value[a] <= value[b], a, b)
        if not (size >= 2 * width).any():
            return out
        a, b = table[:-width], table[width:]
        table, width = np.where(value[a] <= value[b], a, b), 2 * width
