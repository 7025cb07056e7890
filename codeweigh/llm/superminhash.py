"""Shingle sets and SuperMinHash signatures, vectorised over a batch of documents.

Step ``j`` gives each element one slot, the ``j``-th of its own permutation of
the slots, and the value ``j`` plus a random fraction; a slot keeps its least
value.  So within one element the ranks are correlated: every slot gets a
different integer part, which lowers the variance against independent hashes.
Once a document's largest slot value is below the next step, later steps can
change nothing and the document stops: long documents after two or three
steps, whatever the number of slots.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
SLOTS = 128
ROWS = 4
BANDS = SLOTS // ROWS
_FRACTION = np.uint64(25)  # bits of the random fraction; the step stands above
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Known words per worker; the table is emptied beyond this.
CACHE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_NAMES = _Names()


def word_names(found: list[bytes]) -> np.ndarray:
    """One 64-bit name per word."""
    return np.fromiter(map(_NAMES.__getitem__, found), np.uint64, len(found))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct names of all 5-word shingles; all words as one if fewer; empty without words."""
    w = word_names(words(text))
    if not len(w):
        return w
    if len(w) < WORDS:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = mix(h * _PLACE[0] + x)
        return h
    h = np.zeros(len(w) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        h += w[k:len(w) - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS values per non-empty set."""
    docs = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if docs else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(docs, dtype=np.int64), sizes)
    step_by = mix(element ^ _PLACE[1]) | np.uint64(1)  # odd: multiples run through all slots
    first = mix(element ^ _PLACE[2])
    out = np.full(docs * SLOTS, np.iinfo(np.uint32).max, np.uint32)
    for j in range(SLOTS):
        slot = first + np.uint64(j) * step_by
        at = owner * SLOTS + (slot & np.uint64(SLOTS - 1)).astype(np.int64)
        value = (np.uint64(j) << _FRACTION | mix(element + np.uint64((j + 1) * int(_PLACE[3]) % (1 << 64))) >> np.uint64(64) - _FRACTION).astype(np.uint32)
        np.minimum.at(out, at, value)
        open_doc = (out.reshape(docs, SLOTS).max(1) >> np.uint32(25)) > j
        if not open_doc.any():
            break
        if not open_doc.all():
            keep = open_doc[owner]
            element, owner, step_by, first = element[keep], owner[keep], step_by[keep], first[keep]
            if not len(owner):
                break
    return out.reshape(docs, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (the band's number is in it)."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[4], parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * _PLACE[0] + parts[:, :, k])
    return h
