"""Personal data: fixed patterns, and a semi-Markov conditional random field.

``base_spans`` finds what the four fixed patterns define; these spans always
stay, and the counts ``n_email`` to ``n_phone`` and ``base_sha256`` are theirs alone, so
they do not depend on what was learned; ``spans`` lists all.  Beyond them, people write addresses and numbers in other ways ("name at
host dot com", a phone number without its plus).  Everywhere
outside base spans a semi-Markov CRF scores every candidate segment of up to
``LONGEST`` tokens as a whole (its shape, digit groups, check sum, separators,
neighbours) and dynamic programming over segment ends chooses boundaries and
kinds jointly; single tokens may also be nothing.  A segment must beat nothing
by ``MARGIN``.

The CRF is trained here, by gradient steps on the conditional likelihood, on
windows from a bounded, deterministic sample: ``TRAIN_ROWS`` rows, of each at
most ``SPANS_A_TEXT`` spans and ``WINDOWS_A_TEXT`` windows of ``WINDOW_CHARS``
characters, and ``EXAMPLES`` windows per kind.  They hold base
spans as written, the same spans rewritten in the usual evasive ways (forms of at
most ``LONGEST`` tokens), and no personal data.  Without base spans in the
sample nothing is added to the base.  These bounds concern training only: every
whole text is searched.

Rows: null counts as empty; texts without a digit or at-sign (or its word) have
no spans; offsets are code points, end exclusive; repeated rows give equal
results; an empty table gives no rows; extra columns are not read.  Of equally
good segments that end at one place the one that begins first is taken.
Very long texts take time in proportion; decoding looks at ``BLOCK`` tokens at
a time, keeping the best path to each of the last ``LONGEST`` places.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm.common import documents, map_rows, share_of, texts

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 3000
#: Training windows per kind (and without personal data) from the sample.
EXAMPLES = 300
SPANS_A_TEXT = 8
WINDOWS_A_TEXT = 4
WINDOW_CHARS = 400
LONGEST = 24
MARGIN = 1.0
#: A candidate has this many digits or an at-sign (or its word), and without letters not more than MOST_DIGITS.
DIGITS = 4
MOST_DIGITS = 24
BLOCK = 512
#: Digitless kinds of segments whose score a task remembers.
KNOWN = 1 << 16

Span = tuple[str, int, int]

# ---------------------------------------------------------------- base

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > end and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            if at < m.start():
                end = m.end()
                out.append(("email", at, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_DIGIT = re.compile("[0-9]")

# ---------------------------------------------------------------- segments

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
#: Places a candidate needs: digits, at-signs and their spelled forms.
_TRIGGER = re.compile(r"[0-9][0-9 ().\[\]/_+-]{4,}[0-9]|@|[\[({ ](?:at|AT)[\])} ](?=.{1,60}?(?:\.|dot|DOT))")
_AT = re.compile(r"@|[\[({ ]at[\])} ]", re.I)
_LOOSE = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({]?(?:@| at |at)[\])}]? ?[A-Za-z0-9-]+(?:(?:\.| dot |[\[(]dot[\])])[A-Za-z0-9-]+)*(?:\.| dot |[\[(]dot[\])])[A-Za-z]{2,6}", re.I)
REACH = 64  # characters of context on either side of a trigger
#: What every candidate holds: digits (some, and all else, beyond U+FFFF), an at-sign or its word.
_SIGN = re.compile("[@" + "".join(chr(c) for c in range(0x10000) if chr(c).isdigit()) + "\U00010000-\U0010ffff]")
_AT_WORD = re.compile(r"[aA][tT](?<![^\W\d_][aA][tT])(?![^\W\d_])")
_SPACE = re.compile(r"\s")
_WORDS = re.compile(rf"(?:\s++\S++){{0,{LONGEST}}}+")


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Stretches covered by spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Stretches of the text around triggers between the spans ``taken``, merged."""
    out: list[tuple[int, int]] = []
    start = 0
    for stop, after in [*merged(taken), (len(text), len(text))]:
        for m in _TRIGGER.finditer(text, start, stop):
            a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        start = after
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The text without what is further than ``LONGEST`` words from digits, at-signs and the word: no
    candidate lies or looks outside.  They begin and end at white space."""
    out: list[tuple[int, int]] = []
    word = 0  # end of the word of the anchor before
    for at in heapq.merge((m.start() for m in _SIGN.finditer(text)), (m.start() for m in _AT_WORD.finditer(text))):
        if at < word:
            continue
        space = _SPACE.search(text, at)
        word = space.start() if space else len(text)
        end = _WORDS.match(text, word).end()
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
            continue
        size = 256
        while len(words := text[max(0, at - size):at].rsplit(None, LONGEST + 1)) < LONGEST + 2 and size < at:
            size *= 4
        a = max(0, at - size) + len(words[0]) if len(words) == LONGEST + 2 else 0
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((a, end))
    return out


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


@functools.lru_cache(1 << 16)
def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", "9", s)
    s = re.sub(r"\bat\b", "@", re.sub(r"\bdot\b", ".", s, flags=re.I), flags=re.I)
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"\s+", "_", s)


def _side(c: str) -> str:
    return "space" if c.isspace() else "word" if c.isalnum() else c


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span ``text[a:b]``; as many for every span."""
    s = text[a:b]
    runs = re.findall("[0-9]+", s)
    digits = "".join(runs)
    shape = _shape(s)
    left = text[a - 1] if a else " "
    right = text[b] if b < len(text) else " "
    has_at = "@" if "@" in s else "word" if _AT.search(s) else "-"
    return [
        "shape " + shape if len(shape) <= 24 else "shape long",
        f"digits {_bucket(len(digits), (1, 4, 7, 9, 10, 11, 12, 14, 15, 16, 17, 20))}",
        f"runs {min(len(runs), 6)}",
        f"longest {_bucket(max(map(len, runs), default=0), (1, 2, 3, 4, 5, 7, 10, 14, 17))}",
        f"check {14 <= len(digits) <= 19 and luhn(digits)}",
        f"quad {len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs)}",
        "at " + has_at,
        f"mail {has_at != '-' and bool(_LOOSE.fullmatch(s))}",
        "first " + (shape[:1] or "-"),
        "signs " + "".join(sorted(set(re.sub("[9a]", "", shape)))),
        "left " + _side(left),
        "right " + _side(right),
        f"letters {has_at == '-' and 'a' in shape}",
        "bias",
    ]


N_FEATURES = 14
SLOTS = 1 << 14


def _index(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def segments_of(text: str, tokens: list[tuple[int, int]], starts: int, taken: list[tuple[int, int]] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Candidate segments (first token, token after the last) that begin in the first ``starts``
    tokens and touch none of the stretches ``taken``, which are in order."""
    kind = ["9" if text[a].isdigit() else "a" if text[a].isalpha() else text[a] for a, _ in tokens]
    for x, y in taken:
        for k in range(bisect.bisect_left(tokens, x, key=lambda t: t[1] - 1), len(tokens)):
            if tokens[k][0] >= y:
                break
            kind[k] = ""
    anchor = [k == "9" or k == "@" or (k == "a" and b - a == 2 and text[a:b].lower() == "at") for k, (a, b) in zip(kind, tokens)]
    near, places = len(tokens) + LONGEST, [0] * len(tokens)  # the next anchor of each token
    for i in range(len(tokens) - 1, -1, -1):
        near = places[i] = i if anchor[i] else near
    out = []
    for i in range(starts):
        if kind[i] not in ("9", "a", "+", "(") or places[i] >= i + LONGEST:
            continue
        digits, at, letters = 0, False, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            k = kind[j]
            if not k:
                break
            if k == "9":
                digits += tokens[j][1] - tokens[j][0]
            letters = letters or k == "a"
            if digits > MOST_DIGITS and not letters:
                break
            at = at or (anchor[j] and k != "9")
            if (digits >= DIGITS or (at and j > i + 1)) and k in ("9", "a"):
                out.append((i, j + 1))
    return out


def _rows(text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int]]) -> np.ndarray:
    rows = [_index(features(text, tokens[i][0], tokens[j - 1][1])) for i, j in segments]
    return np.array(rows, np.int64).reshape(len(rows), N_FEATURES)


class Field:
    """The CRF: one weight per kind and hashed feature."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), SLOTS)) if weights is None else weights
        self.known: dict[tuple, tuple[int, float]] = {}  # of decoding, whose weights stay

    def best(self, text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int]]) -> tuple[list[int], list[float]]:
        """The best kind of each segment (by first token), and its score beyond nothing.  The features
        of segments without digits depend on few things, by which their scores are remembered."""
        kinds, best = [0] * len(segments), [0.0] * len(segments)
        ask, keys = [], []
        # of each token: its sign in a shape, and whether a mail may end with it; and sums up to it
        signs, parts, ends, hard, at_signs, at_words = [], [], [], [0], [0], [0]
        for a, b in tokens:
            c, before = text[a], text[a - 1] if a else ""
            at_signs.append(at_signs[-1] + (c == "@"))
            word = 0
            if c.isalpha():
                low = text[a:b].lower()
                ends.append(2 <= b - a <= 6 and before != "" and (before in ".])" or (before == " " and signs[-1:] == ["."])))
                word = low == "at" and before != "" and before in "[({ " and b < len(text) and text[b] in "])} "
                c = "@" if low == "at" else "." if low == "dot" else "a"
                hard.append(hard[-1])
            else:
                ends.append(False)
                hard.append(hard[-1] + (c == "_" or c.isalnum()))
            at_words.append(at_words[-1] + word)
            signs.append(c)
            parts.append("_" + c if before.isspace() else c)
        now, upto, shape, others, letters, left = -1, 0, "", "", False, ""
        for n, (i, j) in enumerate(segments):
            if hard[j] != hard[i]:
                ask.append(n)
                keys.append(None)
                continue
            a, b = tokens[i][0], tokens[j - 1][1]
            if i != now:
                now, upto, shape, letters, left = i, i + 1, signs[i], signs[i] == "a", _side(text[a - 1] if a else " ")
                others = "" if letters else shape
            for part in parts[upto:j]:
                if len(shape) <= 24:
                    shape += part
                for c in part:
                    if c == "a":
                        letters = True
                    elif c not in others:
                        others = "".join(sorted(others + c))
            upto = j
            at = "@" if at_signs[j] != at_signs[i] else "word" if j > i + 2 and at_words[j - 1] != at_words[i + 1] else "-"
            mail = ends[j - 1] and at != "-" and bool(_LOOSE.fullmatch(text, a, b))
            key = (shape if len(shape) <= 24 else (signs[i], letters, others), at, mail, left, _side(text[b] if b < len(text) else " "))
            got = self.known.get(key)
            if got is None:
                ask.append(n)
                keys.append(key)
            else:
                kinds[n], best[n] = got
        if ask:
            scores = self.weights[:, _rows(text, tokens, [segments[n] for n in ask])].sum(2) - MARGIN
            for n, key, y, score in zip(ask, keys, scores.argmax(0).tolist(), scores.max(0).tolist()):
                kinds[n], best[n] = y, score
                if key is not None and len(self.known) < KNOWN:
                    self.known[key] = y, score
        return kinds, best

    @staticmethod
    def prepare(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments = segments_of(text, tokens, len(tokens))
        return tokens, segments, _rows(text, tokens, segments)

    def decode(self, text: str, start: int = 0, stop: int | None = None, taken: list[tuple[int, int]] = []) -> list[Span]:  # noqa: B006
        """The best segments of ``text[start:stop]`` outside the stretches ``taken`` (in order), a block of tokens at a time."""
        text = text[start:stop]
        taken = [(a - start, b - start) for a, b in taken[bisect.bisect_right(taken, start, key=lambda t: t[1]):bisect.bisect_left(taken, start + len(text), key=lambda t: t[0])]]
        source = _TOKEN.finditer(text)
        ahead: list[tuple[int, int]] = []  # tokens from place ``at`` on
        at, value, chain = 0, 0.0, None  # the best path to a place: its value and its spans
        waiting: dict[int, tuple[float, tuple]] = {}  # the best last segment to a later place
        while True:
            ahead += [m.span() for m in itertools.islice(source, BLOCK + LONGEST - len(ahead))]
            if not ahead:
                break
            starts = min(BLOCK, len(ahead))
            inside = taken[bisect.bisect_right(taken, ahead[0][0], key=lambda t: t[1]):bisect.bisect_left(taken, ahead[-1][1], key=lambda t: t[0])]
            segments = segments_of(text, ahead, starts, inside)
            kinds, best = self.best(text, ahead, segments)
            begins: dict[int, list[int]] = {}
            for k, score in enumerate(best):
                if score > 0:
                    begins.setdefault(segments[k][0], []).append(k)
            for i in range(starts):
                for k in begins.get(i, ()):
                    end = segments[k][1]
                    if at + end not in waiting or value + best[k] > waiting[at + end][0]:
                        span = (KINDS[kinds[k]], start + ahead[i][0], start + ahead[end - 1][1])
                        waiting[at + end] = (value + best[k], (chain, span))
                got = waiting.pop(at + i + 1, None)
                if got and got[0] > value:
                    value, chain = got
            at += starts
            del ahead[:starts]
        out = []
        while chain is not None:
            chain, span = chain
            out.append(span)
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Gradient ascent on the conditional log likelihood (AdaGrad steps)."""
        ready = []
        for text, gold in examples:
            tokens, segments, rows = self.prepare(text)
            if not segments:
                continue
            where = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j) in enumerate(segments)}
            ready.append((len(tokens), segments, rows, [(KINDS.index(y), where[a, b]) for y, a, b in gold if (a, b) in where]))
        square = np.full(self.weights.shape, 1e-6)
        for _ in range(rounds):
            for n, segments, rows, gold in ready:
                scores = self.weights[:, rows].sum(2)
                whole = np.logaddexp.reduce(scores, 0)
                forward, backward = np.zeros(n + 1), np.zeros(n + 1)
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for k, (i, j) in enumerate(segments):
                    by_end.setdefault(j, []).append(k)
                    by_start.setdefault(i, []).append(k)
                for j in range(1, n + 1):
                    forward[j] = functools.reduce(np.logaddexp, (forward[segments[k][0]] + whole[k] for k in by_end.get(j, ())), forward[j - 1])
                for i in range(n - 1, -1, -1):
                    backward[i] = functools.reduce(np.logaddexp, (backward[segments[k][1]] + whole[k] for k in by_start.get(i, ())), backward[i + 1])
                at = np.array(segments)
                chance = -np.exp(scores + forward[at[:, 0]] + backward[at[:, 1]] - forward[n])
                for y, k in gold:
                    chance[y, k] += 1
                for y in range(len(KINDS)):
                    step = np.bincount(rows.ravel(), np.repeat(chance[y], N_FEATURES), SLOTS)
                    used = np.flatnonzero(step)
                    g = step[used] - decay * self.weights[y, used]
                    square[y, used] += g * g
                    self.weights[y, used] += rate * g / np.sqrt(square[y, used])


# ---------------------------------------------------------------- training data


def rewritten(kind: str, s: str) -> list[str]:
    """Usual evasive ways to write a span."""
    d = digits_of(s)
    if kind == "email":
        local, _, host = s.partition("@")
        return [f"{local} at {host.replace('.', ' dot ')}", f"{local}[at]{host}", f"{local} (at) {host}", f"{local} at {host}", f"{local}(at){host.replace('.', '(dot)')}", f"{local} @ {host}"]
    if kind == "ip":
        return [s.replace(".", x) for x in ("[.]", " . ", "(.)", " dot ")]
    if kind == "card":
        groups = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [x.join(groups) for x in (".", "_", "  ", "/", " - ")]
    n = d[-10:]
    return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"{d[:-10]} ({n[:3]}) {n[3:6]}-{n[6:]}",
            f"00{d[:-10]} {n[:3]} {n[3:6]} {n[6:]}", f"+{d[:-10]} / {n[:3]} / {n[3:6]}{n[6:]}"]


def examples(found: list[str]) -> list[tuple[str, list[Span]]]:
    """Labelled windows from sample texts: as written, rewritten, and without personal data."""
    out = []
    for text in found:
        spans = base_spans(text)
        for kind, a, b in spans:
            if any(x < b and a < y for k, x, y in spans if (k, x, y) != (kind, a, b)):
                continue
            lead, tail = text[max(0, a - 30):a], text[b:b + 30]
            if base_spans(lead) or base_spans(tail) or _DIGIT.search(lead + tail):
                continue
            for new in [text[a:b], *rewritten(kind, text[a:b])]:
                if len(_TOKEN.findall(new)) > LONGEST:
                    continue
                if not [s for s in base_spans(lead + new + tail) if s != (kind, len(lead), len(lead) + len(new))]:
                    out.append((lead + new + tail, [(kind, len(lead), len(lead) + len(new))]))
        for a, b in windows(text, spans):
            if not any(x < b and a < y for _, x, y in spans):
                out.append((text[a:b], []))
        for k, m in enumerate(re.finditer(r"(?<= )[0-9]{14,19}(?= )", text)):  # numbers that fail the check, grouped
            if not luhn(m.group()):
                out.append((f"on {'. -_'[k % 4].join(m.group()[i:i + 4] for i in range(0, len(m.group()), 4))} in", []))
    return out


#: Dates, times, versions and amounts are no personal data.
PLAIN = ["on 2024-01-31 at 10:15:30 in", "from 31.12.1999 to 01.01.2000", "version 10.4.22.1087 of 2021", "costs 1,234,567.89 or 12 345 678 in all",
         "pages 123-456, 789-1011", "ISBN 978-3-16-148410-0", "2024/05/17 08.30.15", "tel at 5 or 6 dot", "met at noon dot", "they are at 2023-11-05 dot net", "id 0123456789abcdef0123456789abcdef"]


def train(docs: DataFrame) -> Field:
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    n = rows.count()
    if n > TRAIN_ROWS:
        rows = rows.filter(share_of(F.col("doc_id"), "personal", TRAIN_ROWS / n))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:  # only bounded surroundings of spans leave the tasks
        out = []
        for t in texts(batch):
            spans = base_spans(t)
            out += [t[max(0, a - 40):b + 40] for _, a, b in spans[:SPANS_A_TEXT]]
            out += [t[a:min(b, a + WINDOW_CHARS)] for a, b in windows(t, spans)[:WINDOWS_A_TEXT]]
        return pa.record_batch([pa.array(out, pa.string())], names=["text"])

    found = sorted({r["text"] for r in map_rows(rows.select("text"), "text string", kernel).collect()}, key=lambda t: zlib.crc32(t.encode()))
    field = Field()
    labelled = examples(found)
    by_kind: dict[str, list] = {}
    for example in labelled:
        by_kind.setdefault(example[1][0][0] if example[1] else "", []).append(example)
    if set(by_kind) - {""}:
        chosen = [e for k in sorted(by_kind) for e in by_kind[k][:EXAMPLES]] + [(t, []) for t in PLAIN] * 3
        field.train(sorted(chosen, key=lambda e: zlib.crc32(e[0].encode())))
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with what the field adds: its best segments of the whole text outside base spans."""
    base = base_spans(text)
    taken = merged(base)
    added = [span for a, b in stretches(text) for span in field.decode(text, a, b, taken)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FIELDS: list[Field] = []


def _field(weights: np.ndarray) -> Field:
    """The field of these weights, with what the worker's batches before have remembered."""
    if not _FIELDS or _FIELDS[0].weights is not weights:
        _FIELDS[:] = [Field(weights)]
    return _FIELDS[0]


def forget() -> None:
    _FIELDS.clear()


def find(docs: DataFrame, field: Field) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)  # a fixed size

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = _field(shared.value)
        counts: list[list[int]] = [[] for _ in KINDS]
        sha, spans = [], []
        for t in texts(batch):
            base, every = all_spans(t, field)
            for n, kind in zip(counts, KINDS):
                n.append(sum(k == kind for k, _, _ in base))
            sha.append(hashlib.sha256(written_out(base).encode()).hexdigest())
            spans.append(written_out(every))
        return pa.record_batch([batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(sha), pa.array(spans, pa.string())],
                               names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", kernel)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, train(docs))
