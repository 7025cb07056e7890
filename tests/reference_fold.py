"""Per-text fold, the reference that the batch fold of the library is tested against."""

import numpy as np

from codeweigh.functions.layout import PROFILE_FIELDS

_NL = (1, 13, 14)
_SKIP = (0, 2, 12)


def _emission(p: np.ndarray):
    """Role codes, kept mask, and for kept lexemes: widths, bracket depth
    after each one, and which line-break candidates become NEWLINE tokens."""
    n = p.size
    k = p & 31
    longer = (p >> 5) & 1
    width = p >> 6
    # the lexer drops a line break when the next character is CR, LF or '#'
    # and one more character follows it
    nxt_k = np.concatenate((k[1:], [-1]))
    nxt_long = np.concatenate((longer[1:], [0])).astype(bool)
    after_next = np.arange(n) + 2 < n
    quiet = np.isin(nxt_k, (1, 12)) & (nxt_long | after_next)
    keep = ~np.isin(k, _SKIP)
    ks, ws, qs = k[keep], width[keep], quiet[keep]
    is_nl = np.isin(ks, _NL)
    delta = (ks == 6).astype(np.int64) - (ks == 7)
    depth = np.cumsum(delta)
    emit = is_nl & ((depth - delta) <= 0) & ~qs
    return k, keep, ks, ws, is_nl, depth, emit


def emit_flags_one(packed) -> list:
    """Per lexeme: is it a line break the lexer emits as NEWLINE?  (Per-text
    reference for :func:`emit_batch`; the property tests compare the two.)"""
    p = np.asarray(packed, dtype=np.int64)
    if p.size == 0:
        return []
    _, keep, _, _, _, _, emit = _emission(p)
    out = np.zeros(p.size, dtype=bool)
    out[np.flatnonzero(keep)] = emit
    return out.tolist()


def profile_one(packed) -> tuple:
    """Profile of one text from its packed role vector.  (Per-text reference
    for :func:`profile_batch`, which the UDFs use; tests compare the two.)"""
    p = np.asarray(packed, dtype=np.int64)
    if p.size == 0:
        return (0,) * len(PROFILE_FIELDS)
    k, keep, ks, ws, is_nl, depth, emit = _emission(p)
    unknown = k == 3
    e1 = int(np.count_nonzero(unknown & ~np.concatenate(([False], unknown[:-1]))))
    tok = ~is_nl

    final_depth = int(depth[-1]) if depth.size else 0
    max_depth = max(0, int(depth.max())) if depth.size else 0
    unmatched = max(0, -int(depth.min())) if depth.size else 0
    open_left = final_depth + unmatched

    seq = tok | emit
    t, e, wv = ks[seq], emit[seq], ws[seq]
    m = t.size
    ntok = int(np.count_nonzero(tok))
    nl = int(np.count_nonzero(e))
    prev_t = np.concatenate(([-1], t[:-1]))
    prev_e = np.concatenate(([True], e[:-1]))

    operand = np.isin(t, (4, 5)) & ~e
    prev_operand = np.concatenate(([False], operand[:-1]))
    pair = operand & prev_operand & ~((t == 5) & (prev_t == 5))
    line = np.cumsum(e)
    e5 = int(np.unique(line[pair]).size)
    stmts = int(np.count_nonzero(~e & prev_e & ~np.isin(t, (10, 11))))

    colon_before = (prev_t == 8) & ~prev_e
    idx = np.flatnonzero(e)
    ind = ded = e3 = nest = 0
    stack: list[int] = []
    if idx.size:
        if not wv[idx].any():
            e3 = int(np.count_nonzero(colon_before[idx]))
        else:
            for w, cb in zip(wv[idx].tolist(), colon_before[idx].tolist()):
                top = stack[-1] if stack else 0
                if w > top:
                    stack.append(w)
                    ind += 1
                    e3 += not cb
                    nest = max(nest, len(stack))
                else:
                    while stack and stack[-1] > w:
                        stack.pop()
                        ded += 1
                    e3 += cb
    left = len(stack)
    eof = left > 0
    last_is_token = m > 0 and not e[-1]
    nl += eof
    ded += left
    e3 += int(eof and m > 0 and t[-1] == 8 and not e[-1])
    e2 = unmatched + open_left
    e4 = int(last_is_token and not eof and open_left == 0)
    tokens = ntok + nl + ind + ded
    return (tokens, ntok, nl, ind, ded, final_depth, max_depth, unmatched, open_left,
            nest, stmts, e1, e2, e3, e4, e5, e1 + e2 + e3 + e4 + e5)
