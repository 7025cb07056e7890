"""SQL fragments for the DuckDB oracle.

The oracle re-derives every result with DuckDB's own regex engine (RE2),
list lambdas and window functions, independently of the Spark code path
(which uses java.util.regex, Spark expressions and a numpy fold).
"""

from __future__ import annotations

from ..functions import grammar as G

NL = "chr(10)"
CR = "chr(13)"
FF = "chr(12)"
TAB = "chr(9)"
BSL = "chr(92)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


PY_RE2 = G.python_pattern("re2")
JAVA_RE2 = G.java_pattern("re2")

_PY_OPS = [o for o, _ in G.PY_OPERATORS if o not in G.PY_OPENERS + G.PY_CLOSERS + [":", "@"]]
_PY_OTHER_KW = [k for k, _ in G.PY_KEYWORDS
                if k not in G.PY_OPERAND_KEYWORDS + G.PY_CONTINUATION_KEYWORDS]
_NAME_START = r"[_\p{L}\p{Nl}" + G.PY_ID_START_EXTRA + "]"


def py_lex(text: str) -> str:
    return f"regexp_extract_all({text}, {q(PY_RE2)}, 0)"


def py_role(x: str, i: str) -> str:
    """Role code of lexeme ``x`` at 1-based position ``i``."""
    c0 = f"substr({x}, 1, 1)"
    return f"""CASE
 WHEN {c0} IN ({NL}, {CR}) THEN 1
 WHEN {c0} = {FF} THEN 13
 WHEN {c0} IN (' ', {TAB}) THEN CASE WHEN {i} = 1 THEN 14 ELSE 0 END
 WHEN {c0} = '#' THEN 12
 WHEN {c0} = {BSL} THEN CASE WHEN length({x}) > 1 THEN 2 ELSE 3 END
 WHEN {x} IN {inlist(G.PY_OPENERS)} THEN 6
 WHEN {x} IN {inlist(G.PY_CLOSERS)} THEN 7
 WHEN {x} = ':' THEN 8
 WHEN {x} = '@' THEN 11
 WHEN {x} IN {inlist(_PY_OPS)} THEN 9
 WHEN {x} IN {inlist(G.PY_CONTINUATION_KEYWORDS)} THEN 10
 WHEN {x} IN {inlist(G.PY_OPERAND_KEYWORDS)} THEN 4
 WHEN {x} IN {inlist(_PY_OTHER_KW)} THEN 9
 WHEN length({x}) > 1 THEN CASE WHEN strpos({x}, '''') > 0 OR strpos({x}, '"') > 0 THEN 5 ELSE 4 END
 WHEN {c0} BETWEEN '0' AND '9' THEN 4
 WHEN regexp_full_match({x}, {q(_NAME_START)}) THEN 4
 ELSE 3 END"""


def width(b: str) -> str:
    return (f"CASE WHEN strpos({b}, {TAB}) = 0 THEN length({b}) ELSE list_reduce(string_split({b}, ''), "
            f"lambda acc, ch: CASE WHEN ch = {TAB} THEN acc + 8 - acc % 8 ELSE acc + 1 END, 0) END")


#: Regex class of the characters that end a line.
LINE_ENDS = r"[\r\n\f]"


def _fold_step(layout: bool = False) -> str:
    emit = "(x.k IN (1, 13, 14) AND acc.op <= 0 AND NOT x.s)"
    top = "coalesce(list_max(acc.st), 0)"
    push = f"({emit} AND x.w > {top})"
    pop = f"({emit} AND x.w < {top})"
    tok = "(x.k BETWEEN 3 AND 11)"
    delta = "CASE WHEN x.k = 6 THEN 1 WHEN x.k = 7 THEN -1 ELSE 0 END"
    pair = "(x.k IN (4, 5) AND acc.po IN (4, 5) AND NOT (acc.po = 5 AND x.k = 5) AND NOT acc.lp)"
    extra = (f""",
 'lay': CASE WHEN {push} THEN list_append(acc.lay, {{'p': x.p, 'n': 1}})
             WHEN {pop} THEN list_append(acc.lay, {{'p': x.p, 'n': -len(list_filter(acc.st, lambda v: v > x.w))}}) ELSE acc.lay END""" if layout else "")
    return f"""{{
 'op': acc.op + {delta},
 'dp': CASE WHEN x.k = 6 THEN acc.dp + 1 WHEN x.k = 7 THEN greatest(acc.dp - 1, 0) ELSE acc.dp END,
 'um': acc.um + CASE WHEN x.k = 7 AND acc.dp = 0 THEN 1 ELSE 0 END,
 'mx': greatest(acc.mx, acc.op + {delta}),
 'st': CASE WHEN {push} THEN list_append(acc.st, x.w)
            WHEN {pop} THEN list_filter(acc.st, lambda v: v <= x.w) ELSE acc.st END,
 'mn': greatest(acc.mn, len(acc.st) + CASE WHEN {push} THEN 1 ELSE 0 END),
 'nl': acc.nl + ({emit})::INT,
 'ind': acc.ind + ({push})::INT,
 'ded': acc.ded + CASE WHEN {pop} THEN len(list_filter(acc.st, lambda v: v > x.w)) ELSE 0 END,
 'lt': CASE WHEN {push} THEN 2 WHEN {pop} THEN 3 WHEN {emit} THEN 1 WHEN x.k = 8 THEN 8
            WHEN {tok} THEN 9 ELSE acc.lt END,
 'e3': acc.e3 + ({push} AND acc.lt <> 8)::INT + ({emit} AND NOT {push} AND acc.lt = 8)::INT,
 'po': CASE WHEN {emit} THEN 0 WHEN x.k IN (4, 5) THEN x.k WHEN {tok} THEN 0 ELSE acc.po END,
 'lp': CASE WHEN {emit} THEN false WHEN {pair} THEN true ELSE acc.lp END,
 'e5': acc.e5 + ({pair})::INT,
 'ls': CASE WHEN {emit} THEN false WHEN {tok} THEN true ELSE acc.ls END,
 'sm': acc.sm + ({tok} AND NOT acc.ls AND x.k NOT IN (10, 11))::INT,
 'nt': acc.nt + ({tok})::INT,
 'e1': acc.e1 + (x.k = 3 AND NOT x.u)::INT{extra}
}}"""


_INIT = ("{'op': 0, 'dp': 0, 'um': 0, 'mx': 0, 'st': []::INTEGER[], 'mn': 0, 'nl': 0, 'ind': 0, "
         "'ded': 0, 'lt': 0, 'e3': 0, 'po': 0, 'lp': false, 'e5': 0, 'ls': false, 'sm': 0, "
         "'nt': 0, 'e1': 0}")


def _folded(src: str, keys: list[str], text: str, layout: bool = False) -> str:
    """CTEs up to ``_p``: keys, the number of lexemes ``n_`` and the fold's result ``a``."""
    k = ", ".join(keys)
    roles = (f"list_filter(list_transform(kc, lambda kk, i: {{'k': kk, 'p': i - 1, "
             f"'w': CASE WHEN kk IN (1, 13, 14) THEN {width(f'regexp_replace(lx[i], {q(LINE_ENDS)}, {q('')}, {q('g')})')} ELSE 0 END, "
             f"'s': coalesce(kk IN (1, 13, 14) AND kc[i + 1] IN (1, 12) AND (length(lx[i + 1]) > 1 OR len(lx) >= i + 2), false), "
             f"'u': coalesce(kk = 3 AND i > 1 AND kc[i - 1] = 3, false)}}), lambda r: r.k NOT IN (0, 2, 12))")
    init = _INIT[:-1] + ", 'lay': []::STRUCT(p BIGINT, n BIGINT)[]}" if layout else _INIT
    return f"""
WITH _l AS (SELECT {k}, {py_lex(text)} AS lx FROM {src}),
_k AS (SELECT {k}, lx, list_transform(lx, lambda x, i: {py_role('x', 'i')}) AS kc FROM _l),
_r AS (SELECT {k}, len(lx) AS n_, {roles} AS kept FROM _k),
_f AS (SELECT {k}, n_, list_reduce(kept, lambda acc, x: {_fold_step(layout)}, {init}) AS a FROM _r),
_p AS (SELECT {k}, n_, a, len(a.st) AS left_, (len(a.st) > 0) AS eof FROM _f)"""


def py_layout_query(src: str, key: str, text: str) -> str:
    """SELECT the layout tokens without text: key, pos, sub, name, text, hidden."""
    return f"""{_folded(src, [key], text, layout=True)},
_m AS (SELECT {key}, unnest(a.lay) AS m FROM _p),
_d AS (SELECT {key}, m.p AS pos, m.n AS n, unnest(generate_series(1, abs(m.n))) AS sub FROM _m),
_t AS (SELECT {key}, n_ AS pos, unnest(generate_series(0, left_)) AS sub FROM _p WHERE eof)
SELECT {key}, CAST(pos AS INTEGER) AS pos, CAST(sub AS INTEGER) AS sub,
       CASE WHEN n > 0 THEN 'INDENT' ELSE 'DEDENT' END AS name, '' AS text, false AS hidden FROM _d
UNION ALL SELECT {key}, CAST(pos AS INTEGER), CAST(sub AS INTEGER),
       CASE WHEN sub = 0 THEN 'NEWLINE' ELSE 'DEDENT' END, '', false FROM _t"""


def py_profile_query(src: str, keys: list[str], text: str) -> str:
    """SELECT keys + profile fields (as BIGINT) for ``text`` of relation ``src``."""
    k = ", ".join(keys)
    return f"""{_folded(src, keys, text)}
SELECT {k},
 CAST(a.nt + a.nl + eof::INT + a.ind + a.ded + left_ AS BIGINT) AS tokens,
 CAST(a.nt AS BIGINT) AS ntok,
 CAST(a.nl + eof::INT AS BIGINT) AS nl,
 CAST(a.ind AS BIGINT) AS ind,
 CAST(a.ded + left_ AS BIGINT) AS ded,
 CAST(a.op AS BIGINT) AS final_depth,
 CAST(a.mx AS BIGINT) AS max_depth,
 CAST(a.um AS BIGINT) AS unmatched_closers,
 CAST(a.dp AS BIGINT) AS open_left,
 CAST(a.mn AS BIGINT) AS max_nesting,
 CAST(a.sm AS BIGINT) AS stmts,
 CAST(a.e1 AS BIGINT) AS e1,
 CAST(a.um + a.dp AS BIGINT) AS e2,
 CAST(a.e3 + (eof AND a.lt = 8)::INT AS BIGINT) AS e3,
 CAST((a.ls AND NOT eof AND a.dp = 0)::INT AS BIGINT) AS e4,
 CAST(a.e5 AS BIGINT) AS e5,
 CAST(a.e1 + a.um + a.dp + a.e3 + (eof AND a.lt = 8)::INT + (a.ls AND NOT eof AND a.dp = 0)::INT + a.e5 AS BIGINT) AS errors
FROM _p"""
