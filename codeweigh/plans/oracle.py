"""DuckDB SQL equal in meaning to every registered query (see catalog)."""

from __future__ import annotations

from ..functions import adjacency as A
from ..functions import grammar as G
from ..functions import permutation as M
from . import duck as D
from .catalog import CODE_LIKE, ESCAPED
from .catalog import PARAMS as P

V = P["vocab_size"]

PAIRS = ("SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS output "
         "FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn "
         "WHERE u.role = 'user' AND a.role = 'assistant'")
PAIRS_ALL = ("SELECT a.conv_id, a.turn - 1 AS turn, u.text AS prompt, a.text AS output "
             "FROM conversations a LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u "
             "ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant'")


def counts(pairs: str) -> str:
    keys = ["conv_id", "turn"]
    po = D.py_profile_query(f"({pairs}) AS _pp", keys, "output")
    ps = D.py_profile_query(f"(SELECT conv_id, turn, prompt || output AS sample FROM ({pairs}) AS _pq) AS _ps",
                            keys, "sample")
    return (f"SELECT p.conv_id, p.turn, p.prompt, p.output, o.tokens AS nt, s.errors AS ne, s.stmts AS ns "
            f"FROM ({pairs}) AS p JOIN ({po}) AS o ON o.conv_id = p.conv_id AND o.turn = p.turn "
            f"JOIN ({ps}) AS s ON s.conv_id = p.conv_id AND s.turn = p.turn")


def cal(counts_sql: str) -> str:
    return (f"SELECT CASE WHEN count(*) > 0 THEN greatest(sum(nt)::DOUBLE / count(*), 1.0) END AS avg_tokens, "
            f"CASE WHEN count(*) > 0 THEN greatest(sum(ne)::DOUBLE / count(*), 1.0) END AS avg_errors, "
            f"count(*) AS n FROM ({counts_sql}) AS _c")


def _a(nt="nt", at="avg_tokens"):
    return f"greatest(least({nt} / {at}, {1 - 1e-5}), {1e-5})"


def _decay(x: str, a: str) -> str:
    big_l = f"({P_FACTOR} * ln({a}))"
    return f"((exp(({x}) * {big_l}) - exp({big_l})) / (1 - exp({big_l})))"


P_FACTOR = 100


def reward_expr(nt="nt", ne="ne", at="avg_tokens", ae="avg_errors") -> str:
    score = f"(round(greatest(least({_decay(f'{ne} / {ae}', _a(nt, at))}, 1.0), 0.0), 6) + 0.0)"
    return f"CASE WHEN prompt IS NULL THEN 0.0 ELSE {score} END"


COUNTS = counts(PAIRS)
CAL = cal(COUNTS)
CALIBRATED = f"SELECT c.*, k.avg_tokens, k.avg_errors FROM ({COUNTS}) AS c CROSS JOIN ({CAL}) AS k"
SCORED = (f"SELECT conv_id, turn, prompt, output, nt, ne, {reward_expr()} AS reward "
          f"FROM ({CALIBRATED}) AS _s")

_pat = D.q(D.PY_RE2)


def roles_cte(src: str, key: str, text: str) -> str:
    return (f"SELECT {key}, lx, list_transform(lx, lambda x, i: {D.py_role('x', 'i')}) AS kc "
            f"FROM (SELECT {key}, regexp_extract_all({text}, {_pat}, 0) AS lx FROM {src}) AS _l")


def py_names_values() -> str:
    rows = ", ".join(f"({D.q(t)}, {D.q(n)})" for t, n in G.PY_KEYWORDS + G.PY_OPERATORS)
    return f"(VALUES {rows}) AS names(lexeme, kw_name)"


def py_token_rows(src: str, key: str, text: str) -> str:
    return f"""
WITH _k AS ({roles_cte(src, key, text)}),
_u AS (SELECT {key}, unnest(lx) AS text, unnest(kc) AS k, generate_subscripts(lx, 1) AS i FROM _k),
_w AS (SELECT *,
   coalesce(sum(CASE WHEN k = 6 THEN 1 WHEN k = 7 THEN -1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth_before,
   lead(k) OVER (PARTITION BY {key} ORDER BY i) AS nk,
   lead(text) OVER (PARTITION BY {key} ORDER BY i) AS nt1,
   lead(text, 2) OVER (PARTITION BY {key} ORDER BY i) AS nt2 FROM _u),
_e AS (SELECT *, (k IN (1, 13, 14) AND depth_before <= 0
         AND NOT coalesce(nk IN (1, 12) AND (length(nt1) > 1 OR nt2 IS NOT NULL), false)) AS emit FROM _w)
SELECT {key}, CAST(i - 1 AS INTEGER) AS pos,
 CASE WHEN k IN (1, 13, 14) THEN 'NEWLINE' WHEN k IN (0, 2, 12) THEN 'SKIP_'
      WHEN names.kw_name IS NOT NULL THEN names.kw_name WHEN k = 5 THEN 'STRING'
      WHEN k = 3 THEN 'UNKNOWN_CHAR'
      WHEN substr(text, 1, 1) BETWEEN '0' AND '9' OR (substr(text, 1, 1) = '.' AND length(text) > 1) THEN 'NUMBER'
      ELSE 'NAME' END AS name,
 text, (k IN (0, 2, 12) OR (k IN (1, 13, 14) AND NOT emit)) AS hidden
FROM _e LEFT JOIN {py_names_values()} ON _e.text = names.lexeme"""


def bracket_pairs(src: str, key: str, text: str) -> str:
    """Brackets by level: on a level an opener's partner is the next row."""
    kind = "CASE WHEN {0} IN ('(', ')') THEN 0 WHEN {0} IN ('[', ']') THEN 1 ELSE 2 END"
    return f"""
WITH _k AS ({roles_cte(src, key, text)}),
_u AS (SELECT {key}, unnest(lx) AS text, unnest(kc) AS k, generate_subscripts(kc, 1) - 1 AS pos FROM _k),
_d AS (SELECT {key}, pos, text, k, sum(CASE WHEN k = 6 THEN 1 ELSE -1 END) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth
       FROM _u WHERE k IN (6, 7)),
_n AS (SELECT *, lag(k) OVER w AS pk, lag(pos) OVER w AS pp, lag(text) OVER w AS pt, lead(k) OVER w AS nk, lead(pos) OVER w AS np, lead(text) OVER w AS nt
       FROM _d WINDOW w AS (PARTITION BY {key}, CASE WHEN k = 6 THEN depth ELSE depth + 1 END ORDER BY pos)),
_m AS (SELECT *, CASE WHEN k = 6 AND nk = 7 THEN np WHEN k = 7 AND pk = 6 THEN pp END AS m, CASE WHEN k = 6 AND nk = 7 THEN nt WHEN k = 7 AND pk = 6 THEN pt END AS mt FROM _n)
SELECT {key}, CAST(pos AS INTEGER) AS pos, text, CAST(depth AS INTEGER) AS depth, CAST(m AS INTEGER) AS match_pos,
       CASE WHEN m IS NOT NULL THEN {kind.format('text')} = {kind.format('mt')} END AS same_kind FROM _m"""


def token_pairs(src: str, key: str, text: str) -> str:
    """Neighbouring tokens of a line, joined with the table of legal pairs."""
    classes = ", ".join(f"({D.q(n)}, {D.q(c)})" for n, c in A.token_classes().items())
    legal = ", ".join(f"({D.q(k)}, {i}, {D.q(a)}, {D.q(b)})" for k, i, a, b in A.legal_pairs())
    kinds = D.inlist(A.KINDS[1:])
    return f"""
WITH _t AS (SELECT * FROM ({py_token_rows(src, key, text)}) AS _tok WHERE NOT hidden),
_c AS (SELECT {key}, pos, r, sum(CASE WHEN r IN {D.inlist(G.PY_OPENERS)} THEN 1 WHEN r IN {D.inlist(G.PY_CLOSERS)} THEN -1 ELSE 0 END)
         OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS depth,
       coalesce(sum((r = 'END')::INT) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
       FROM _t JOIN (VALUES {classes}) AS cl(name, r) USING (name)),
_l AS (SELECT {key}, r, coalesce(depth, 0) > 0 AS inside, coalesce(lag(r) OVER w, 'START') AS l,
       first_value(r) OVER w AS f FROM _c WINDOW w AS (PARTITION BY {key}, line ORDER BY pos)),
_p AS (SELECT {key}, g.k IS NULL AS wrong FROM _l LEFT JOIN (VALUES {legal}) AS g(k, i, a, b)
       ON g.k = CASE WHEN f IN {kinds} THEN f ELSE '' END AND g.i = inside AND g.a = l AND g.b = r
       WHERE NOT (l = 'START' AND r = 'END'))
SELECT d.{key}, CASE WHEN d.{text} IS NOT NULL THEN count(wrong) END AS pairs, CASE WHEN d.{text} IS NOT NULL THEN count(*) FILTER (wrong) END AS pair_errors
FROM {src} AS d LEFT JOIN _p USING ({key}) GROUP BY d.{key}, d.{text}"""


def profile_fields(src: str, key: str, text: str, fields: list[str]) -> str:
    prof = D.py_profile_query(src, [key], text)
    return f"SELECT {key}, {', '.join(fields)} FROM ({prof}) AS _p"


def code_like(text: str) -> str:
    for old, new in CODE_LIKE:
        text = f"replace({text}, {D.q(old)}, {D.q(new)})"
    return text


CODE = f"(SELECT doc_id, {code_like('text')} AS text FROM documents) AS _code"
LONGEST_ENTRY = 64


def vocab_sql() -> str:
    return f"""
WITH _lx AS (SELECT doc_id, regexp_extract_all(text, {_pat}, 0) AS lx FROM documents),
_ex AS (SELECT unnest(lx) AS lexeme FROM _lx),
_cnt AS (SELECT lexeme, count(*) AS n FROM _ex WHERE strlen(lexeme) <= {LONGEST_ENTRY} GROUP BY lexeme)
SELECT lexeme, CAST(row_number() OVER (ORDER BY n DESC, lexeme ASC) - 1 AS INTEGER) AS id
FROM (SELECT * FROM _cnt ORDER BY n DESC, lexeme ASC LIMIT {V}) AS _t"""


def ids(src: str) -> str:
    """Ids of the texts of ``src`` in the vocabulary of ``documents``."""
    return f"""
SELECT d.doc_id, coalesce(i.input_ids, []::INTEGER[]) AS input_ids
FROM {src} d LEFT JOIN (
  SELECT e.doc_id, flatten(list(CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE list_transform(range(strlen(e.lexeme)),
    lambda b: CAST({V} + CAST('0x' || substr(hex(encode(e.lexeme)), 2 * b + 1, 2) AS INTEGER) AS INTEGER)) END ORDER BY e.pos)) AS input_ids
  FROM (SELECT doc_id, unnest(lx) AS lexeme, generate_subscripts(lx, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, {_pat}, 0) AS lx FROM {src}) AS _l) AS e
  LEFT JOIN ({vocab_sql()}) AS v ON v.lexeme = e.lexeme
  GROUP BY e.doc_id) AS i ON i.doc_id = d.doc_id"""


IDS = ids("documents")

# Words as rows of symbols in angle brackets, and a row '' with the next symbol. Each step of the
# recursion counts all pairs anew and joins the best ones (_g) in every word: those before the first (_t)
# that has a symbol on the other side of a better pair. Joining a pair changes only counts of pairs that end
# with its left or begin with its right symbol, and what comes new counts no more than these.
SUBWORDS = f"""
WITH RECURSIVE _lx AS (SELECT doc_id, regexp_extract_all(text, {_pat}, 0) AS lx FROM documents),
_e AS (SELECT doc_id, unnest(lx) AS lexeme, generate_subscripts(lx, 1) AS ix FROM _lx),
_pc AS (SELECT doc_id, ix, unnest(ws) AS word, generate_subscripts(ws, 1) AS sub FROM (SELECT doc_id, ix, regexp_extract_all(lexeme, '[\\s\\S]{{1,32}}') AS ws FROM _e) AS _x),
_w AS (SELECT word, count(*) AS n, list_reduce(list_transform(range(strlen(word)), lambda b: '<' || CAST(CAST('0x' || substr(hex(encode(word)), 2 * b + 1, 2) AS INTEGER) AS VARCHAR) || '>'),
         lambda x, y: x || y) AS s FROM _pc GROUP BY word),
_m(word, n, s) USING KEY (word) AS (
  SELECT word, n, s FROM _w UNION ALL SELECT '', 256, ''
  UNION ALL (
  WITH _o AS MATERIALIZED (SELECT word, n, s, unnest(list_transform(range(1, len(q)), lambda i: '<' || q[i] || '><' || q[i + 1] || '>')) AS p
                           FROM (SELECT word, n, s, string_split(s[2:-2], '><') AS q FROM recurring._m WHERE contains(s, '><')) AS _q),
  _b AS MATERIALIZED (SELECT p, a, b, row_number() OVER (ORDER BY n DESC, a, b) AS r
                      FROM (SELECT p, sum(n) AS n, CAST(string_split(p[2:-2], '><')[1] AS INTEGER) AS a, CAST(string_split(p[2:-2], '><')[2] AS INTEGER) AS b
                            FROM _o GROUP BY p HAVING sum(n) >= 2) AS _c),
  _t AS (SELECT min(r) AS r FROM (SELECT x.r FROM _b AS x JOIN (SELECT b, min(r) AS r FROM _b GROUP BY b) AS y ON x.a = y.b AND y.r < x.r
                                  UNION ALL SELECT x.r FROM _b AS x JOIN (SELECT a, min(r) AS r FROM _b GROUP BY a) AS y ON x.b = y.a AND y.r < x.r
                                  UNION ALL SELECT r + 1 FROM _b WHERE a = b) AS _x),
  _g AS MATERIALIZED (SELECT p, '<' || CAST((SELECT n FROM recurring._m WHERE word = '') + r - 1 AS VARCHAR) || '>' AS new FROM _b
                      WHERE r < coalesce((SELECT r FROM _t), r + 1) AND r <= 256 + {P['subword_merges']} - (SELECT n FROM recurring._m WHERE word = ''))
  SELECT word, any_value(n), list_reduce(list_prepend(any_value(s), list(DISTINCT p || '=' || new)), lambda x, y: replace(x, string_split(y, '=')[1], string_split(y, '=')[2]))
  FROM _o JOIN _g USING (p) GROUP BY word
  UNION ALL SELECT '', (SELECT n FROM recurring._m WHERE word = '') + count(*), '' FROM _g HAVING count(*) > 0)),
_f AS (SELECT word, list_transform(string_split(s[2:-2], '><'), lambda x: CAST(x AS INTEGER)) AS ids FROM _m WHERE word <> '')
SELECT d.doc_id, coalesce(i.ids, []::INTEGER[]) AS input_ids, true AS same_text
FROM documents d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY ix, sub)) AS ids FROM _pc JOIN _f USING (word) GROUP BY doc_id) AS i USING (doc_id)"""

SPLIT = f"""
SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 <
  round_even(count(*) OVER () * {float(P['validation_percent'])} / 100.0, 0) THEN 'validation' ELSE 'train' END AS split
FROM documents"""

def computed_shuffle(seed: int) -> str:
    """The Feistel steps as integer arithmetic, one subquery a round; the recursion walks on."""
    body = "SELECT i, x // b AS l, x % b AS r FROM {src}"
    for k, key in enumerate(M.keys(seed)):
        keyed = lambda digit, base: f"(({digit} + {key}) * {M.FIRST} % {M.PRIME} * {M.SECOND} % {M.PRIME} // {M.COARSE} % {base})"  # noqa: B023, E731
        step = f"l, (r + {keyed('l', 'b')}) % b AS r" if k % 2 else f"(l + {keyed('r', 'a')}) % a AS l, r"
        body = f"SELECT i, {step} FROM ({body}), _b"
    body = body.replace("FROM {src}", "FROM {src}, _b")
    return f"""
WITH RECURSIVE _n AS (SELECT max(doc_id) + 1 AS n FROM documents),
_a AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM _n),
_b AS (SELECT n, a, (n + a - 1) // a AS b FROM _a),
_s AS (SELECT doc_id AS i, doc_id AS x FROM documents),
_w(i, x) AS (SELECT i, l * b + r FROM ({body.replace('{src}', '_s')}) AS _p, _b
  UNION ALL SELECT i, l * b + r FROM ({body.replace('{src}', '(SELECT i, x FROM _w, _n WHERE x >= n)')}) AS _p, _b)
SELECT i AS doc_id, x AS shuffle_pos, i AS inverse FROM _w, _n WHERE x < n"""


BATCHED_SCORED = (f"SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {P['batch_size']} AS batch_id "
                  f"FROM ({SCORED}) AS _b")


def java_names_values() -> str:
    rows = ", ".join(f"({D.q(t)}, {D.q(n)})" for t, n in G.java_keyword_names() + G.JAVA_OPERATORS)
    return f"(VALUES {rows}) AS names(lexeme, kw_name)"


def java_token_rows() -> str:
    t = "u.text"
    c0 = f"substr({t}, 1, 1)"
    name = f"""CASE WHEN names.kw_name IS NOT NULL THEN names.kw_name
 WHEN {c0} IN (' ', chr(9), chr(13), chr(10), chr(12)) THEN 'WS'
 WHEN starts_with({t}, '/*') AND length({t}) > 3 THEN 'COMMENT'
 WHEN starts_with({t}, '//') THEN 'LINE_COMMENT'
 WHEN {c0} BETWEEN '0' AND '9' OR ({c0} = '.' AND length({t}) > 1 AND substr({t}, 2, 1) BETWEEN '0' AND '9') THEN
   CASE WHEN regexp_matches({t}, '^0[xX]') AND regexp_matches({t}, '[pP]') THEN 'HEX_FLOAT_LITERAL'
        WHEN regexp_matches({t}, '^0[xX]') THEN 'HEX_LITERAL'
        WHEN regexp_matches({t}, '^0[bB]') THEN 'BINARY_LITERAL'
        WHEN regexp_matches({t}, '[.eEfFdD]') THEN 'FLOAT_LITERAL'
        WHEN regexp_matches({t}, '^0_*[0-7]') THEN 'OCT_LITERAL'
        ELSE 'DECIMAL_LITERAL' END
 WHEN starts_with({t}, '\"\"\"') AND length({t}) > 5 THEN 'TEXT_BLOCK'
 WHEN {c0} = '"' AND length({t}) > 1 THEN 'STRING_LITERAL'
 WHEN {c0} = '''' AND length({t}) > 1 THEN 'CHAR_LITERAL'
 WHEN regexp_matches({t}, {D.q(r'^[a-zA-Z$_\x{80}-\x{10FFFF}]')}) THEN 'IDENTIFIER'
 ELSE 'UNMATCHED' END"""
    return f"""
WITH u AS (SELECT page_id, unnest(lx) AS text, generate_subscripts(lx, 1) - 1 AS pos
           FROM (SELECT page_id, regexp_extract_all(html, {D.q(D.JAVA_RE2)}, 0) AS lx FROM pages) AS _l),
n AS (SELECT u.page_id, u.pos, u.text, {name} AS name FROM u LEFT JOIN {java_names_values()} ON u.text = names.lexeme)
SELECT page_id, CAST(pos AS INTEGER) AS pos, name, text,
       name IN ('WS', 'COMMENT', 'LINE_COMMENT', 'UNMATCHED') AS hidden FROM n"""


def _tv() -> str:
    return ("SELECT doc_id AS id, text, 'train' AS split FROM documents "
            "UNION ALL SELECT item_id AS id, text, 'validation' AS split FROM benchmark")


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["scan_named"] = "SELECT * FROM conversations"
    o["scan_csv"] = "SELECT * FROM conversations"
    o["scan_json"] = "SELECT * FROM documents"
    o["scan_text"] = ("SELECT line || chr(10) AS text FROM "
                      "(SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM benchmark) AS _t")
    o["scan_train_validation"] = _tv()
    o["rewrite_lines"] = ("SELECT page_id, replace(replace(html, '!this.', 'not self.'), 'this.', 'self.') AS html "
                          "FROM pages")
    o["write_tokenized"] = IDS
    changed = f"(SELECT doc_id, CASE WHEN doc_id % {P['cache_files']} = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM documents)"
    o["refresh_tokens"] = ids(changed)
    o["write_reward_log"] = (f"SELECT conv_id, turn, prompt, output, reward, batch_id, "
                             f"prompt || output AS sample, CAST(batch_id % 2 AS VARCHAR) AS run, "
                             f"batch_id // 1024 AS batch_range FROM ({BATCHED_SCORED}) AS _w")
    o["resolve_text_column"] = "SELECT text FROM documents"
    o["drop_source_columns"] = f"SELECT input_ids FROM ({IDS}) AS _i"
    o["select_prompts"] = f"SELECT text FROM ({SPLIT}) AS _s WHERE split = 'train'"
    o["concat_sample"] = f"SELECT *, prompt || output AS sample FROM ({PAIRS}) AS _p"
    o["filter_split"] = f"SELECT * FROM ({_tv()}) AS _t WHERE split = 'validation'"
    o["pair_prompt_output"] = PAIRS
    o["apply_calibration"] = f"SELECT conv_id, turn, nt, ne, avg_tokens, avg_errors FROM ({CALIBRATED}) AS _c"
    o["calibrate"] = o["calibrate_stream"] = CAL
    o["calibrate_statements"] = (f"SELECT CASE WHEN count(*) > 0 THEN greatest(sum(ns)::DOUBLE / count(*), 1.0) "
                                 f"END AS avg_stmt, count(*) AS n "
                                 f"FROM ({COUNTS}) AS _c")
    o["reward_batch_stats"] = (f"SELECT batch_id, count(reward) AS n, round(avg(reward), 6) AS reward_mean, "
                               f"round(stddev_samp(reward), 6) AS reward_std, min(reward) AS reward_min, "
                               f"max(reward) AS reward_max FROM ({BATCHED_SCORED}) AS _b GROUP BY batch_id")
    prof_docs = D.py_profile_query(CODE, ["doc_id"], "text")
    o["token_histogram"] = f"""
WITH _n AS (SELECT name, count(*) AS n FROM ({py_token_rows(CODE, 'doc_id', 'text')}) AS _t
            WHERE NOT hidden AND name <> 'NEWLINE' GROUP BY name),
_p AS ({prof_docs}),
_l AS (SELECT 'NEWLINE' AS name, sum(nl) AS n FROM _p UNION ALL SELECT 'INDENT', sum(ind) FROM _p
       UNION ALL SELECT 'DEDENT', sum(ded) FROM _p)
SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT * FROM _n UNION ALL SELECT * FROM _l) AS _a WHERE n > 0"""
    o["batch_rows"] = (f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, "
                       f"(row_number() OVER (ORDER BY doc_id) - 1) // {P['batch_size']} AS batch_id FROM documents")
    o["collate_batches"] = (f"SELECT batch_id, list(input_ids ORDER BY pos) AS input_ids FROM "
                            f"(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, "
                            f"(row_number() OVER (ORDER BY doc_id) - 1) // {P['batch_size']} AS batch_id "
                            f"FROM ({IDS}) AS _i) AS _b GROUP BY batch_id")
    o["limit_train"] = (f"SELECT doc_id, text FROM ({SPLIT}) AS _s WHERE split = 'train' "
                        f"ORDER BY doc_id LIMIT {P['max_train_samples']}")
    o["limit_eval"] = (f"SELECT doc_id, text FROM ({SPLIT}) AS _s WHERE split = 'validation' "
                       f"ORDER BY doc_id LIMIT {P['max_eval_samples']}")
    o["calibration_sample"] = cal(counts(f"SELECT * FROM ({PAIRS}) AS _p ORDER BY conv_id, turn "
                                         f"LIMIT {P['calibration_sample']}"))
    o["split_head_percent"] = f"SELECT doc_id, split FROM ({SPLIT}) AS _s"
    h = f"CAST('0x' || substr(md5(doc_id || ':{P['seed']}'), 1, 15) AS BIGINT)"
    o["split_hash_percent"] = (f"SELECT doc_id, CASE WHEN {h} % 1000000 < {float(P['validation_percent'])} * 10000 "
                               f"THEN 'validation' ELSE 'train' END AS split FROM documents")
    o["seeded_shuffle"] = f"SELECT doc_id, row_number() OVER (ORDER BY {h}, doc_id) - 1 AS shuffle_pos FROM documents"
    o["computed_shuffle"] = computed_shuffle(P["seed"])
    o["normalize"] = f"SELECT conv_id, turn, round(nt / avg_tokens, 6) AS norm_tokens FROM ({CALIBRATED}) AS _c"
    o["exponential_decay"] = (f"SELECT conv_id, turn, (round({_decay('ne / avg_errors', _a())}, 6) + 0.0) AS decay "
                              f"FROM ({CALIBRATED}) AS _c")
    o["clamp"] = f"SELECT conv_id, turn, round({_a()}, 6) AS clamped_length FROM ({CALIBRATED}) AS _c"
    o["reward"] = SCORED
    o["reward_failure_guard"] = (f"SELECT conv_id, turn, prompt IS NULL AS prompt_missing, {reward_expr()} AS reward "
                                 f"FROM ({counts(PAIRS_ALL)}) AS c CROSS JOIN ({CAL}) AS k")
    o["quarantine"] = (f"SELECT conv_id, turn, reward, NULL::VARCHAR AS reason FROM ({SCORED}) AS _s UNION ALL "
                       f"SELECT conv_id, turn, NULL, 'output is null' FROM conversations u WHERE role = 'user' AND NOT EXISTS ("
                       f"SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND a.text IS NOT NULL)")
    kw = P["keyword"]
    o["keyword_count_reward"] = (f"SELECT conv_id, turn, CAST((length(prompt || output) - length(replace("
                                 f"prompt || output, {D.q(kw)}, ''))) // {len(kw)} AS BIGINT) AS reward "
                                 f"FROM ({PAIRS}) AS _p")
    o["tokenize_ids"] = IDS
    o["subword_ids"] = SUBWORDS
    o["truncate_tokens"] = f"SELECT doc_id, input_ids[1:{P['truncate_to']}] AS input_ids FROM ({IDS}) AS _i"
    m = P["context_size"] - P["max_new_tokens"]
    o["max_input_length"] = (f"SELECT doc_id, CAST({m} AS BIGINT) AS max_input_length, "
                             f"CAST(least(len(input_ids), {m}) AS BIGINT) AS n_ids FROM ({IDS}) AS _i")
    o["prompt_half_split"] = (f"SELECT doc_id, CASE WHEN len(input_ids) >= 2 THEN "
                              f"input_ids[1:len(input_ids) - len(input_ids) // 2] ELSE []::INTEGER[] END AS prompt_ids "
                              f"FROM ({IDS}) AS _i")
    g = P["max_new_tokens"]
    o["response_tail"] = (f"SELECT doc_id, input_ids[greatest(1, len(input_ids) - {g} + 1):] AS tail_ids "
                          f"FROM ({IDS}) AS _i")
    o["decode_tokens"] = "SELECT doc_id, text AS decoded, text = text AS same_text FROM documents"
    w = P["truncate_to"]
    o["left_pad"] = (f"SELECT doc_id, list_concat(list_transform(range(greatest(0, {w} - len(input_ids))), "
                     f"lambda _x: CAST({V + 256} AS INTEGER)), input_ids) AS input_ids FROM ({IDS}) AS _i")
    o["argmax_array"] = ("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax "
                         "FROM embeddings")
    o["shifted_accuracy"] = (f"SELECT CAST(sum(h) AS BIGINT) AS matches, CAST(sum(c) AS BIGINT) AS compared, "
                             f"round(sum(h)::DOUBLE / sum(c), 6) AS accuracy FROM (SELECT "
                             f"len(list_filter(range(1, len(input_ids)), lambda i: (i - 1) % 3 <> 0 OR input_ids[i] = input_ids[i + 1])) AS h, "
                             f"greatest(len(input_ids) - 1, 0) AS c FROM ({IDS}) AS _i) AS _s")
    o["code_lexemes"] = (f"SELECT page_id, CAST(len(lx) AS BIGINT) AS n_lexemes, array_to_string(lx, '') = html "
                         f"AS lossless FROM (SELECT page_id, html, regexp_extract_all(html, {_pat}, 0) AS lx "
                         f"FROM pages) AS _l")
    one_line = "html"
    for old, new in ESCAPED:
        one_line = f"replace({one_line}, {D.q(old)}, {D.q(new)})"
    o["escaped_lexemes"] = (f"SELECT page_id, CAST(len(lx) AS BIGINT) AS n_lexemes, md5(array_to_string(list_transform(lx, lambda x: length(x)), ',')) AS lengths_md5 "
                            f"FROM (SELECT page_id, regexp_extract_all({one_line}, {_pat}, 0) AS lx FROM pages) AS _l")
    o["python_token_table"] = (f"SELECT doc_id, pos, 0 AS sub, name, text, hidden FROM ({py_token_rows(CODE, 'doc_id', 'text')}) AS _lex "
                               f"UNION ALL SELECT * FROM ({D.py_layout_query(CODE, 'doc_id', 'text')}) AS _lay")
    o["python_token_count"] = profile_fields(CODE, "doc_id", "text", ["tokens"])
    o["bracket_depth"] = f"""
WITH _k AS ({roles_cte('pages', 'page_id', 'html')}),
_u AS (SELECT page_id, unnest(kc) AS k, generate_subscripts(kc, 1) AS i FROM _k),
_d AS (SELECT page_id, CASE WHEN k = 6 THEN 1 WHEN k = 7 THEN -1 ELSE 0 END AS delta,
       sum(CASE WHEN k = 6 THEN 1 WHEN k = 7 THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i
           ROWS UNBOUNDED PRECEDING) AS depth FROM _u)
SELECT page_id, CAST(sum(delta) AS BIGINT) AS final_depth, CAST(greatest(0, max(depth)) AS BIGINT) AS max_depth,
       CAST(greatest(0, -min(depth)) AS BIGINT) AS unmatched_closers,
       CAST(sum(delta) + greatest(0, -min(depth)) AS BIGINT) AS open_left
FROM _d GROUP BY page_id"""
    o["bracket_pairs"] = bracket_pairs("pages", "page_id", "html")
    o["indent_profile"] = profile_fields(CODE, "doc_id", "text", ["nl", "ind", "ded", "max_nesting"])
    lead_blanks = "regexp_extract(line, " + D.q("^[ \\t]*") + ", 0)"
    o["indent_width"] = (f"SELECT CAST(width AS BIGINT) AS width, count(*) AS n_lines FROM (SELECT "
                         f"{D.width(lead_blanks)} AS width "
                         f"FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n|\\f')) AS line "
                         f"FROM {CODE}) AS _l) AS _w GROUP BY width")
    o["unknown_chars"] = (f"SELECT x AS ch, count(*) AS n FROM (SELECT unnest(lx) AS x, unnest(kc) AS k "
                          f"FROM ({roles_cte('pages', 'page_id', 'html')}) AS _k) AS _u WHERE k = 3 GROUP BY x")
    o["structural_errors"] = profile_fields(CODE, "doc_id", "text", ["e1", "e2", "e3", "e4", "e5", "errors"])
    o["token_pair_errors"] = token_pairs(f"(SELECT * FROM {CODE})", "doc_id", "text")
    o["statement_count"] = profile_fields(CODE, "doc_id", "text", ["stmts"])
    o["java_token_table"] = java_token_rows()
    o["score_stream"] = f"SELECT conv_id, turn, nt, ne, reward FROM ({SCORED}) AS _s"
    fixed = (f"SELECT conv_id, turn, nt, ne, {reward_expr('nt', 'ne', str(P['fixed_avg_tokens']), str(P['fixed_avg_errors']))} "
             f"AS reward FROM ({COUNTS}) AS _c")
    o["score_frame"] = fixed
    o["log_stream"] = (f"SELECT conv_id, turn, prompt, output, prompt || output AS sample, {reward_expr('nt', 'ne', str(P['fixed_avg_tokens']), str(P['fixed_avg_errors']))} AS reward, "
                       f"'stream' AS run, CAST(0 AS BIGINT) AS epoch FROM ({COUNTS}) AS _c")
    o["custom_reward"] = o["keyword_count_reward"]
    o["map_batches"] = ("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, "
                        "CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lines FROM documents")
    return o


ORACLE = build()
