"""Random code-like texts: the Spark lexer + fold against the DuckDB oracle path
(RE2 pattern, SQL role CASE, list_reduce fold), field by field."""

import random

import duckdb

from codeweigh.functions.lexing import add_py_profile
from codeweigh.plans.duck import py_profile_query

PIECES = ["def", "if", "else", "elif", "x", "y_1", "é", "_", "None", "match", "case", "rb", "f", "u", "br",
          "0", "7", "1.5", "0x1F", "1e3", ".5", "1_0", "'", '"', "'''", '"""', "\\", "#", "(", ")", "[", "]",
          "{", "}", ":", "=", ":=", "**=", "->", "@", "$", "?", "!", ",", ";", ".", "...", " ", "  ", "\t",
          "\n", "\n", "\n    ", "\n  ", "\r\n", "\r", "\f", "😀", "ß", "\\\n"]


def _texts(n, seed):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]


FIELDS = ["tokens", "ntok", "nl", "ind", "ded", "final_depth", "max_depth", "unmatched_closers",
          "open_left", "max_nesting", "stmts", "e1", "e2", "e3", "e4", "e5", "errors"]


def test_spark_equals_duckdb_on_random_texts(spark):
    texts = _texts(600, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: tuple(getattr(r.prof, f) for f in FIELDS)
           for r in add_py_profile(df, "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(f"SELECT id, {', '.join(FIELDS)} FROM ({py_profile_query('t', ['id'], 'text')})").fetchall()
    want = {r[0]: tuple(r[1:]) for r in rows}
    bad = [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:3]


JAVA_PIECES = ["class", "non-sealed", "non", "-", "sealed", "int", "x", "$y", "_z", "é", "true", "null", "0", "07",
               "08", "0x1F", "0x1.8p3", "0b101", "1_000", "1L", "1.5e3f", ".5", "1.", "1e", "'a'", "'\\n'", "'",
               '"s"', '"\\"q"', '"', '"""\n t\n"""', '"""', "/*", "*/", "/* c */", "//", "// c\n", ">", ">>",
               ">>=", ">>>=", "<<=", "<", "=", "==", "!", "!=", "&&", "||", "++", "--", "->", "::", "@", "...",
               ".", "(", ")", "{", "}", ";", " ", "\t", "\n", "\r\n", "\f", "#", "`", "\\", "😀"]


def test_java_spark_equals_duckdb_on_random_texts(spark):
    from codeweigh.operators.tokens import java_token_table
    from codeweigh.plans.oracle import java_token_rows
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(JAVA_PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = sorted(tuple(r) for r in java_token_table(df, "page_id", "html").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(tuple(r) for r in con.execute(java_token_rows()).fetchall())
    assert got == want
