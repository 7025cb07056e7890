"""Token tables and per-document structure reports.

Per-document reports are projections (no shuffle).  Token tables explode
lexemes, whose names are found before, so the exploded rows never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammar as G
from ..functions import lexing as L


def lexeme_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lexeme count per text and whether the lexemes rebuild it exactly."""
    lx = df.select(key, text, L.py_lexemes(text).alias("_lx"))
    return lx.select(key, F.size("_lx").cast("bigint").alias("n_lexemes"),
                     (F.array_join("_lx", "") == F.col(text)).alias("lossless"))


def lexeme_lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """Where every lexeme of a text begins and ends, as one digest (md5 of
    the comma-joined lengths), beside their number."""
    lengths = F.transform("_lx", lambda x: F.length(x).cast("string"))
    lx = df.select(key, L.py_lexemes(text).alias("_lx"))
    return lx.select(key, F.size("_lx").cast("bigint").alias("n_lexemes"), F.md5(F.array_join(lengths, ",").cast("binary")).alias("lengths_md5"))


def profile(df: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """Selected profile fields per text, as BIGINT."""
    p = L.add_py_profile(df.select(key, text), text, "_p")
    return p.select(key, *[F.col("_p." + f).cast("bigint").alias(f) for f in fields])


def python_token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per token ``(key, pos, sub, name, text, hidden)``.

    Blanks, comments and line joins are ``SKIP_`` (hidden); a line break the
    lexer suppresses is a hidden ``NEWLINE``.  ``pos`` is the lexeme's place,
    ``sub`` is 0; INDENT and DEDENT have no text and follow their line break
    with ``sub`` 1, 2, ...; the NEWLINE and DEDENTs that close open blocks at
    the end stand at the position after the last lexeme.  Names come from the
    Arrow classifier as small ids, turned into text by indexing a constant
    array (no join).  Rows leave a worker a piece of a batch at a time.
    """
    from ..functions.layout import TOKEN_NAMES, TOKENS_SCHEMA, token_batches
    lexed = df.select(F.col(key).alias("key"), L.py_lexemes(text).alias("lexemes"))
    rows = lexed.mapInArrow(token_batches, T.StructType([lexed.schema["key"], *T.StructType.fromDDL(TOKENS_SCHEMA)]))
    names = F.array(*[F.lit(n) for n in TOKEN_NAMES])
    return rows.select(F.col("key").alias(key), "pos", "sub", F.element_at(names, F.col("name") + 1).alias("name"), "text", "hidden")


def token_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text the neighbouring token pairs of its logical lines, and how many
    of them no syntax allows (see :mod:`codeweigh.functions.adjacency`).  Null text gives nulls."""
    from ..functions.adjacency import pairs_udf
    p = df.select(key, pairs_udf(L.py_lexemes(text)).alias("_p"))
    return p.select(key, "_p.pairs", "_p.pair_errors")


def bracket_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """T4: one row per bracket ``(key, pos, text, depth, match_pos, same_kind)``: the running
    count of open brackets after it, and its partner's place (null if it has none).
    Like the lexer's counter, matching goes by depth; ``same_kind`` tells whether ``(`` met ``)``."""
    from ..functions.layout import brackets_udf
    ex = df.select(key, F.explode(brackets_udf(L.py_lexemes(text))).alias("b"))
    return ex.select(key, "b.*")


def unknown_chars(df: DataFrame, key: str, text: str) -> DataFrame:
    """Characters no rule accepts, with their occurrence counts (per piece of an Arrow batch first)."""
    from ..functions.layout import unknown_batches
    partial = df.select(L.py_lexemes(text).alias("_lx")).mapInArrow(unknown_batches, "ch string, n bigint")
    return partial.groupBy("ch").agg(F.sum("n").alias("n"))


def token_histogram(df: DataFrame, key: str, text: str) -> DataFrame:
    """A4: frequency of every token name over a corpus (layout names included).

    Each Arrow batch is lexed in the JVM and counted in its Python worker
    (``mapInArrow``), so only one row per name per batch crosses the shuffle,
    whatever the corpus size or the share of its most frequent token.
    """
    from ..functions.layout import HISTOGRAM_SCHEMA, histogram_batches
    partial = df.select(L.py_lexemes(text).alias("_lx")).mapInArrow(histogram_batches, HISTOGRAM_SCHEMA)
    return partial.groupBy("name").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


def indent_widths(df: DataFrame, text: str) -> DataFrame:
    """Histogram of the column width of every physical line's leading blanks."""
    lines = df.select(F.explode(F.split(F.col(text), "\r\n|\r|\n|\f")).alias("line"))
    ws = lines.select(L.indent_width(F.regexp_extract("line", "^[ \t]*", 0)).alias("width"))
    return ws.groupBy("width").agg(F.count(F.lit(1)).alias("n_lines")).select(
        F.col("width").cast("bigint").alias("width"), "n_lines")


def java_token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Java tokens ``(key, pos, name, text, hidden)``.

    Whitespace and comments are on the hidden channel; characters no rule
    accepts are ``UNMATCHED`` and hidden.  Names are code-generated
    expressions over the lexeme (keyword set tests, a small fixed map for
    operators): no join.
    """
    ex = df.select(key, F.posexplode(L.java_lexemes(text)).alias("pos", "text"))
    named = ex.withColumn("pos", F.col("pos").cast("int"))
    t = F.col("text")
    words = dict(G.java_keyword_names())
    ops = dict(G.JAVA_OPERATORS)
    op_name = F.create_map(*[F.lit(x) for pair in ops.items() for x in pair])
    kw_name = (F.when(t.isin(*G.JAVA_KEYWORDS), F.upper(t))
               .when(t.isin(*[w for w in words if w not in G.JAVA_KEYWORDS]),
                     F.create_map(*[F.lit(x) for w in words if w not in G.JAVA_KEYWORDS
                                    for x in (w, words[w])])[t])
               .when(t.isin(*ops), op_name[t]))
    c0 = F.substring(t, 1, 1)
    n = F.length(t)
    is_num = c0.between("0", "9") | ((c0 == ".") & (n > 1) & (F.substring(t, 2, 1).between("0", "9")))
    cp = F.ascii(c0)  # code point of the first character
    ident_start = (cp.between(97, 122) | cp.between(65, 90) | cp.isin(36, 95) | (cp >= 128))
    number = (F.when(t.rlike("^0[xX]") & t.rlike("[pP]"), "HEX_FLOAT_LITERAL")
              .when(t.rlike("^0[xX]"), "HEX_LITERAL")
              .when(t.rlike("^0[bB]"), "BINARY_LITERAL")
              .when(t.rlike("[.eEfFdD]"), "FLOAT_LITERAL")
              .when(t.rlike("^0_*[0-7]"), "OCT_LITERAL")
              .otherwise("DECIMAL_LITERAL"))
    name = (F.when(kw_name.isNotNull(), kw_name)
            .when(c0.isin(" ", "\t", "\r", "\n", "\f"), "WS")
            .when(t.startswith("/*") & (n > 3), "COMMENT")
            .when(t.startswith("//"), "LINE_COMMENT")
            .when(is_num, number)
            .when(t.startswith('"""') & (n > 5), "TEXT_BLOCK")
            .when((c0 == '"') & (n > 1), "STRING_LITERAL")
            .when((c0 == "'") & (n > 1), "CHAR_LITERAL")
            .when(ident_start, "IDENTIFIER")
            .otherwise("UNMATCHED"))
    named = named.withColumn("name", name)
    hidden = F.col("name").isin("WS", "COMMENT", "LINE_COMMENT", "UNMATCHED")
    return named.select(key, "pos", "name", "text", hidden.alias("hidden"))
