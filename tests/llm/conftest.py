import os
import random

import pytest

SF01 = "/root/testdata/sf0.01"
#: Names of extra columns that clash with outputs and helper columns of the operators.
CLASHES = ["kept", "score", "digest", "family", "ids", "n", "payload", "start", "lang_pred", "whole", "_metadata", "rank"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    """Null, empty, blank, very long, tied and repeated texts."""
    base = prose(1, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base.replace(" ", "\n")), (6, base), (6, base), (7, "one two"), (8, "one two"),
            (9, "one"), (10, prose(2, 30_000, 5000)), (11, "a " * 20_000), (12, base + " tail end"), (13, "x" * 50_000), (14, "Été 日本 😀 \x00 ▁"),
            (15, "Mail a.b@c.example.com now")]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables to a fresh folder: tables(documents=[(id, text)], benchmark=..., ...) -> folder."""

    def make(**named):
        top = str(tmp_path_factory.mktemp("tables"))
        schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string",
                   "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}
        for name, rows in named.items():
            width = schemas[name].count(",") + 1
            rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
            df = spark.createDataFrame(rows, schemas[name])
            for c in CLASHES:
                df = df.selectExpr("*", f"'clash' as `{c}`")
            df.repartition(3).write.parquet(os.path.join(top, f"{name}.parquet"))
        return top

    return make
