"""The tokenized table that is refreshed file by file."""

import os

import pytest
from pyspark.sql import functions as F

from codeweigh.sources import token_cache as C


def put(spark, folder, name, rows):
    """One Parquet file of that name."""
    staged = os.path.join(os.path.dirname(folder), f"staged-{name}-{len(os.listdir(os.path.dirname(folder)))}")
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(staged)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(staged) if f.startswith("part-"))
    os.replace(os.path.join(staged, part), os.path.join(folder, f"{name}.parquet"))


def encode(rows):
    return rows.select("_path", "id", F.transform(F.split("text", ""), F.ascii).alias("ids"))


def table(refreshed):
    return sorted((r["id"], tuple(r["ids"])) for r in refreshed.table.collect())


def ids(text):
    return tuple(map(ord, text))


def test_only_changed_files_are_encoded(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "cache")
    for i in range(20):
        put(spark, src, f"f{i:02}", [(i, f"a{i}"), (100 + i, "b")])
    first = C.refresh(spark, src, path, encode, {"v": 1})
    assert len(first.encoded) == 20 and first.reused == 0 and table(first)[3] == (3, ids("a3"))
    again = C.refresh(spark, src, path, encode, {"v": 1})
    assert again.encoded == [] and again.reused == 20 and table(again) == table(first)
    put(spark, src, "f07", [(7, "new"), (7, "more")])
    one = C.refresh(spark, src, path, encode, {"v": 1})
    assert [os.path.basename(p) for p in one.encoded] == ["f07.parquet"] and one.reused == 19
    assert [r for r in table(one) if r[0] in (7, 107)] == [(7, ids("more")), (7, ids("new"))] and len(table(one)) == 40
    # a file that goes, one that comes, one that is only copied anew
    os.unlink(os.path.join(src, "f01.parquet"))
    put(spark, src, "f99", [(99, "z")])
    put(spark, src, "f02", [(2, "a2"), (102, "b")])
    os.utime(os.path.join(src, "f02.parquet"), (1, 1))
    last = C.refresh(spark, src, path, encode, {"v": 1})
    assert [os.path.basename(p) for p in last.encoded] == ["f99.parquet"]
    got = {r[0] for r in table(last)}
    assert 1 not in got and 101 not in got and 99 in got and {2, 102} <= got
    # other settings: all files are new
    assert len(C.refresh(spark, src, path, encode, {"v": 2}).encoded) == 20


def test_a_lost_driver_leaves_the_old_table(spark, tmp_path, monkeypatch):
    src, path = str(tmp_path / "src"), str(tmp_path / "cache")
    with pytest.raises(ValueError, match="no finished refresh"):
        C.read(spark, path)
    put(spark, src, "a", [(1, "x")])
    put(spark, src, "b", [(2, "y")])
    before = table(C.refresh(spark, src, path, encode, {}))
    put(spark, src, "a", [(1, "changed")])

    def dies(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(C, "tree_root", dies)  # the parts are written, the manifest is not
    with pytest.raises(RuntimeError):
        C.refresh(spark, src, path, encode, {})
    monkeypatch.undo()
    assert sorted((r["id"], tuple(r["ids"])) for r in C.read(spark, path).collect()) == before
    assert table(C.refresh(spark, src, path, encode, {})) == [(1, ids("changed")), (2, ids("y"))]


def test_root_depends_on_every_digest(spark):
    rows = [(f"p{i}", "e", f"d{i}", "a", "f") for i in range(300)]
    root = C.tree_root(spark.createDataFrame(rows, C._MANIFEST).repartition(4))
    assert root == C.tree_root(spark.createDataFrame(rows[::-1], C._MANIFEST))
    assert root != C.tree_root(spark.createDataFrame(rows[:-1] + [("p299", "e", "other", "a", "f")], C._MANIFEST))
