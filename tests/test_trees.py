"""The sink of file trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.sources import trees


def rows(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], "rel_path string, content string").repartition(3)


def folders(tmp_path, kind):
    return [p for p in (tmp_path / "out").glob(f"{kind}-*") if not p.name.endswith(("-names", "-gone", "-all"))]


def tree(spark, path):
    return {r.rel_path: bytes(r.content).decode() for r in trees.read_tree(spark, path).collect()}


def test_whole_trees(spark, tmp_path):
    path = str(tmp_path / "out")
    assert tree(spark, path) == {}
    first = spark.createDataFrame([("One/A b/ä%20ß#1.md", "text\n"), ("One/x.md", ""), ("One/.media/f", "bytes"), ("tree-x/tree-x/y.md", "y")], "rel_path string, content string")
    trees.write_tree(first, path)
    assert tree(spark, path) == {r.rel_path: r.content for r in first.collect()}
    trees.write_tree(rows(spark, a="1", b__c="2"), path)
    assert tree(spark, path) == {"a": "1", "b/c": "2"} and len(folders(tmp_path, "tree")) == 1
    trees.write_tree(first.limit(0), path)
    assert tree(spark, path) == {}


def test_a_task_that_fails_leaves_the_tree_before(spark, tmp_path):
    path = str(tmp_path / "out")
    trees.write_tree(rows(spark, a="1"), path)
    bad = spark.range(2000).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("rel_path"), F.when(F.col("id") == 1777, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).cast("string").alias("content")).repartition(4)
    for failing in (bad, rows(spark, ok="1").union(spark.createDataFrame([("../out", "x")], "rel_path string, content string")), spark.createDataFrame([("/etc/x", "x")], "rel_path string, content string")):
        with pytest.raises(Exception):
            trees.write_tree(failing, path)
        assert tree(spark, path) == {"a": "1"} and len(folders(tmp_path, "tree")) == 1


def test_changes_in_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    gone = lambda *names: spark.createDataFrame([(n,) for n in names], "rel_path string")
    trees.update_tree(rows(spark, a="1", b__c="2", d="3"), gone(), path)
    assert tree(spark, path) == {"a": "1", "b/c": "2", "d": "3"}
    trees.update_tree(rows(spark, a="new", e__f="4"), gone("d", "a", "never"), path)
    assert tree(spark, path) == {"a": "new", "b/c": "2", "e/f": "4"}
    # A run that dies with its changes written but not all in place.
    with monkeypatch.context() as m:
        m.setattr(trees, "recover", lambda spark, path: False)
        trees.update_tree(rows(spark, a="newer", g="5"), gone("b/c"), path)
    assert tree(spark, path)["a"] == "new"
    (folders(tmp_path, "change")[0] / "g").rename(folders(tmp_path, "tree")[0] / "g")
    trees.update_tree(rows(spark, h="6"), gone(), path)
    assert tree(spark, path) == {"a": "newer", "e/f": "4", "g": "5", "h": "6"} and not folders(tmp_path, "change") and not trees.recover(spark, path)


def test_documents_and_media(spark, tmp_path):
    media = spark.createDataFrame([("One/.media/p.png", "d"), ("One/.media/none.png", "e")], "path string, digest string")
    blobs = spark.createDataFrame([("d", bytearray(b"\x00\xff"))], "digest string, content binary")
    trees.write_tree(trees.tree_rows(rows(spark, One__x="ü"), media, blobs), str(tmp_path))
    assert {r.rel_path: bytes(r.content) for r in trees.read_tree(spark, str(tmp_path)).collect()} == {"One/x": "ü".encode(), "One/.media/p.png": b"\x00\xff"}
