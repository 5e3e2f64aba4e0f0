"""The sink of trees in packs."""

from __future__ import annotations

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from leafmill.lineage import shared_folder
from leafmill.queries import QUERIES
from leafmill.sources import packs, trees

KIND = "rel_path string, content string"


def rows(spark, parts=3, **files):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], KIND).repartition(parts)


def tree(spark, path):
    found = [(r.rel_path, bytes(r.content).decode()) for r in packs.read_tree(spark, path).collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


def on_disk(tmp_path):
    return [p.relative_to(tmp_path) for p in tmp_path.rglob("*.tar.zst")]


def test_a_tree_of_pages_takes_few_files(spark):
    """Loose, each page takes a file and a folder of its own."""
    from pathlib import Path

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("tree-*"))
    out = QUERIES["s13b_file_tree"](spark, "/root/testdata/sf0.001")
    (made,) = set(shared.glob("tree-*")) - before
    assert out.count() == 1650
    assert len(list(made.rglob("*"))) < 100 and sum(p.stat().st_size for p in made.rglob("*")) < 400_000


def test_whole_trees(spark, tmp_path):
    path = str(tmp_path / "out")
    assert tree(spark, path) == {}
    long = "ü" * 90 + "/" + "x" * 300
    first = spark.createDataFrame([("One/A b/ä%20ß#1.md", "text\n"), ("One/x.md", ""), ("One/.media/f", "bytes"), (long, "y"), ("line\nend", "z"), ("null", None), ("big", "0123456789" * 300_000)], KIND)
    packs.write_tree(first, path)
    assert tree(spark, path) == {r.rel_path: r.content or "" for r in first.collect()}
    packs.write_tree(rows(spark, a="1", b__c="2"), path)
    assert tree(spark, path) == {"a": "1", "b/c": "2"} and len(on_disk(tmp_path)) <= 2
    packs.write_tree(first.limit(0), path)
    assert tree(spark, path) == {} and not on_disk(tmp_path)


def test_packs_unpack_to_the_files(spark, tmp_path):
    files = {f"d{k % 7}/{k}.md": f"page {k}\n" * (k % 5) for k in range(500)}
    packs.write_tree(spark.createDataFrame(list(files.items()), KIND).repartition(4), str(tmp_path / "out"))
    found = {}
    for p in (tmp_path / "out").rglob("*.tar.zst"):
        import pyarrow as pa

        with tarfile.open(fileobj=io.BytesIO(pa.input_stream(str(p), compression="zstd").read())) as tar:
            found |= {m.name: tar.extractfile(m).read().decode() for m in tar}
    assert found == files
    trees.write_tree(packs.read_tree(spark, str(tmp_path / "out")), str(tmp_path / "loose"))
    assert {r.rel_path: bytes(r.content).decode() for r in trees.read_tree(spark, str(tmp_path / "loose")).collect()} == files


def test_a_write_that_fails_leaves_the_tree_before(spark, tmp_path):
    path = str(tmp_path / "out")
    packs.write_tree(rows(spark, a="1"), path)
    bad = spark.range(2000).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("rel_path"), F.when(F.col("id") == 1777, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).cast("string").alias("content")).repartition(4)
    for failing in (bad, rows(spark, ok="1").union(spark.createDataFrame([("../out", "x")], KIND)), spark.createDataFrame([("/etc/x", "x")], KIND), spark.createDataFrame([("a\0b", "x")], KIND)):
        for write in (packs.write_tree, lambda rows, path: packs.update_tree(rows, spark.createDataFrame([("a",)], "rel_path string"), path)):
            with pytest.raises(Exception):
                write(failing, path)
            assert tree(spark, path) == {"a": "1"} and len(on_disk(tmp_path)) == 1


def test_changes(spark, tmp_path):
    path, draw, held = str(tmp_path / "out"), random.Random(5), {}
    for turn in range(5):
        new = {f"d{n % 5}/{n}": f"{turn}-{n}" for n in draw.sample(range(300), 60 if turn else 200)}
        gone = [f"d{n % 5}/{n}" for n in draw.sample(range(300), 40)] + ["never", "d1/1"] * 2
        packs.update_tree(spark.createDataFrame(list(new.items()), KIND).repartition(3), spark.createDataFrame([(g,) for g in gone], "rel_path string"), path)
        held = {k: v for k, v in held.items() if k not in gone} | new
        assert tree(spark, path) == held
        named = packs._current(path)
        assert sorted(str(p).removeprefix("out/").removesuffix(".tar.zst") for p in on_disk(tmp_path)) == sorted(named)
        assert sorted(r.rel_path for r in packs._named(spark, path, named).collect()) == sorted(held)
    packs.update_tree(spark.createDataFrame([], KIND), spark.createDataFrame([(k,) for k in held], "rel_path string"), path)
    assert tree(spark, path) == {} and not on_disk(tmp_path)


def test_rows_of_one_path(spark, tmp_path):
    """One row of each path stays, whether a task has them all or each has some."""
    files = [(f"p{k % 50}", str(k)) for k in range(2000)]
    for parts in (1, 6):
        path = str(tmp_path / f"out{parts}")
        packs.write_tree(spark.createDataFrame(files, KIND).repartition(parts), path)
        found = tree(spark, path)
        assert sorted(found) == sorted({p for p, _ in files}) and all((p, c) in files for p, c in found.items())


def test_packs_end(tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "FILES", 10)
    monkeypatch.setattr(packs, "BYTES", 1000)
    files = [(f"f{k}", bytes(k % 3 * 100)) for k in range(95)] + [("large", bytes(5000)), ("last", b"")]
    out = packs._Packs(str(tmp_path), "w")
    for rel, data in files:
        out.add(rel, data)
    done = [list(packs._entries(str(tmp_path), p)) for p in out.close()]
    assert [e for p in done for e in p] == files and max(map(len, done)) <= 10
    assert all(sum(len(d) for _, d in p[:-1]) < 1000 for p in done)


def test_headers_are_those_of_tarfile():
    names = ["a", "One/A b/x.md", "x" * 100, "y" * 101, "d/" + "z" * 300, "ü/ß", "line\nend"]
    for name in names:
        for size in (0, 1, 512, 8**11 - 1, 8**11):
            entry = tarfile.TarInfo(name)
            entry.size = size
            assert packs._head(name, size) == entry.tobuf(tarfile.PAX_FORMAT, "utf-8", "strict")


def test_plain_entries_need_no_tarfile(tmp_path, monkeypatch):
    """Also of archives that tarfile has made; what isn't plain is read by it, from the first such entry on."""
    files = [(f"d{k % 7}/{k}.md", b"x" * (k * 37 % 1500)) for k in range(200)]
    system, base = packs.open_path(str(tmp_path))
    with system.open_output_stream(f"{base}/theirs.tar.zst", compression="zstd") as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        for rel, data in files:
            entry = tarfile.TarInfo(rel)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    own = packs._Packs(str(tmp_path), "w")
    for rel, data in [*files, ("big", bytes(3 << 20)), ("after", b"1")]:
        own.add(rel, data)
    odd = packs._Packs(str(tmp_path), "w")
    for rel, data in [*files, ("x" * 300, b"long"), *[(f"more/{rel}", data) for rel, data in files]]:
        odd.add(rel, data)
    (own,), (odd,) = own.close(), odd.close()
    assert [e for e in packs._entries(str(tmp_path), odd)] == [*files, ("x" * 300, b"long"), *[(f"more/{rel}", data) for rel, data in files]]
    monkeypatch.setattr(tarfile, "open", None)
    assert list(packs._entries(str(tmp_path), "theirs")) == files
    assert list(packs._entries(str(tmp_path), own)) == [*files, ("big", bytes(3 << 20)), ("after", b"1")]


def test_damaged_packs_are_errors(tmp_path):
    out = packs._Packs(str(tmp_path), "w")
    for k in range(50):
        out.add(f"f{k}", bytes(700))
    (pack,) = out.close()
    system, base = packs.open_path(str(tmp_path))
    whole = system.open_input_stream(f"{base}/{pack}.tar.zst", compression="zstd").read()
    for damaged in (whole[: 20 * 1536 + 900], whole[: 20 * 1536 + 100], whole[: 20 * 1536 + 3] + b"?" + whole[20 * 1536 + 4 :]):
        with system.open_output_stream(f"{base}/{pack}.tar.zst", compression="zstd") as stream:
            stream.write(damaged)
        with pytest.raises(tarfile.TarError):
            list(packs._entries(str(tmp_path), pack))
