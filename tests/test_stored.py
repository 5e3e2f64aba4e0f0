"""Tables are computed once, stored small and removed when nothing needs them; rows meet as seldom as they can."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from leafmill.lineage import settled, shared_folder, stored
from leafmill.operators import attachments as A
from leafmill.plans import reconcile as R

HEX = "0123456789abcdef" * 4


def folders(spark) -> set[str]:
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("rows-")}


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    rows = stored(spark.range(100).select(F.udf(count, "long")("id").alias("a"), F.lit("x").alias("A b")))
    assert seen.value == 100
    assert rows.columns == ["a", "A b"] and rows.agg(F.sum("a")).first()[0] == 4950


def test_any_columns(spark):
    rows = stored(spark.sql("select 1 as a, 2 as A, null as b, map('k', 1) as m"))
    assert rows.columns == ["a", "A", "b", "m"] and [tuple(r) for r in rows.collect()] == [(1, 2, None, {"k": 1})]
    assert rows.schema["b"].dataType.simpleString() == "void"
    assert stored(spark.range(3).where("id > 5")).count() == 0


def test_steps_are_removed(spark):
    before, held = folders(spark), {}

    def make():
        held["kept"] = stored(spark.range(5), kept=True)
        return stored(spark.range(10)).join(settled(lambda: stored(spark.range(3))), "id").join(held["kept"], "id")

    rows = settled(make)
    assert rows.count() == 3 and held["kept"].count() == 5
    assert len(folders(spark) - before) == 2


def test_digests_are_packed_and_unpacked(spark):
    given = [HEX, HEX.upper(), HEX[:-1], "", "fresh", "#", "é" * 70, None]
    rows = spark.createDataFrame([(d,) for d in given], "d string").select("d", A.packed("d").alias("k"))
    got = rows.select("d", "k", A.unpacked("k").alias("u")).collect()
    assert [r.u for r in got] == given
    assert len({bytes(r.k) for r in got if r.k is not None}) == len(given) - 1
    assert len(next(r.k for r in got if r.d == HEX)) == 32


def test_titles_meet_once(spark):
    named = spark.createDataFrame(
        [("1", "a", "F.png", "f.png", "2024", "F.png"), ("1", "b", "f.png", "f.png", "2023", "f-b.png"), ("1", "c", "f.png", "f.png", "2022", "f-c.png"), ("2", "d", "Solo", "solo", "2024", "Solo"), ("2", "e", None, None, "2024", "attachment")],
        "page_id string, att_id string, title string, folded string, created_at string, local_name string",
    )
    refs = spark.createDataFrame([("1", "b", "x"), ("1", "", "f.png"), ("1", "zz", "F.png"), ("1", "", "F.PNG"), ("2", "", "SOLO"), ("2", "", "gone")], "page_id string, att_id string, title string")
    rows = A.resolve_refs(refs, named)
    assert {(r.page_id, r.title): r.local_name for r in rows.collect()} == {("1", "x"): "f-b.png", ("1", "f.png"): "f-c.png", ("1", "F.png"): "F.png", ("1", "F.PNG"): "F.PNG", ("2", "SOLO"): "Solo", ("2", "gone"): "gone"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(A.resolve_refs(refs, named)) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_owned_paths_meet_once(spark):
    state = "space_id string, page_id string, dir string, file string"
    old = spark.createDataFrame([("s", "1", "a", "a/A.md"), ("s", "2", "b", "b/b.md"), ("s", "2", "b", "b/b.md")], state)
    new = spark.createDataFrame([("s", "1", "a", "a/a.md")], state)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = R.deletions(R.owned_paths(old), R.owned_paths(new))
        assert [r.path for r in rows.collect()] == ["b/b.md"]
        assert exchanges(R.deletions(R.owned_paths(old), R.owned_paths(new))) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_without_bytes_go_no_further(spark):
    pairs = spark.createDataFrame([("1", "x1", "p.drawio", 1, "y1", 1, True), ("1", "x2", "q.drawio", 1, None, None, False), ("1", "x3", "r.drawio", 1, None, None, False), ("1", "x4", "s.drawio", 1, "y4", 1, True)], "page_id string, xml_id string, xml_title string, xml_version int, png_id string, png_version int, preview_fresh boolean")
    named = spark.createDataFrame([("1", "y1", "p.drawio.png"), ("1", "y4", "s.drawio.png"), ("1", "z", "q.png")], "page_id string, att_id string, local_name string")
    digests = spark.createDataFrame([("y1", 1, "d1"), ("x2", 1, HEX), ("x3", 1, "d3")], "att_id string, version int, digest string")
    derived = spark.createDataFrame([(2, HEX, "png2"), (1, "d3", "png3"), (2, "d3", "lost")], "render_version int, xml_digest string, png_digest string")
    blobs = spark.createDataFrame([("png2",), ("png3",)], "digest string")
    got = {tuple(r) for r in A.rendered_media(pairs, named, digests, derived, blobs).collect()}
    assert got == {("1", "p.drawio", "p.drawio.png", None), ("1", "q.drawio", "q-rendered.png", "png2")}
    assert {r.xml_digest for r in A.render_queue(pairs, digests, derived, blobs).collect()} == {"d3"}


def test_diagrams_are_inflated_some_at_a_time(spark):
    rows = spark.createDataFrame([(b"<diagram>x</diagram>",), (None,)], "c binary").select(A.inflate_diagram("c").alias("t"))
    assert "BatchEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in rows.collect()] == ["<diagram>x</diagram>", None]
