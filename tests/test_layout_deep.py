"""Deep trees, long folder chains, cycles and walks, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from leafmill.operators import layout as L

PAGES = "space_id string, page_id string, title string, parent_id string, parent_type string, position int, status string, ord bigint"
FOLDERS = "space_id string, folder_id string, title string, parent_id string, parent_type string, position int, ord bigint"
SPACES = "space_id string, name string"


def layout(spark, pages, folders=(), spaces=("s",)):
    rows = [(s, i, t, p, "page", 0, "current", k) for k, (s, i, t, p) in enumerate(pages)]
    return L.layout(spark.createDataFrame([(s, s.upper()) for s in spaces], SPACES), spark.createDataFrame(rows, PAGES), spark.createDataFrame(list(folders), FOLDERS))


def test_five_thousand_levels(spark):
    depth = 5000
    pages = [("s", f"{k:05}", "p", f"{k - 1:05}" if k else "") for k in range(depth)] + [("s", "side", "q", "02500")]
    placed = layout(spark, pages).select("node_id", F.size("path_ids").alias("n"), F.sha2("dir", 256).alias("dir"), "ranks").where("node_id in ('00000', '02500', '04999', 'side')")
    got = {r.node_id: r for r in placed.collect()}
    assert {k: r.n for k, r in got.items()} == {"00000": 1, "02500": 2501, "04999": 5000, "side": 2502}
    want = spark.range(1).select(F.sha2(F.concat(F.lit("S"), F.repeat(F.lit("/p"), depth)), 256), F.sha2(F.concat(F.lit("S"), F.repeat(F.lit("/p"), 2501), F.lit("/q")), 256)).first()
    assert (got["04999"].dir, got["side"].dir) == tuple(want)


def test_cycles_and_what_hangs_on_them(spark):
    pages = [("s", "a", "A", ""), ("s", "b", "B", "a"), ("s", "x", "X", "z"), ("s", "y", "Y", "x"), ("s", "z", "Z", "y"), ("s", "self", "S", "self"), ("t", "a", "T", "")]
    pages += [("s", f"h{k}", "H", f"h{k - 1}" if k else "y") for k in range(9)]
    placed = layout(spark, pages, spaces=("s", "t")).cache()
    assert sorted((r.space_id, r.node_id, r.dir) for r in placed.collect()) == [("s", "a", "S/A"), ("s", "b", "S/A/B"), ("t", "a", "T/T")]
    tree = L.nodes(spark.createDataFrame([(s, i, t, p, "page", 0, "current", k) for k, (s, i, t, p) in enumerate(pages)], PAGES), spark.createDataFrame([], FOLDERS))
    assert sorted(r.key for r in L.unreached(tree, placed).collect()) == sorted(["x", "y", "z", "self", *(f"h{k}" for k in range(9))])


def test_random_trees_equal_a_walk(spark):
    draw = random.Random(2)
    pages, kids = [], {}
    for space in "st":
        for k in range(300):
            parent = "" if k == 0 or draw.random() < 0.02 else f"{draw.randint(max(0, k - 12), k - 1):03}"
            pages.append((space, f"{k:03}", draw.choice("abc"), parent))
            kids.setdefault((space, parent), []).append(f"{k:03}")
    titles = {(s, i): t for s, i, t, _ in pages}
    want = {}

    def walk(space, parent, at, number):
        used = {}
        for node in sorted(kids.get((space, parent), [])):
            title = titles[space, node]
            used[title] = used.get(title, 0) + 1
            here = f"{at}/{title}" + (f"-{used[title]}" if used[title] > 1 else "")
            number += 1
            want[space, node] = (here, number)
            number = walk(space, node, here, number)
        return number

    for space in "st":
        walk(space, "", space.upper(), 0)
    got = {(r.space_id, r.node_id): (r.dir, r.ord) for r in L.preorder(layout(spark, pages, spaces=("s", "t"))).collect()}
    assert got == want


def test_a_chain_of_pages_is_no_task_s_work(spark):
    # All pages below one top: ranges cut through it.
    pages = spark.range(20000).select(F.lit("s").alias("space_id"), F.format_string("%06d", "id").alias("node_id"), F.lit("page").alias("kind"), F.array(F.lit(1), F.lit(1), F.col("id").cast("int")).alias("ranks"))
    walked = L.preorder(pages.repartition(8)).cache()
    assert walked.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 20000 or walked.rdd.getNumPartitions() == 1
    assert walked.where("ord <> cast(node_id as bigint) + 1").count() == 0


def test_folder_closure(spark):
    chain = [("s", f"f{k}", "F", f"f{k + 1}" if k < 199 else "gone", "folder", 0, k) for k in range(200)]
    ring = [("s", f"r{k}", "R", f"r{(k + 1) % 7}", "folder", 0, k) for k in range(7)]
    rest = [("s", "u", "U", "f3", "folder", 0, 1), ("s", "v", "V", "f0", "page", 0, 2), ("t", "f5", "F", "", "", 0, 3)]
    pages = spark.createDataFrame([("s", "1", "T", "f4", "folder", 0, "current", 1), ("s", "2", "T", "r2", "folder", 0, "current", 2), ("s", "3", "T", "v", "folder", 0, "current", 3), ("s", "4", "T", "none", "folder", 0, "current", 4), ("s", "5", "T", "u", "page", 0, "current", 5)], PAGES)
    got = L.folder_closure(pages, spark.createDataFrame(chain + ring + rest, FOLDERS))
    assert sorted((r.space_id, r.folder_id) for r in got.collect()) == sorted(("s", i) for i in [*(f"f{k}" for k in range(4, 200)), *(f"r{k}" for k in range(7)), "v"])
