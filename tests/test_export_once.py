"""A run makes its pages once, however often it uses them."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from leafmill.adapters import Tree
from leafmill.functions.render import jobs as J
from leafmill.lineage import shared_folder
from leafmill.plans import export as E
from leafmill.queries_more import two_snapshots


def test_pages_are_made_once(spark):
    first, _ = two_snapshots(Tree(spark, "/root/testdata/sf0.001"))
    made = spark.sparkContext.accumulator(0)

    def seen(body: str) -> str:
        made.add(1)
        return body

    given = replace(first, pages=first.pages.withColumn("body", F.udf(seen, "string", useArrow=False)("body")))
    E.run(spark, given, f"{shared_folder(spark)}/export-{uuid.uuid4().hex}", include_archived=True)
    assert made.value == first.pages.count()


def test_references_in_whatever_case_are_found(spark):
    bodies = ["<p>plain</p>", '<ac:image><ri:attachment ri:filename="a"/></ac:image>', '<AC:IMAGE><RI:ATTACHMENT ri:filename="b"/></AC:IMAGE>', '<ac:structured-macro ac:name="view-file"><ac:parameter ac:name="name">c</ac:parameter></ac:structured-macro>', "<![CDATA[<ri:attachment/>]]>"]
    pages = spark.createDataFrame([("s", str(k), "T", b) for k, b in enumerate(bodies)], "space_id string, page_id string, title string, body string")
    named = spark.createDataFrame([(str(k), f"i{k}", n, f"local-{n}", n, "image/png", "", k) for k, n in enumerate("xabcd")], "page_id string, att_id string, title string, local_name string, folded string, media_type string, created_at string, ord int")
    found = {r.page_id: [(f["name"], f["local"]) for f in r.files] for r in J.wide(pages, named).collect()}
    assert found == {"0": [], "1": [("a", "local-a")], "2": [("b", "local-b")], "3": [("c", "local-c")], "4": []}
