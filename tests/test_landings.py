"""Damaged listings, and files of any size."""

from __future__ import annotations

import hashlib
import json
import os
import resource

from leafmill.plans import export as E
from leafmill.plans import reconcile as R
from leafmill.plans import state as S
from leafmill.sources import files, listings

from test_publish import inputs


def test_a_cut_line_is_told_and_the_rest_is_read(spark, tmp_path):
    for space, lines in {"s": ['{"results": [{"id": 1, "title": "a", "spaceId": "s"}, {"id": "2", "title": "b", "spaceId": "s"}]}', '{"results": [{"id": 3, "title": "c"'], "t": ['{"results": null}', '{"results": [{"id": 4, "title": "d", "spaceId": "t"}]}']}.items():
        folder = tmp_path / f"space_id={space}"
        folder.mkdir()
        (folder / "pages.json").write_text("\n".join(lines))
    rows, damaged = listings.read_landing(spark, str(tmp_path), "pages_v2")
    assert sorted((r.space_id, r.page_id, r.title) for r in listings.pages_from_v2(rows).collect()) == [("s", "1", "a"), ("s", "2", "b"), ("t", "4", "d")]
    assert [(r.space_id, r.kind, r.lines) for r in damaged.collect()] == [("s", "pages_v2", 1)]
    spaces = spark.createDataFrame([("s",), ("t",)], "space_id string")
    assert sorted(map(tuple, R.damage_flags(spaces, damaged).collect())) == [("s", False, False), ("t", True, True)]
    assert [(r.space_id, r.kind, r.message) for r in R.damage_warnings(damaged).collect()] == [("s", "damaged lines", "1 lines of pages_v2")]
    # Damage of attachments leaves the pages complete; without folders by space it is every space's.
    atts = spark.createDataFrame([("s", "attachments_v2", "f", 1)], damaged.schema)
    assert sorted(map(tuple, R.damage_flags(spaces, atts).collect())) == [("s", False, True), ("t", True, True)]
    unknown = spark.createDataFrame([(None, "pages_v1", "f", 1)], damaged.schema)
    assert sorted(map(tuple, R.damage_flags(spaces, unknown).collect())) == [("s", False, False), ("t", False, False)]
    assert sorted(map(tuple, R.damage_flags(spaces, damaged.limit(0)).collect())) == [("s", True, True), ("t", True, True)]


def test_a_damaged_listing_deletes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    pages = [("s", "1", "Home", "", 1, "h"), ("s", "2", "Kid", "1", 1, "k"), ("t", "9", "Top", "", 1, "t"), ("t", "8", "Sub", "9", 1, "x")]
    E.run(spark, inputs(spark, pages, atts=[("1", "a", "f.pdf", 1)], digests=[("a", 1, "d1")]), folder)
    # Both spaces list a page less, s because its dump is cut off; its attachment is missing as well.
    damage = spark.createDataFrame([("s", "pages_v2", "f.json", 2)], "space_id string, kind string, source string, lines bigint")
    out = E.run(spark, inputs(spark, [("s", "1", "Home", "", 2, "new"), pages[2]], damage=damage), folder)
    assert [r.path for r in out.deletions.collect()] == ["Two/Top/Sub/Sub.md"]
    assert sorted(r.rel_path for r in S.load_documents(spark, folder).collect()) == ["One/Home/Home.md", "One/Home/Kid/Kid.md", "Two/Top/Top.md"]
    assert [r.att_id for r in S.load_state(spark, folder, "state_attachments").collect()] == ["a"]
    assert [(r.space_id, r.stage, r.key) for r in out.warnings.where("stage = 'listing'").collect()] == [("s", "listing", "f.json")]


def test_digests_of_files(spark, tmp_path):
    made = {"a.txt": b"one", "d/.hidden/b": b"", "d/c%20 ü.bin": os.urandom(300_000)}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.digest_files(spark, str(tmp_path), share=100_000)
    assert {r.rel_path: (r.digest, r.size) for r in found.collect()} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in made.items()}
    assert found.rdd.getNumPartitions() == 2
    assert files.digest_files(spark, str(tmp_path / "none")).collect() == []


def test_a_file_above_two_gigabytes(tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
    reader = files.DigestReader(str(tmp_path), files.SHARE)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (row,) = reader.read(reader.partitions()[0])
    assert row[0] == "large" and row[2] == 3 << 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024
    assert json.dumps(row[1])
