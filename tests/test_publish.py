"""Publishing space by space, and whole runs over parts of the spaces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill import tables
from leafmill.plans import export as E
from leafmill.plans import fingerprints as P
from leafmill.plans import state as S
from leafmill.streaming import increment

PAGES = "space_id string, page_id string, title string, parent_id string, parent_type string, position int, status string, body string, version int, web_url string, last_modified string, author string, ord bigint"
FOLDERS = "space_id string, folder_id string, title string, parent_id string, parent_type string, position int, ord bigint"
ATTS = "space_id string, page_id string, att_id string, title string, media_type string, version int, created_at string, file_size bigint, download_url string, ord bigint"


def states(spark, *rows):
    """state_pages of (space, page, title)."""
    df = spark.createDataFrame([(s, p, t, f"{s}/{p}.md") for s, p, t in rows], "space_id string, page_id string, title string, file string")
    return tables.normalize(df, "state_pages")


def titles(spark, folder, name="state_pages", **version):
    return sorted((r.space_id, r.page_id, r.title) for r in S.load_state(spark, folder, name, **version).collect())


def media(spark, *rows):
    return tables.normalize(spark.createDataFrame(list(rows), "space_id string, page_id string, att_id string"), "state_attachments")


def test_a_run_replaces_its_own_spaces_and_tables_only(spark, tmp_path):
    folder = str(tmp_path / "state")
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "a"), ("t", "2", "b"), ("", "3", "c")), "state_attachments": media(spark, ("s", "1", "x"), ("t", "2", "y"))}, folder)
    # One space, one table; the other space has no rows any more.
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "new"))}, folder)
    assert titles(spark, folder) == [("", "3", "c"), ("s", "1", "new"), ("t", "2", "b")]
    assert S.load_state(spark, folder, "state_attachments").count() == 2
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "space_id string")
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "new")).limit(0), "state_attachments": media(spark, ("s", "1", "z")).limit(0)}, folder, spaces=of("s"))
    assert titles(spark, folder) == [("", "3", "c"), ("t", "2", "b")]
    assert [r.att_id for r in S.load_state(spark, folder, "state_attachments").collect()] == ["y"]
    # Earlier versions can still be read; the first two tables of no space are whole.
    assert titles(spark, folder, version=1)[1:] == [("s", "1", "a"), ("t", "2", "b")] and S.current_version(spark, folder) == 3
    users = spark.createDataFrame([("u", "Ann")], "account_id string, display_name string")
    S.save_state(spark, {"users": users}, folder)
    S.save_state(spark, {"users": users.withColumn("display_name", F.lit("Eve"))}, folder)
    assert [r.display_name for r in S.load_state(spark, folder, "users").collect()] == ["Eve"] and titles(spark, folder) == [("", "3", "c"), ("t", "2", "b")]


def test_rows_of_a_file_stand_in_order(spark, tmp_path):
    rows = states(spark, *[("s", f"{k:03}", "t") for k in range(200)]).repartition(3)
    S.save_state(spark, {"state_pages": rows}, str(tmp_path))
    for file in (tmp_path / "data" / "state_pages").glob("run=*/space_id=s/*.parquet"):
        ids = [r.page_id for r in spark.read.parquet(str(file)).collect()]
        assert ids == sorted(ids) and ids


def test_of_two_runs_over_one_space_the_second_fails(spark, tmp_path):
    folder = str(tmp_path / "state")
    base = S.save_state(spark, {"state_pages": states(spark, ("s", "1", "a"), ("t", "2", "b"))}, folder)
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "first"))}, folder, base=base)
    with pytest.raises(S.PublishConflict):
        S.save_state(spark, {"state_pages": states(spark, ("s", "1", "second"))}, folder, base=base)
    assert titles(spark, folder) == [("s", "1", "first"), ("t", "2", "b")]
    # A run over the other space goes on top of it.
    assert S.save_state(spark, {"state_pages": states(spark, ("t", "2", "other"))}, folder, base=base) == 3
    assert titles(spark, folder) == [("s", "1", "first"), ("t", "2", "other")]


def test_a_claimed_version_is_not_overwritten(spark, tmp_path):
    folder = str(tmp_path / "state")
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "a"))}, folder)
    # A run that died between claiming a version and writing it.
    (tmp_path / "state" / "manifests" / f"{2:010d}.json").touch()
    assert titles(spark, folder) == [("s", "1", "a")] and S.current_version(spark, folder) == 1
    with pytest.raises(S.PublishConflict):
        S.save_state(spark, {"state_pages": states(spark, ("s", "1", "b"))}, folder)
    S.withdraw(spark, folder, 1)
    S.withdraw(spark, folder, 2)
    assert S.save_state(spark, {"state_pages": states(spark, ("s", "1", "b"))}, folder) == 2
    assert titles(spark, folder) == [("s", "1", "b")]


def test_vacuum(spark, tmp_path):
    folder = str(tmp_path / "state")
    for title in "abcd":
        S.save_state(spark, {"state_pages": states(spark, ("s", "1", title))}, folder)
    S.save_state(spark, {"state_pages": states(spark, ("t", "2", "x"))}, folder)
    assert S.vacuum(spark, folder, keep=1) == 0
    assert S.vacuum(spark, folder, keep=1, older_than_hours=0.0) > 0
    assert len(list((tmp_path / "state" / "data" / "state_pages").glob("run=*"))) == 2 and S.current_version(spark, folder) == 5
    assert titles(spark, folder) == [("s", "1", "d"), ("t", "2", "x")]


def test_a_stream_batch_keeps_the_other_tables(spark, tmp_path):
    folder, source = str(tmp_path / "state"), tmp_path / "in"
    S.save_state(spark, {"state_pages": states(spark, ("s", "1", "a"), ("t", "2", "b")), "state_attachments": media(spark, ("s", "1", "x"))}, folder)
    source.mkdir()
    (source / "1.json").write_text('{"space_id": "s", "page_id": "1", "title": "new", "version": 7}')
    edits = spark.readStream.schema("space_id string, page_id string, title string, version int").json(str(source))
    increment.follow(edits, folder, str(tmp_path / "check")).awaitTermination(120)
    assert titles(spark, folder) == [("s", "1", "new"), ("t", "2", "b")] and S.load_state(spark, folder, "state_attachments").count() == 1


def inputs(spark, pages, spaces=(("s", "K", "One"), ("t", "L", "Two")), folders=(), atts=(), digests=(), **more):
    """Canonical tables from pages (space, id, title, parent, version, body[, status]) and attachments (page, id, title, version)."""
    rows = [(s, i, t, p, "page" if p else "", 0, *(status or ["current"]), b, v, "", "2024", "u1", k) for k, (s, i, t, p, v, b, *status) in enumerate(pages)]
    return E.Inputs(
        spaces=spark.createDataFrame(list(spaces), "space_id string, space_key string, name string"),
        pages=spark.createDataFrame(rows, PAGES),
        folders=spark.createDataFrame([(s, i, t, p, "folder", 0, k) for k, (s, i, t, p) in enumerate(folders)], FOLDERS),
        attachments=spark.createDataFrame([("", p, i, t, "x", v, "2024", 5, "", k) for k, (p, i, t, v) in enumerate(atts)], ATTS),
        users=spark.createDataFrame([("u1", "Ann")], "account_id string, display_name string"),
        digests=spark.createDataFrame(list(digests), "att_id string, version int, digest string"),
        derived=spark.createDataFrame([], "render_version int, xml_digest string, png_digest string"),
        **more,
    )


def files(spark, folder):
    return {r.rel_path: r.content for r in S.load_documents(spark, folder).collect()}


def test_a_run_over_one_space_leaves_the_other_in_force(spark, tmp_path):
    folder = str(tmp_path / "out")
    # Equal ids in two spaces, and an id listed twice, of which the last counts.
    both = [("s", "1", "Old", "", 1, "<p>old</p>"), ("s", "1", "Home", "", 2, "<p>last</p>"), ("s", "2", "Kid", "1", 1, "k"), ("t", "1", "Other", "", 1, "<p>o</p>")]
    one = E.run(spark, inputs(spark, both, atts=[("2", "a", "f.pdf", 1)], digests=[("a", 1, "d1")]), folder)
    assert sorted((r.space_id, r.page_id, r.action) for r in one.actions.collect()) == [("s", "1", "write"), ("s", "2", "write"), ("t", "1", "write")]
    assert sorted(files(spark, folder)) == ["One/Home/Home.md", "One/Home/Kid/Kid.md", "Two/Other/Other.md"] and files(spark, folder)["One/Home/Home.md"].endswith("# Home\n\nlast\n")
    assert "page_id: '1'" in files(spark, folder)["Two/Other/Other.md"]
    # Then s alone, without its attachment, and with an html copy beside each page.
    two = E.run(spark, inputs(spark, [("s", "1", "Home", "", 3, "<p>new</p>"), ("s", "2", "Kid", "1", 1, "k")], spaces=[("s", "K", "One")], failed_media=spark.createDataFrame([("s", "2")], "space_id string, page_id string")), folder, options=P.Options(include_html=True))
    assert {r.verdict for r in two.verdicts.collect()} == {"ok"} and [r.path for r in two.deletions.collect()] == ["One/Home/Kid/.media/f.pdf"]
    after = files(spark, folder)
    assert sorted(after) == ["One/Home/Home.html", "One/Home/Home.md", "One/Home/Kid/Kid.html", "One/Home/Kid/Kid.md", "Two/Other/Other.md"] and after["One/Home/Home.html"] == "<p>new</p>"
    assert S.load_state(spark, folder, "state_attachments").count() == 0
    # A page whose media failed is written again; an output that is gone as well; the others are skipped.
    there = spark.createDataFrame([("s", "One/Home/Kid/Kid.md")], "space_id string, file string")
    third = E.run(spark, inputs(spark, [("s", "1", "Home", "", 3, "<p>new</p>"), ("s", "2", "Kid", "1", 1, "k"), ("s", "3", "Late", "1", 1, "l")], spaces=[("s", "K", "One")], present=there), folder, options=P.Options(include_html=True))
    assert {(r.page_id, r.action) for r in third.actions.collect()} == {("1", "write"), ("2", "write"), ("3", "write")}
    again = E.run(spark, inputs(spark, [("t", "1", "Other", "", 1, "<p>o</p>")], spaces=[("t", "L", "Two")]), folder)
    assert [(r.space_id, r.action) for r in again.actions.collect()] == [("t", "skip")] and len(files(spark, folder)) == 7


def test_scopes_by_space(spark, tmp_path):
    folder = str(tmp_path / "out")
    pages = [("s", "1", "Home", "", 1, "h"), ("s", "2", "Docs", "1", 1, "d"), ("s", "3", "Deep", "2", 1, "x"), ("s", "4", "Rest", "1", 1, "r"), ("t", "9", "Top", "", 1, "t"), ("t", "8", "Sub", "9", 1, "s")]
    pages += [("s", "5", "Kept", "", 1, "a", "archived")]
    flags = spark.createDataFrame([("s", True, True), ("t", True, False)], "space_id string, complete boolean, include_archived boolean")
    folders = [("s", "f", "Drawer", "")]
    E.run(spark, inputs(spark, pages, folders=folders, flags=flags), folder)
    assert "One/_archived/Kept/Kept.md" in files(spark, folder)
    changed = [(s, i, t, p, 2, b, *status) for s, i, t, p, _, b, *status in pages if i != "3"]
    scopes = spark.createDataFrame([("s", "/home/DOCS/", False), ("t", "nowhere", False)], "space_id string, path string, no_children boolean")
    blobs = spark.createDataFrame([("unused",)], "digest string")
    given = inputs(spark, changed, scopes=scopes, blobs=blobs)
    out = E.run(spark, given, folder)
    # Of s only the subtree; t's path names nothing, so t keeps all it has, and nothing is cleared up.
    assert sorted((r.space_id, r.why) for r in out.verdicts.collect()) == [("s", ""), ("t", "unresolved_scope")]
    assert [(r.page_id, r.action) for r in out.actions.collect()] == [("2", "write")]
    assert [r.path for r in out.deletions.collect()] == ["One/Home/Docs/Deep/Deep.md"] and out.garbage.count() == 0
    assert sorted(files(spark, folder)) == ["One/Home/Docs/Docs.md", "One/Home/Home.md", "One/Home/Rest/Rest.md", "One/_archived/Kept/Kept.md", "Two/Top/Sub/Sub.md", "Two/Top/Top.md"]
    assert [r.folder_id for r in S.load_state(spark, folder, "state_folders").collect()] == ["f"] and out.folders.count() == 0
    with pytest.raises(LookupError):
        E.compare(spark, given, folder)
    only = inputs(spark, changed, scopes=spark.createDataFrame([("s", "home", True)], "space_id string, path string, no_children boolean"))
    assert sorted((r.space_id, r.page_id, r.change) for r in E.compare(spark, only, folder).collect()) == [("s", "1", "changed"), ("t", "8", "changed"), ("t", "9", "changed")]
    # Without scopes the folder that isn't listed any more goes, and unused bytes do.
    whole = E.run(spark, inputs(spark, changed, blobs=blobs, reused=spark.createDataFrame([("t", "OTHER")], "space_id string, snapshot_space_key string")), folder)
    assert [(r.folder_id, r.dir) for r in whole.folders.collect()] == [("f", "One/Drawer")] and {(r.space_id, r.verdict, r.why) for r in whole.verdicts.collect()} == {("s", "ok", ""), ("t", "error", "other_snapshot")}


def test_a_space_cannot_take_another_s_root(spark, tmp_path):
    folder = str(tmp_path / "out")
    E.run(spark, inputs(spark, [("t", "9", "Top", "", 1, "t")], spaces=[("t", "L", "Two")]), folder)
    # u has t's name; v and w share one; failed bodies are what they were before.
    spaces = [("u", "M", "Two"), ("v", "N", "Same"), ("w", "O", "Same")]
    pages = [("u", "7", "Mine", "", 1, "m"), ("v", "6", "First", "", 1, "lost"), ("w", "5", "Second", "", 1, "s")]
    bad = spark.createDataFrame([("v", "6")], "space_id string, page_id string")
    out = E.run(spark, inputs(spark, pages, spaces=spaces, failed_bodies=bad, previous_bodies=bad.withColumn("body", F.lit("<p>kept</p>"))), folder)
    assert sorted((r.space_id, r.verdict, r.why) for r in out.verdicts.collect()) == [("u", "error", "other_space"), ("v", "ok", ""), ("w", "error", "other_space")]
    assert sorted(files(spark, folder)) == ["Same/First/First.md", "Two/Top/Top.md"] and files(spark, folder)["Same/First/First.md"].endswith("# First\n\nkept\n")
