"""Cases from fixtures: naming, layout, attachments, two snapshots, listings, rendering, state."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill import tables
from leafmill.functions import names as N
from leafmill.functions.render import jobs as J
from leafmill.functions.render import page as P
from leafmill.operators import attachments as A
from leafmill.operators import bodies as B
from leafmill.operators import layout as L
from leafmill.plans import export as E
from leafmill.plans import fingerprints as FP
from leafmill.plans import reconcile as R
from leafmill.plans import state as S
from leafmill.sources import listings
from leafmill.streaming import increment

PAGE = "space_id string, page_id string, title string, parent_id string, parent_type string, position int, status string, ord bigint"
FOLDER = "space_id string, folder_id string, title string, parent_id string, parent_type string, position int, ord bigint"


def pages(spark, *rows):
    return spark.createDataFrame([("s", i, t, p, "page" if p else "", pos, status, k) for k, (i, t, p, pos, status) in enumerate(rows)], PAGE)


def folders(spark, *rows):
    return spark.createDataFrame([("s", i, t, p, "", pos, k) for k, (i, t, p, pos) in enumerate(rows)], FOLDER)


def spaces(spark, name="My Space"):
    return spark.createDataFrame([("s", "K", name, "")], "space_id string, space_key string, name string, homepage_id string")


def dirs(spark, p, f=None, name="My Space"):
    return {r.node_id: r.dir for r in L.layout(spaces(spark, name), p, f if f is not None else folders(spark)).collect()}


def column(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(f(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, N.sanitize_filename, ["Hello, World!", "a - b  c", "!!!", "Grüße ²", "x" * 99 + " yz", "--a--", "é"]) == ["Hello-World", "a-b-c", "untitled", "Grüße-²", "x" * 99, "a", "e"]
    assert column(spark, N.nfc_casefold, ["Straße", "Å", None]) == ["strasse", "å", None]
    assert column(spark, N.safe_attachment_name, ["../x", "a (1).png", ".hidden", "", "a/b.png", "-x", "a\x07b"]) == ["_-x", "a (1).png", "_hidden", "attachment", "a-b.png", "x", "ab"]
    assert column(spark, N.media_url, ["a b*~é.png"]) == [".media/a%20b%2A~%C3%A9.png"]
    assert column(spark, N.safe_external_url, ["javascript:x", " https://a.b/c d(e) ", "/rel?q=1", "mailto:a@b", "", None]) == ["", "https://a.b/c%20d%28e%29", "/rel?q=1", "mailto:a@b", "", ""]
    assert [P.safe_url(u) for u in ("javascript:x", " https://a.b/c d(e) ", "/rel?q=1")] == ["", "https://a.b/c%20d%28e%29", "/rel?q=1"]
    assert column(spark, N.heading_text, ["a\n b <c> [d]`#\\"]) == ["a b &lt;c&gt; \\[d\\]\\`\\#\\\\"]
    assert column(spark, lambda c: N.page_url(F.lit("https://x/"), c), ["/spaces/a", "p", "/wiki/q", "http://z", ""]) == ["https://x/wiki/spaces/a", "https://x/wiki/p", "https://x/wiki/q", "http://z", ""]
    assert column(spark, N.parse_mtime, ["2024-01-01T00:00:00Z", "", "junk", "2024-01-01T01:00:00+01:00"]) == [1704067200.0, None, None, 1704067200.0]
    assert column(spark, lambda c: N.truncate_with_suffix(c, F.lit("-12")), ["a" * 120, "b"]) == ["a" * 97 + "-12", "b-12"]
    assert N.with_token("d.tar.gz", "id1") == "d-id1.tar.gz" and N.with_token("d.png", "x" * 40, 2) == "d-" + "x" * 14 + "-2.png"


def test_layout(spark):
    live = lambda i, t, p="", pos=0: (i, t, p, pos, "current")
    assert dirs(spark, pages(spark)) == {}
    assert dirs(spark, pages(spark, live("1", "x")), name="") == {"1": "untitled/x"}
    assert dirs(spark, pages(spark, live("1", "Hello", pos=1), live("2", "hello", pos=2))) == {"1": "My-Space/Hello", "2": "My-Space/hello-2"}
    assert dirs(spark, pages(spark, live("1", "A"), live("2", "A-2", pos=1), live("3", "A", pos=2))) == {"1": "My-Space/A", "2": "My-Space/A-2", "3": "My-Space/A-3"}
    assert dirs(spark, pages(spark, live("1", "A-2"), live("2", "A", pos=1), live("3", "a", pos=2))) == {"1": "My-Space/A-2", "2": "My-Space/A", "3": "My-Space/a-3"}
    long = dirs(spark, pages(spark, *[live(str(k), "y" * 130, pos=k) for k in range(3)]))
    assert sorted(map(len, long.values())) == [109, 109, 109] and len(set(long.values())) == 3
    assert dirs(spark, pages(spark, ("1", "old", "", 0, "archived"), ("2", "kid", "1", 0, "archived"), live("3", "up", "1"), live("4", "_archived"), live("5", "lost", "nope"))) == {"_archived": "My-Space/_archived", "1": "My-Space/_archived/old", "2": "My-Space/_archived/old/kid", "3": "My-Space/up", "4": "My-Space/_archived-2", "5": "My-Space/lost"}
    assert dirs(spark, pages(spark, live("1", "in", "f2"), live("2", "p")), folders(spark, ("f1", "F", "", 0), ("f2", "G", "f1", 0), ("f3", "H", "2", 0), ("2", "clash", "", 0))) == {"f1": "My-Space/F", "f2": "My-Space/F/G", "1": "My-Space/F/G/in", "2": "My-Space/p", "f3": "My-Space/p/H"}


def test_layout_cycle_scope_and_order(spark):
    p = pages(spark, ("1", "a", "2", 0, "current"), ("2", "b", "1", 0, "current"), ("3", "c", "", 1, "current"), ("4", "d", "3", 0, "current"), ("5", "e", "", 0, "current"))
    tree = L.nodes(p, folders(spark))
    placed = L.layout(spaces(spark), p, folders(spark))
    assert sorted(r.key for r in L.unreached(tree, placed).collect()) == ["1", "2"]
    assert [r.node_id for r in L.preorder(placed).orderBy("ord").collect()] == ["5", "3", "4"]
    assert L.resolve_subtree(placed, "s", "/C/d") == "4" and L.resolve_subtree(placed, "s", "c/x") is None and L.resolve_subtree(placed, "s", "") is None
    assert sorted(r.node_id for r in L.restrict(placed, "s", "3").collect()) == ["3", "4"]
    assert [r.node_id for r in L.restrict(placed, "s", "3", no_children=True).collect()] == ["3"]
    assert L.restrict(placed, "s", None).count() == 0 and L.unsafe_paths(placed).count() == 0
    assert [r.place for r in L.find_pages(placed, p, "D").collect()] == ["My-Space/c/d"]


def test_deep_tree_and_order_of_input(spark):
    rows = [(str(k), f"t{k % 3}", str(k - 1) if k else "", 0, "current") for k in range(12)]
    want = dirs(spark, pages(spark, *rows))
    assert want["11"].count("/") == 12
    random.Random(1).shuffle(rows)
    assert dirs(spark, pages(spark, *rows).repartition(3)) == want


ATT = "page_id string, att_id string, title string, media_type string, version int, created_at string, file_size bigint, download_url string, ord bigint"


def atts(spark, *rows):
    return spark.createDataFrame([(p, i, t, m, 1, at, 100, "", k) for k, (p, i, t, m, at) in enumerate(rows)], ATT)


def test_attachment_names(spark):
    a = atts(spark, ("p", "2", "a-b.png", "x", "2025"), ("p", "1", "a/b.png", "x", "2024"), ("p", "3", "c", "x", ""), ("p", "3", "d", "x", ""), ("p", "4", "A-B.png", "x", "2026"), ("q", "1", "a-b.png", "x", ""))
    got = {(r.page_id, r.att_id): r.local_name for r in A.plan_names(a).collect()}
    assert got == {("p", "1"): "a-b.png", ("p", "2"): "a-b-2.png", ("p", "3"): "c", ("p", "4"): "A-B-4.png", ("q", "1"): "a-b.png"}
    refs = spark.createDataFrame([("p", "2", "zzz"), ("p", "", "a/b.png"), ("p", "", "C"), ("p", "", "un/known")], "page_id string, att_id string, title string")
    assert sorted(r.local_name for r in A.resolve_refs(refs, A.plan_names(a)).collect()) == ["a-b-2.png", "a-b.png", "c", "un-known"]
    assert sorted(r.title for r in A.drop_noise(atts(spark, ("p", "1", " ~$x", "", ""), ("p", "2", "~y.tmp", "", ""), ("p", "3", "~z", "", ""))).collect()) == ["~z"]


def test_diagrams(spark):
    a = atts(spark, ("p", "1", "d.drawio", "x", "2024-01-02T00:00:00Z"), ("p", "2", "D.drawio.png", "image/png", "2024-01-02T00:00:00Z"), ("p", "3", "e", "application/vnd.drawio", "2024-01-02T00:00:00Z"), ("p", "4", "e.png", "image/png", "2024-01-01T00:00:00Z"), ("p", "5", "F  g.drawio", "x", ""))
    got = {r.xml_id: (r.png_id, r.preview_fresh) for r in A.drawio_pairs(a).collect()}
    assert got == {"1": ("2", True), "3": ("4", False), "5": (None, False)}
    refs = spark.createDataFrame([("p", "d"), ("p", "f g"), ("p", "none")], "page_id string, name string")
    assert {r.name: r.att_id for r in A.match_diagram(refs, a).collect()} == {"d": "1", "f g": "5", "none": None}
    shape = '<mxCell style="fontSize={f}"/><mxGeometry x="0" y="0" width="{w}" height="{h}"/>'
    cases = [(shape.format(f=f, w=w, h=h), s) for f, w, h, s in ((12, 400, 300, 1), (7, 400, 300, 2), (3, 400, 300, 3), (4, 5000, 1000, 2), (4, 20000, 1000, 1), (1, 10, 10, 1))] + [("garbage", 1), ("", 1)]
    assert column(spark, A.render_scale, [c for c, _ in cases]) == [s for _, s in cases]
    import base64
    import urllib.parse
    import zlib

    z = zlib.compressobj(wbits=-15)
    packed = base64.b64encode(z.compress(urllib.parse.quote("fontSize=7").encode()) + z.flush()).decode()
    assert A.decode_diagram(f"<mxfile><diagram>{packed}</diagram><diagram>!!</diagram></mxfile>".encode()).endswith("\nfontSize=7")


def test_downloads(spark):
    a = spark.createDataFrame([("p", "a", 1, 10, ""), ("", "b", 1, 0, "/download/x"), ("", "c", 1, 0, "https://evil.example.org/x"), ("", "d", 1, 2**30, "https://wiki.example.com/x"), ("", "e", 1, 0, "")], "page_id string, att_id string, version int, file_size bigint, download_url string")
    got = {r.att_id: (r.url, r.cap) for r in A.download_plan(a, "https://wiki.example.com").collect()}
    assert got == {"a": ("https://wiki.example.com/wiki/rest/api/content/p/child/attachment/a/download", 256 * 2**20), "b": ("https://wiki.example.com/wiki/download/x", 8 * 2**30), "c": ("", 8 * 2**30), "d": ("https://wiki.example.com/x", 2**31), "e": ("", 8 * 2**30)}


STATE = "space_id string, page_id string, dir string, file string, title string, version int, status string, fingerprint string"


def state(spark, *rows):
    return spark.createDataFrame([("s", i, d, f"{d}/{d}.md", t, v, st, fp) for i, d, t, v, st, fp in rows], STATE)


def test_two_snapshots(spark):
    prev = state(spark, ("1", "a", "A", 1, "current", "x"), ("2", "b", "B", 1, "current", "y"), ("3", "c", "C", 1, "archived", "z"), ("4", "d", "D", 1, "current", "w"), ("5", "e", "E", 1, "current", ""))
    plan = state(spark, ("1", "a", "A", 1, "current", "x"), ("2", "bb", "B", 1, "current", "y"), ("4", "d", "D", 2, "current", "v"), ("5", "e", "E", 1, "current", ""), ("6", "f", "F", 1, "current", "u"))
    got = {r.page_id: (r.action, r.moved) for r in R.skip_or_write(plan, prev).collect()}
    assert got == {"1": ("skip", False), "2": ("write", True), "4": ("write", False), "5": ("write", False), "6": ("write", False)}
    present = prev.where("page_id <> '1'").select("space_id", "file")
    assert {r.action for r in R.skip_or_write(plan, prev, present).where("page_id = '1'").collect()} == {"write"}
    assert {r.page_id: r.change for r in R.diff(plan, prev).collect()} == {"2": "moved", "3": "deleted", "4": "changed", "6": "added"}
    assert {r.page_id: r.change for r in R.diff(plan, prev, "bb").collect()} == {"1": "added", "2": "added", "4": "added", "5": "added", "6": "added"}
    assert R.prune_set(prev, plan, plan, include_archived=False).count() == 0
    assert [r.page_id for r in R.prune_set(prev, plan, plan, include_archived=True).collect()] == ["3"]
    assert R.prune_set(prev, plan, plan, include_archived=True, scope="zz").count() == 0
    assert sorted(r.path for r in R.deletions(R.owned_paths(prev), R.owned_paths(plan)).collect()) == ["b/b.md", "c/c.md"]
    again = R.skip_or_write(prev.where("fingerprint <> ''"), prev)
    assert {r.action for r in again.collect()} == {"skip"}


def test_guards(spark):
    old = state(spark, *[(str(k), f"d{k}", "t", 1, "current", "x") for k in range(10)])
    s = spark.createDataFrame([("s", "K", "s", "")], "space_id string, space_key string, state_space_id string, state_space_key string")
    verdict = lambda plan, sp=s, **more: tuple(R.guard_verdicts(sp, plan, old, include_archived=False, **more).select("verdict", "why").first())
    assert verdict(old.limit(0)) == ("keep_all", "empty_plan")
    assert verdict(old.where("page_id < '4'")) == ("keep_all", "mass_delete")
    assert verdict(old.where("page_id < '5'")) == ("ok", "")
    assert verdict(old.where("page_id < '4'"), allow_mass_delete=True) == ("ok", "")
    assert verdict(old.limit(0), full=False) == ("ok", "") and verdict(old, full=False, resolved=False) == ("keep_all", "unresolved_scope")
    assert verdict(old, s.withColumn("state_space_id", F.lit("other"))) == ("error", "other_space")
    assert verdict(old, s.withColumn("state_space_id", F.lit(" ")).withColumn("state_space_key", F.lit("L"))) == ("error", "other_space")
    assert R.gated(old, R.guard_verdicts(s, old.limit(0), old, include_archived=False)).count() == 0
    with pytest.raises(ValueError):
        R.blob_gc(spark.createDataFrame([("a",)], "digest string"), spark.createDataFrame([], "digest string"))


def test_fingerprints(spark):
    p = spark.createDataFrame([("s", "1", 1, 'x account-id="u1"', "u2")], "space_id string, page_id string, version int, body string, author string")
    users = spark.createDataFrame([("u1", "Ann")], "account_id string, display_name string")
    named = A.plan_names(atts(spark, ("1", "a", "f.png", "x", "")))
    links = spark.createDataFrame([("s", "1", "d")], "space_id string, page_id string, digest string")
    pngs = spark.createDataFrame([], "page_id string, png_digest string")
    of = lambda options=FP.Options(), u=users, n=named, g=pngs, b=links: FP.page_fingerprints(p, n, b, g, B.author_resolution(p, u, lookup=options.author_lookup), options).first().fingerprint
    base = of()
    assert base == of()
    others = [of(FP.Options(site_url="x")), of(FP.Options(media=False)), of(FP.Options(author_lookup=False)), of(u=users.withColumn("display_name", F.lit("Bo"))), of(n=named.withColumn("version", F.lit(2))), of(g=spark.createDataFrame([("1", "png")], "page_id string, png_digest string")), of(b=links.withColumn("digest", F.lit("e")))]
    assert len({base, *others}) == 8
    assert [tuple(a) for a in B.author_resolution(p, users).first().authors] == [("u1", "Ann"), ("u2", "")]


def test_media_is_carried(spark):
    kind = "space_id string, page_id string, att_id string, version int, file string, blob string"
    old = spark.createDataFrame([("s", "1", "a", 1, "a.png", "x"), ("s", "1", "b", 1, "b.png", "y"), ("s", "1", "c", 1, "c.png", "z")], kind)
    now = spark.createDataFrame([("s", "1", "a", 2, "a2.png", "w"), ("s", "1", "b", 2, "b2.png", "")], kind)
    rows = lambda **k: sorted((r.att_id, r.version, r.file, r.carried) for r in R.carry_media(old, now, **k).collect())
    assert rows(media=True, complete=True) == [("a", 2, "a2.png", False), ("b", 1, "b.png", True)]
    assert rows(media=True, complete=False) == [("a", 2, "a2.png", False), ("b", 1, "b.png", True), ("c", 1, "c.png", True)]
    assert len(rows(media=False, complete=True)) == 3
    assert sorted(r.file for r in R.stale_media(old, now, now.limit(0)).collect()) == ["a.png", "b.png", "c.png"]
    assert R.stale_media(old, now, now.limit(0), complete=False).count() == 0


def test_listings(spark, tmp_path):
    v2 = {"results": [{"id": 7, "title": "T", "spaceId": "s", "parentId": None, "version": None, "_links": {"webui": "/x"}}, {"id": "8", "version": {"number": 3, "createdAt": "2024", "author": {"accountId": "u"}}}], "_links": {}}
    (tmp_path / "p.json").write_text(json.dumps(v2) + "\n" + json.dumps({"results": None, "_links": None}) + "\n{}\n")
    rows = listings.pages_from_v2(listings.read_listing(spark, str(tmp_path / "p.json"), "pages_v2")).orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.space_id, r.parent_id, r.position, r.status, r.version.number, r.version.author_id, r.web_url) for r in rows] == [("7", "T", "s", "", 0, "current", 0, "", "/x"), ("8", "", "", "", 0, "current", 3, "u", "")]
    v1 = {"results": [{"id": 1, "title": "T", "status": "archived", "space": {"id": 5}, "ancestors": [{"id": 2}, {"id": 3}], "extensions": {"position": "none"}, "version": {"number": 1, "when": "2023", "by": {"username": "u"}}}, {"id": 4, "ancestors": []}]}
    (tmp_path / "q.json").write_text(json.dumps(v1))
    a, b = listings.pages_from_v1(listings.read_listing(spark, str(tmp_path / "q.json"), "pages_v1")).orderBy("page_id").collect()
    assert (a.page_id, a.space_id, a.parent_id, a.parent_type, a.position, a.status, a.version.created_at, a.version.author_id) == ("1", "5", "3", "page", 0, "archived", "2023", "u")
    assert (b.parent_id, b.parent_type, b.version.number) == ("", "", 0)
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": 1, "title": "f", "mediaType": "", "metadata": {"mediaType": "m"}, "extensions": {"mediaType": "e", "fileSize": 9}, "_links": {"download": "/d"}}]}))
    att = listings.attachments_from_v1(listings.read_listing(spark, str(tmp_path / "a.json"), "attachments_v1"), page_id=F.lit("p")).first()
    assert (att.att_id, att.page_id, att.media_type, att.file_size, att.download_url) == ("1", "p", "m", 9, "/d")
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"id": 1, "key": "K", "homepage": {"id": 2}}]}))
    found = listings.spaces_from_v1(listings.read_listing(spark, str(tmp_path / "s.json"), "spaces_v1"))
    assert tuple(listings.space_by_key(found, "K").first()) == ("1", "K", "", "", "2")
    with pytest.raises(LookupError):
        listings.space_by_key(found, "none")
    assert tables.normalize(spark.createDataFrame([("p", None)], "page_id string, position string"), "pages").first().asDict()["position"] == 0


def test_files(spark, tmp_path):
    for k, content in enumerate((b"a", b"a", b"bb")):
        (tmp_path / f"{k}.bin").write_bytes(content)
    links, blobs = listings.read_attachment_files(spark, str(tmp_path))
    assert links.count() == 3 and sorted((r.size, bytes(r.content)) for r in blobs.collect()) == [(1, b"a"), (2, b"bb")]


MACRO = '<ac:structured-macro ac:name="{}">{}</ac:structured-macro>'
TITLE = '<ac:parameter ac:name="title">{}</ac:parameter>'
RENDER = [
    ("<ac:task-list><ac:task><ac:task-status>complete</ac:task-status><ac:task-body>B</ac:task-body></ac:task></ac:task-list>", "* [x] B"),
    ("<ac:task-list><ac:task><ac:task-status>incomplete</ac:task-status><ac:task-body>A<ac:task-list><ac:task><ac:task-body>B<ac:task-list><ac:task><ac:task-body>C</ac:task-body></ac:task></ac:task-list></ac:task-body></ac:task></ac:task-list></ac:task-body></ac:task></ac:task-list>", "* [ ] A\n  * [ ] B\n    * [ ] C"),
    ('<ac:adf-node type="decisionList"><ac:adf-node type="decisionItem" state="DECIDED"><p>B</p></ac:adf-node></ac:adf-node>', "* ✓ B"),
    ('<ac:adf-node type="decisionList"></ac:adf-node>x', "x"),
    (MACRO.format("code", '<ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a < b && c]]></ac:plain-text-body>'), "```py\na < b && c\n```"),
    (MACRO.format("info", TITLE.format("T") + "<ac:rich-text-body><p>x</p>" + MACRO.format("status", TITLE.format("S")) + "</ac:rich-text-body>"), "> **T**\n>\n> x\n>\n> **S**"),
    (MACRO.format("panel", '<ac:parameter ac:name="title">T<ac:rich-text-body><p>body</p></ac:rich-text-body>'), "> **T**\n>\n> body"),
    (MACRO.format("warning", "<ac:rich-text-body><p>x</p></ac:rich-text-body>"), "> **Warning**\n>\n> x"),
    (MACRO.format("expand", "<ac:rich-text-body><p>x</p></ac:rich-text-body>"), "#### Details\n\nx"),
    (MACRO.format("status", ""), ""),
    (MACRO.format("jira", '<ac:parameter ac:name="key">A-1</ac:parameter>'), "`A-1`"),
    (MACRO.format("toc", ""), "*[Confluence dynamic content: toc]*"),
    (MACRO.format("who", '<ac:parameter ac:name="k">v</ac:parameter><ac:parameter ac:name="p"><ri:page ri:content-title="T"/></ac:parameter>'), "*[Confluence dynamic content: who (k=v, p=T)]*"),
    (MACRO.format("who", "<ac:rich-text-body><p>kept</p></ac:rich-text-body>"), "kept"),
    (MACRO.format("wrap", '<ac:parameter ac:name="k">v</ac:parameter>' + MACRO.format("jira", '<ac:parameter ac:name="key">A-1</ac:parameter>')), "`A-1`"),
    (MACRO.format("anchor", ""), ""),
    (MACRO.format("excerpt", "<ac:rich-text-body><p>x</p></ac:rich-text-body>"), "x"),
    (MACRO.format("view-file", '<ri:attachment ri:filename="F.pdf"/>'), "[F.pdf](.media/F.pdf)"),
    (MACRO.format("viewpdf", '<ac:parameter ac:name="name">no.pdf</ac:parameter>'), "Missing attachment: no.pdf"),
    (MACRO.format("drawio", '<ac:parameter ac:name="diagramName">d</ac:parameter>'), "![d](.media/d.png)  \n*Draw.io source: [d.drawio](.media/d.drawio)*"),
    (MACRO.format("drawio", '<ac:parameter ac:name="diagramName">e</ac:parameter>'), "*[Draw.io diagram not rendered: e.drawio]*"),
    (MACRO.format("drawio-sketch", ""), "*[Draw.io sketch]*"),
    (MACRO.format("profile", '<ri:user ri:account-id="u1"/>'), "* Ann"),
    (MACRO.format("profile", '<ri:user ri:account-id="u2"/>'), "* user:u2"),
    (MACRO.format("profile-picture", '<ri:user ri:account-id="u1"/>'), "@Ann"),
    (MACRO.format("attachments", ""), "* [F.pdf](.media/F.pdf)\n* [d.drawio](.media/d.drawio)\n* Missing attachment: gone.png"),
    (MACRO.format("widget", '<ac:parameter ac:name="url">https://x.y/z</ac:parameter>'), "[https://x.y/z](https://x.y/z)"),
    (MACRO.format("multimedia", ""), "*[Confluence dynamic content: multimedia]*"),
    ("<p><ri:user ri:account-id='u1'/> and <ri:user ri:account-id='u2'/></p>", "@Ann and @u2"),
    ('<ac:link><ri:attachment ri:filename="F.pdf"/><ac:plain-text-link-body><![CDATA[see]]></ac:plain-text-link-body></ac:link>', "[see](.media/F.pdf)"),
    ('<ac:link><ri:page ri:content-title="T"/></ac:link>', "T"),
    ('<ac:link><ri:url ri:value="javascript:x"/></ac:link>', ""),
    ('<ac:image><ri:attachment ri:filename="gone.png"/></ac:image>', "Missing attachment: gone.png"),
    ('<ac:image><ri:url ri:value="http://x/y.png"/></ac:image>', "![](http://x/y.png)"),
    ('<p><ac:emoticon ac:name="tick"/><ac:emoticon ac:name="n" ac:emoji-shortname=":check_mark:"/><ac:emoticon ac:emoji-fallback="Z"/><ac:emoticon ac:emoji-fallback=":z:"/></p>', "✅✅Z"),
    ('<p><time datetime="2024-01-01"></time></p><ac:placeholder>no</ac:placeholder><ac:layout><ac:layout-section><ac:layout-cell><p>in</p></ac:layout-cell></ac:layout-section></ac:layout>', "2024-01-01\n\nin"),
    ("<script>no</script><style>no</style><h2>H</h2><ol><li>a</li><li>b</li></ol><hr/><blockquote><p>q</p></blockquote><pre>x\ny</pre>", "## H\n\n1. a\n2. b\n\n---\n\n> q\n\n```\nx\ny\n```"),
]


@pytest.mark.parametrize(("html", "markdown"), RENDER)
def test_render(html, markdown):
    page = P.Page({("F.pdf", ""): "F.pdf", ("gone.png", ""): "gone.png"}, [("F.pdf", "F.pdf"), ("d.drawio", "d.drawio"), ("gone.png", "gone.png")], frozenset(["F.pdf", "d.drawio"]), {"u1": "Ann"}, {"d": ("d.png", "d.drawio")})
    assert P.render("Doc", html, page) == f"# Doc\n\n{markdown}".strip()


def test_render_heading_and_plug_in(spark):
    assert P.render("Docs", "<h1>Docs 2</h1>", P.Page()) == "# Docs 2"
    page = spark.createDataFrame([("s", "1", "T", MACRO.format("mine", "")), ("s", "2", "T", None)], "space_id string, page_id string, title string, body string")
    got = {r.page_id: r.markdown for r in J.render_markdown(J.wide(page), plug_ins={"mine": lambda macro, ctx: ["own"]}).collect()}
    assert got == {"1": "# T\n\nown", "2": "# T"}
    assert not any(t in P.render("x", h, P.Page()) for h, _ in RENDER for t in ("<ac:", "<ri:"))


def test_render_is_linear_in_nesting():
    for html in ("<p><b>x" * 3000, "<div>x" * 10_000, "<ul><li>a" * 3000, "<blockquote>a" * 3000, "<table><tr><td>x" * 500, MACRO.format("info", "")[:-22] * 1000, "<i>" * 10_000 + "</b>" * 10_000):
        assert P.render("T", html, P.Page()).startswith("# T")
    assert P.render("T", "<p>a<p>b<ul><li>c<ul><li>d</ul><li>e</ul><table><tr><th>f<td>g|<tr><td>h</table>", P.Page()) == "# T\n\na\n\nb\n\n* c\n  * d\n* e\n\n| f | g\\| |\n| --- | --- |\n| h |  |"


def test_render_joins_what_a_page_needs(spark):
    body = MACRO.format("drawio", '<ac:parameter ac:name="diagramName">my  plan</ac:parameter>') + MACRO.format("drawio", '<ac:parameter ac:name="diagramName">none</ac:parameter>') + MACRO.format("viewpdf", '<ac:parameter ac:name="name">F.PDF</ac:parameter>') + '<ac:image><ri:attachment ri:filename="old name.png" ri:id="7"/></ac:image>'
    page = spark.createDataFrame([("s", "1", "T", body)], "space_id string, page_id string, title string, body string")
    named = A.plan_names(atts(spark, ("1", "5", "My plan.drawio", "x", "2024"), ("1", "6", "f.pdf", "x", "2024"), ("1", "7", "new name.png", "x", "2024")))
    have = named.groupBy("page_id").agg(F.collect_set("local_name").alias("names"))
    shown = spark.createDataFrame([("1", "My plan.drawio", "My plan.png")], "page_id string, xml_title string, local_name string")
    row = J.render_markdown(J.wide(page, named, have, rendered=shown)).first()
    assert row.markdown == "# T\n\n![my  plan](.media/My%20plan.png)  \n*Draw.io source: [my  plan.drawio](.media/My%20plan.drawio)*\n\n*[Draw.io diagram not rendered: none.drawio]*\n\n[F.PDF](.media/f.pdf)![old name.png](.media/new%20name.png)"


def test_a_failing_plug_in_costs_its_page_only(spark):
    page = spark.createDataFrame([("s", "1", "T", MACRO.format("mine", "")), ("s", "2", "T", "x")], "space_id string, page_id string, title string, body string")
    got = {r.page_id: (r.markdown, r.warnings) for r in J.render_markdown(J.wide(page), plug_ins={"mine": lambda macro, page: 1 / 0}).collect()}
    assert got == {"1": ("", ["not rendered: ZeroDivisionError: division by zero"]), "2": ("# T\n\nx", [])}
    # Nothing of it stays with the workers.
    assert {r.markdown for r in J.render_markdown(J.wide(page)).where("page_id = '1'").collect()} == {"# T\n\n*[Confluence dynamic content: mine]*"}


def test_document(spark):
    row = [("s", "a/b.md", "T: é", "1", "K", "a", "", "2024", 3, "archived", [("f", "x", 9)], "# T")]
    df = spark.createDataFrame(row, "space_id string, file string, title string, page_id string, space_key string, path string, url string, last_modified string, version int, status string, attachments array<struct<name:string,type:string,size:bigint>>, markdown string")
    out = J.documents(J.frontmatter(df)).first()
    assert out.rel_path == "a/b.md" and out.content == "---\ntitle: 'T: é'\npage_id: '1'\nspace_key: K\npath: a\nurl: ''\nlast_modified: '2024'\nversion: 3\nstatus: archived\nattachments:\n- name: f\n  type: x\n  size: 9\n---\n\n# T\n"


def test_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert S.current_version(spark, folder) == 0 and S.load_state(spark, folder, "state_pages").count() == 0
    one = tables.normalize(state(spark, ("1", "a", "A", 1, "current", "x")), "state_pages")
    assert S.save_state(spark, {"state_pages": one}, folder) == 1
    two = S.without_failed_media(S.load_state(spark, folder, "state_pages"), one.select("space_id", "page_id"))
    assert S.save_state(spark, {"state_pages": two}, folder) == 2
    assert S.load_state(spark, folder, "state_pages").first().fingerprint == ""
    snap = str(tmp_path / "snap")
    S.save_snapshot({"state_pages": one.unionByName(one.withColumn("space_id", F.lit("t")))}, snap)
    S.save_snapshot({"state_pages": one.withColumn("title", F.lit("new"))}, snap)
    assert sorted((r.space_id, r.title) for r in S.load(spark, snap, "state_pages").collect()) == [("s", "new"), ("t", "A")]
    assert S.load(spark, snap, "users").columns == ["account_id", "display_name"]


def inputs(spark, pages_, atts_=(), digests=(), users=(("u1", "Ann"),), flags=None):
    """Canonical tables of two spaces from (space, id, title, parent, version, body)."""
    rows = [(s, i, t, p, "page" if p else "", 0, "current", b, v, "", "2024", "u1", k) for k, (s, i, t, p, v, b) in enumerate(pages_)]
    return E.Inputs(
        spaces=spark.createDataFrame([("s", "K", "One"), ("t", "L", "Two")], "space_id string, space_key string, name string"),
        pages=spark.createDataFrame(rows, "space_id string, page_id string, title string, parent_id string, parent_type string, position int, status string, body string, version int, web_url string, last_modified string, author string, ord bigint"),
        folders=spark.createDataFrame([], FOLDER),
        attachments=spark.createDataFrame([("s", p, i, t, "x", v, "2024", 1, k) for k, (p, i, t, v) in enumerate(atts_)], "space_id string, page_id string, att_id string, title string, media_type string, version int, created_at string, file_size bigint, ord bigint"),
        users=spark.createDataFrame(list(users), "account_id string, display_name string"),
        digests=spark.createDataFrame(list(digests), "att_id string, version int, digest string"),
        derived=spark.createDataFrame([], "render_version int, xml_digest string, png_digest string"),
        flags=flags,
    )


def test_export_twice(spark, tmp_path):
    folder = str(tmp_path / "out")
    link = '<ac:link><ri:attachment ri:filename="f.pdf"/></ac:link>'
    first = [("s", "1", "Home", "", 1, "<p>hello</p>"), ("s", "2", "Kid", "1", 1, f"<p>see {link}</p>"), ("s", "3", "Gone", "1", 1, "x"), ("t", "9", "Other", "", 1, '<p><ri:user ri:account-id="u1"/></p>')]
    atts_, digests = [("2", "a", "f.pdf", 1)], [("a", 1, "d1")]
    files = lambda: {r.rel_path: r.content for r in S.load_documents(spark, folder).collect()}
    one = E.run(spark, inputs(spark, first, atts_, digests), folder)
    assert {r.verdict for r in one.verdicts.collect()} == {"ok"} and one.version == 1
    before = files()
    assert sorted(before) == ["One/Home/Gone/Gone.md", "One/Home/Home.md", "One/Home/Kid/Kid.md", "Two/Other/Other.md"]
    assert before["One/Home/Kid/Kid.md"].endswith("# Kid\n\nsee [f.pdf](.media/f.pdf)\n") and before["Two/Other/Other.md"].endswith("# Other\n\n@Ann\n")
    assert [(r.path, r.digest) for r in one.manifest.collect()] == [("One/Home/Kid/.media/f.pdf", "d1")] and one.deletions.count() == 0
    # The same again: nothing is rendered, written or deleted, and the state stays.
    again = E.run(spark, inputs(spark, first, atts_, digests), folder)
    assert {r.action for r in again.actions.collect()} == {"skip"} and again.documents.count() == again.deletions.count() == again.manifest.count() == 0
    assert files() == before
    # A page changes, one moves with its attachment's new bytes missing, one goes; the other space lists nothing and keeps what it has.
    second = [("s", "1", "Home", "", 2, "<p>new</p>"), ("s", "2", "Child", "1", 1, f"<p>see {link}</p>")]
    two = E.run(spark, inputs(spark, second, [("2", "a", "f.pdf", 2)], digests), folder)
    assert {(r.space_id, r.why) for r in two.verdicts.collect()} == {("s", ""), ("t", "empty_plan")}
    assert {(r.page_id, r.action, r.moved) for r in two.actions.collect()} == {("1", "write", False), ("2", "write", True)}
    assert sorted(r.path for r in two.deletions.collect()) == ["One/Home/Gone/Gone.md", "One/Home/Kid/.media/f.pdf", "One/Home/Kid/Kid.md"]
    after = files()
    assert sorted(after) == ["One/Home/Child/Child.md", "One/Home/Home.md", "Two/Other/Other.md"] and after["One/Home/Home.md"].endswith("# Home\n\nnew\n")
    assert after["One/Home/Child/Child.md"].endswith("see [f.pdf](.media/f.pdf)\n") and after["Two/Other/Other.md"] == before["Two/Other/Other.md"]
    assert [(r.version, r.file, r.blob) for r in S.load_state(spark, folder, "state_attachments").collect()] == [(1, "f.pdf", "d1")]
    assert {(r.space_id, r.written, r.skipped, r.moved, r.pruned) for r in two.summary.collect() if r.space_id == "s"} == {("s", 2, 0, 1, 1)}
    assert [(r.stage, r.kind) for r in two.warnings.where("stage = 'guard'").collect()] == [("guard", "empty_plan")]


def test_flags_by_space(spark):
    kind = "space_id string, page_id string, att_id string, version int, file string, blob string"
    old = spark.createDataFrame([("s", "1", "a", 1, "a", "x"), ("t", "2", "b", 1, "b", "y")], kind)
    flags = spark.createDataFrame([("s", False, True), ("t", True, False)], "space_id string, complete boolean, include_archived boolean")
    assert [(r.att_id, r.carried) for r in R.carry_media(old, old.limit(0), flags=flags).collect()] == [("a", True)]
    assert [r.file for r in R.stale_media(old, old.limit(0), old.limit(0), flags=flags).collect()] == ["b"]
    state_ = state(spark, ("1", "a", "A", 1, "archived", "x")).unionByName(state(spark, ("1", "a", "A", 1, "archived", "x")).withColumn("space_id", F.lit("t")))
    assert {r.space_id: r.kept for r in R.survivors(state_, state_.limit(0), state_.limit(0), include_archived=False, flags=flags).collect()} == {"s": False, "t": True}
    # Another attachment has taken the old name by now.
    now = spark.createDataFrame([("s", "1", "a", 2, "c", ""), ("s", "1", "z", 1, "A", "w")], kind)
    assert sorted((r.att_id, r.version, r.carried) for r in R.carry_media(old.where("space_id = 's'"), now).collect()) == [("a", 2, False), ("z", 1, False)]
    assert sorted((r.att_id, r.version, r.carried) for r in R.carry_media(old.where("space_id = 's'"), now.where("att_id = 'a'"), moved=old.limit(0)).collect()) == [("a", 2, False)]
    verdicts = spark.createDataFrame([("s", "keep_all")], "space_id string, verdict string")
    assert R.blob_gc(spark.createDataFrame([("a",)], "digest string"), spark.createDataFrame([("b",)], "digest string"), verdicts).count() == 0


def test_increment(spark, tmp_path):
    folder, source = str(tmp_path / "state"), tmp_path / "in"
    source.mkdir()
    schema = "space_id string, page_id string, title string, version int, dir string"
    edits = spark.readStream.schema(schema).json(str(source))
    for k, rows in enumerate(([("1", "a", 1), ("1", "b", 3), ("2", "c", 1)], [("1", "late", 2), ("2", "d", 2)])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"space_id": "s", "page_id": i, "title": t, "version": v}) for i, t, v in rows))
        increment.follow(edits, folder, str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.page_id, r.title, r.version) for r in S.load_state(spark, folder, "state_pages").collect()) == [("1", "b", 3), ("2", "d", 2)]
