"""A whole run: listings and the state before it to documents, paths to delete, warnings and the state after it.

A run may be given any part of the spaces; it touches those only. Only pages whose fingerprint, place or output changed are
rendered. Guards are evaluated before anything is written; a space they stop keeps its documents and its state. Documents
are written beside those of earlier runs, the state is published last, so a run that fails leaves the one before it in
force, and of two runs over one space at once the second fails without having changed anything (state.PublishConflict).

Defined cases: of rows with one page id in a space the last listed counts, before anything else is done; equal page ids of
different spaces are different pages; attachments without a space belong to the page with their page's id.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.names import page_url, sanitize_filename
from leafmill.functions.render import jobs as J
from leafmill.lineage import settled, stored, stored_counted
from leafmill.operators import attachments as A
from leafmill.operators import bodies as B
from leafmill.operators import layout as L
from leafmill.plans import fingerprints as P
from leafmill.plans import reconcile as R
from leafmill.plans import state as S
from leafmill.tables import normalize

KEY = ["space_id", "page_id"]
PAGE_STATE = ["space_id", "page_id", "dir", "file", "html", "title", "version", "status", "fingerprint", "doc_run"]
#: Stands between a space's id and a page's while a run lasts, so that ids alone tell pages apart.
MARK = "\x1f"


@dataclass
class Inputs:
    """Canonical tables of this run's snapshot, for any number of spaces. What may be left out is None."""

    spaces: DataFrame  # space_id, space_key, name
    pages: DataFrame  # as in tables.SCHEMAS, body filled, version a number
    folders: DataFrame
    attachments: DataFrame  # space_id, page_id, att_id, title, media_type, version, created_at, ord; file_size, download_url
    users: DataFrame  # account_id, display_name
    digests: DataFrame  # att_id, version, digest of the bytes that are there
    derived: DataFrame  # render_version, xml_digest, png_digest
    flags: DataFrame | None = None  # space_id, complete, include_archived
    scopes: DataFrame | None = None  # space_id, path, no_children: the parts of a space that this run exports
    present: DataFrame | None = None  # space_id, file: outputs that are still there
    failed_media: DataFrame | None = None  # space_id, page_id: pages whose media couldn't be put in place
    failed_bodies: DataFrame | None = None  # space_id, page_id: pages whose body couldn't be fetched
    previous_bodies: DataFrame | None = None  # space_id, page_id, body: those of the snapshot before
    reused: DataFrame | None = None  # space_id, snapshot_space_key: spaces whose earlier snapshot is used again
    blobs: DataFrame | None = None  # digest of all bytes on store, for clearing up
    damage: DataFrame | None = None  # space_id, kind, source, lines: what of the listings couldn't be read
    fresh: DataFrame | None = None  # render_version, xml_digest, png_digest: this run's renderings


@dataclass
class Outcome:
    verdicts: DataFrame
    actions: DataFrame
    deletions: DataFrame  # space_id, path
    folders: DataFrame  # directories of folders that are gone, deepest first
    documents: DataFrame
    manifest: DataFrame  # media to put in place
    downloads: DataFrame  # attachments to fetch
    queue: DataFrame  # diagrams to render
    derived: DataFrame  # cached renderings, this run's among them
    garbage: DataFrame | None  # digests that nothing uses any more
    warnings: DataFrame
    summary: DataFrame
    version: int = field(default=0)
    totals: dict[str, int] = field(default_factory=dict)  # written, skipped, moved, counted while the actions were written


def _own(rows: DataFrame, *columns: str) -> DataFrame:
    """Ids with their space's before them."""
    return rows.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat("space_id", F.lit(MARK), c)) for c in columns})


def _plain(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.substring_index(c, MARK, -1) for c in columns})


def _roots(spaces: DataFrame, known: DataFrame, before: DataFrame) -> DataFrame:
    """spaces with the space that owns their root directory (state_space_id, state_space_key, state_rows), if there is one.

    That is the one the state has files of; of this run's new spaces with one root, the one with the smallest id.
    """
    rows = spaces.withColumn("root", sanitize_filename(F.col("name")))
    # A space that comes under another root gives its old one up.
    moved = known.join(rows.select("space_id", F.col("root").alias("_root")), "space_id", "left").where("_root is null or _root = root")
    held = moved.join(before.groupBy("space_id").agg(F.count("*").alias("state_rows")), "space_id").groupBy("root").agg(F.min(F.struct("space_id", "space_key", "state_rows")).alias("_held"))
    first = rows.groupBy("root").agg(F.min(F.struct("space_id", "space_key", F.lit(1).cast("long").alias("state_rows"))).alias("_first"))
    owner = F.coalesce("_held", "_first")
    rows = rows.join(first, "root").join(held, "root", "left")
    return rows.select("space_id", "space_key", "name", "root", owner["space_id"].alias("state_space_id"), owner["space_key"].alias("state_space_key"), owner["state_rows"].alias("state_rows"))


def canonical_pages(given: Inputs, include_archived: bool) -> DataFrame:
    """All listed pages of this run's spaces, each id once, with the bodies that failed ones had before, and export: whether they are to be exported."""
    spaces = given.spaces.select("space_id").distinct()
    rows = L.last_listed(given.pages.where("page_id <> ''").join(spaces, "space_id", "left_semi"), "page_id")
    if given.failed_bodies is not None:
        bad = given.failed_bodies.select(*KEY).distinct().withColumn("_bad", F.lit(True))
        rows = rows.join(bad, KEY, "left")
        if given.previous_bodies is not None:
            rows = rows.join(given.previous_bodies.groupBy(*KEY).agg(F.max("body").alias("_old")), KEY, "left")
        else:
            rows = rows.withColumn("_old", F.lit(""))
        rows = rows.withColumn("body", F.when(F.col("_bad"), F.coalesce("_old", F.lit(""))).otherwise(F.col("body"))).drop("_bad", "_old")
    rows = R.flagged(_own(rows, "page_id", "parent_id"), given.flags, include_archived=include_archived)
    return rows.withColumn("export", F.coalesce(F.expr("include_archived or status <> 'archived'"), F.lit(False))).drop("include_archived")


def plan(given: Inputs, include_archived: bool, *, bodies: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Ids of listed pages, pages to export (with their bodies, if asked for), the layout of all of them, the part of it in scope, the scopes with what they name, and nodes."""
    rows = canonical_pages(given, include_archived)
    # Made once: listings are wide, and each use of them would join and sort them again. Who needs no bodies reads none.
    rows = stored(rows if bodies else rows.drop("body"))
    listed, full = rows.select(*KEY), rows.where("export").drop("export")
    pages = full.drop("body")
    folders = _own(given.folders, "folder_id", "parent_id").join(given.spaces.select("space_id").distinct(), "space_id", "left_semi")
    placed, seen = stored_counted(L.layout(given.spaces, pages, folders), unsafe=F.count_if(L.unsafe()))
    if seen["unsafe"]:
        raise ValueError(f"{seen['unsafe']} planned paths lead out of the tree")
    scopes = planned = None
    if given.scopes is not None:
        scopes = stored(L.resolve_subtrees(placed, given.scopes))
        planned = L.restrict_scopes(placed, scopes)
    return listed, full, placed, placed if planned is None else planned, scopes, L.nodes(pages, folders)


def compare(spark: SparkSession, given: Inputs, folder: str, *, include_archived: bool = False) -> DataFrame:
    """What a run would add, change, move and delete; nothing is written. A scope that names nothing is an error."""
    _, pages, _, planned, scopes, _ = plan(given, include_archived)
    before = S.load_state(spark, folder, "state_pages").join(given.spaces.select("space_id").distinct(), "space_id", "left_semi")
    now = planned.where("kind = 'page'").select("space_id", F.col("node_id").alias("page_id"), "dir").join(pages.select(*KEY, "title", "version"), KEY)
    return R.diff(_plain(now, "page_id"), before, scopes=scopes)


def run(spark: SparkSession, given: Inputs, folder: str, *, options: P.Options = P.Options(), include_archived: bool = False, allow_mass_delete: bool = False, plug_ins: dict | None = None) -> Outcome:
    """Exports the spaces of given into folder (documents and state)."""
    base, this = S.current_version(spark, folder), S.new_run()
    spaces = stored(given.spaces.dropDuplicates(["space_id"]))
    mine = spaces.select("space_id")

    def held(name: str) -> DataFrame:
        return normalize(S.load_state(spark, folder, name, version=base), name)

    def own_held(name: str) -> DataFrame:
        rows = held(name).join(mine, "space_id", "left_semi")
        return _own(rows, "page_id") if "page_id" in rows.columns else rows

    before_all = held("state_pages")
    before, before_media, before_shown, before_folders = (stored(own_held(f"state_{n}")) for n in ("pages", "attachments", "rendered", "folders"))
    before_media = before_media.select(*KEY, "att_id", "version", "file", "blob", "size")
    listed, full, placed, planned, scopes, tree = plan(given, include_archived, bodies=True)
    pages = full.drop("body")
    wanted = planned.where("kind = 'page'").select("space_id", F.col("node_id").alias("page_id"), "dir", "file", F.concat("dir", F.lit("/"), "segment", F.lit(".html")).alias("html")).join(pages, KEY)
    if not options.include_html:
        wanted = wanted.withColumn("html", F.lit(""))

    atts = given.attachments
    atts = atts.withColumns({c: F.lit(v) for c, v in (("file_size", 0), ("download_url", "")) if c not in atts.columns})
    atts = A.drop_noise(atts).withColumnRenamed("space_id", "_space").withColumnRenamed("page_id", "_page")
    theirs = placed.where("kind = 'page'").select("space_id", F.col("node_id").alias("page_id"), F.substring_index("node_id", MARK, -1).alias("_page"))
    atts = atts.join(theirs, "_page").where("coalesce(_space, '') in ('', space_id)").drop("_page", "_space", "space_id")
    named = settled(lambda: A.plan_names(atts))
    digests = given.digests
    derived = given.derived if given.fresh is None else R.merge_derived(given.derived, given.fresh)
    stock = digests.select("digest").unionByName(derived.select(F.col("png_digest").alias("digest"))).distinct()
    pairs = A.drawio_pairs(A.first_seen(atts))
    shown = stored(A.rendered_media(pairs, named, digests, derived, stock))
    pictures = shown.where("png_digest is not null")
    links = stored(B.store_bodies(full)[1])
    prints = P.page_fingerprints(pages, named, links, pictures.select("page_id", "png_digest"), stored(B.author_resolution(full, given.users, lookup=options.author_lookup)), options)
    wanted = stored(wanted.join(prints, KEY))

    guarded = stored(_roots(spaces, held("state_spaces"), before_all))
    if given.reused is not None:
        guarded = guarded.join(given.reused.select("space_id", "snapshot_space_key"), "space_id", "left")
    if given.damage is not None:
        # What a damaged listing lacks isn't gone: nothing is pruned for it, and media are carried.
        told = R.damage_flags(mine, given.damage)
        if given.flags is not None and "complete" in given.flags.columns:
            told = told.join(given.flags.select("space_id", F.col("complete").alias("_told")), "space_id", "left").withColumn("complete", F.col("complete") & F.coalesce("_told", F.lit(True))).drop("_told")
        given = replace(given, flags=told if given.flags is None else told.join(given.flags.drop("complete", "pages_complete"), "space_id", "left"))
    flags = mine if given.flags is None else mine.join(given.flags, "space_id", "left")
    if scopes is not None:
        found = scopes.groupBy("space_id").agg(F.bool_and(F.col("node_id").isNotNull()).alias("resolved"), F.lit(False).alias("full"))
        flags = flags.join(found, "space_id", "left")
    verdicts = stored(R.guard_verdicts(guarded, wanted, before, include_archived=include_archived, allow_mass_delete=allow_mass_delete, flags=flags))
    present = given.present
    act = F.col("action")
    actions, totals = stored_counted(R.skip_or_write(R.gated(wanted, verdicts), before, present), written=F.count_if(act == "write"), skipped=F.count_if(act == "skip"), moved=F.count_if("moved"))
    writes = actions.where("action = 'write'")

    now = named.join(digests.select("att_id", "version", F.col("digest").alias("blob")).dropDuplicates(["att_id", "version"]), ["att_id", "version"], "left")
    now = now.join(wanted.select(*KEY), "page_id").select(*KEY, "att_id", "version", F.col("local_name").alias("file"), F.coalesce("blob", F.lit("")).alias("blob"), F.col("file_size").cast("long").alias("size"))
    sizes = now.select(*KEY, "att_id", "version", "size").unionByName(before_media.select(*KEY, "att_id", "version", "size")).groupBy(*KEY, "att_id", "version").agg(F.max("size").alias("size"))
    media = R.carry_media(before_media.join(wanted.select(*KEY), KEY, "left_semi"), now, media=options.media, moved=R.detect_moves(actions), flags=given.flags)
    media = stored(media.join(sizes, [*KEY, "att_id", "version"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long"))))

    todo = stored(full.join(writes.select(*KEY), KEY, "left_semi"))
    available = A.available_media(named, digests, shown, media=options.media, carried=media.where("carried").select("page_id", "file"))
    rendered = stored(J.render_markdown(J.wide(todo, named, available, B.resolve_users(B.mentions(todo), given.users), shown), plug_ins=plug_ins))
    files = named.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("att_id", F.col("local_name").alias("name"), F.col("media_type").alias("type"), F.col("file_size").alias("size")))).alias("attachments"))
    heads = writes.join(spaces.select("space_id", "space_key"), "space_id").join(files, "page_id", "left")
    some = F.coalesce("attachments", F.array().cast(files.schema["attachments"].dataType))
    heads = heads.select(*KEY, "file", "title", "space_key", F.col("dir").alias("path"), page_url(F.lit(options.site_url), F.col("web_url")).alias("url"), "last_modified", "version", "status", F.transform(some, lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["size"].alias("size"))).alias("attachments"))
    documents = J.documents(J.frontmatter(_plain(heads.join(rendered, KEY), "page_id")))
    if options.include_html:
        documents = documents.unionByName(todo.join(writes.select(*KEY, "html"), KEY).select("space_id", F.col("html").alias("rel_path"), F.col("body").alias("content")))
    S.write_documents(documents, folder, this)

    kept = stored(R.survivors(before, wanted, listed, include_archived=include_archived, flags=given.flags, scopes=scopes))
    stopped = before.join(verdicts.where("verdict <> 'ok'").select("space_id"), "space_id", "left_semi")
    kept_rows = R.gated(kept, verdicts).where("kept").select(*PAGE_STATE)
    skipped = before.join(actions.where("action = 'skip'").select(*KEY), KEY, "left_semi").select(*PAGE_STATE)
    written = writes.withColumn("doc_run", F.lit(this)).select(*PAGE_STATE)
    after = skipped.unionByName(written).unionByName(kept_rows).unionByName(stopped.select(*PAGE_STATE))
    if given.failed_media is not None:
        after = S.without_failed_media(after, _own(given.failed_media, "page_id"))
    after = stored(after)
    # Of pages that stay, the media and pictures that they had.
    stays = after.select(*KEY).join(actions.select(*KEY), KEY, "left_anti")
    after_media = stored(R.gated(media, verdicts).drop("carried").unionByName(before_media.join(stays, KEY, "left_semi").select(*KEY, "att_id", "version", "file", "blob", "size")))
    made = pictures.join(actions.select(*KEY), "page_id").groupBy(*KEY, F.col("local_name").alias("file")).agg(F.min("png_digest").alias("blob"))
    after_shown = stored((made if options.media else made.limit(0)).unionByName(before_shown.join(stays, KEY, "left_semi").select(*KEY, "file", "blob")))
    kinds = [*KEY, "file"]
    deletions = R.deletions(R.owned_paths(before, before_media.select(*kinds).unionByName(before_shown.select(*kinds))), R.owned_paths(after, after_media.select(*kinds).unionByName(after_shown.select(*kinds))))
    deletions = stored(R.gated(deletions, verdicts))

    dirs = planned.where("kind = 'folder'").select("space_id", F.substring_index("node_id", MARK, -1).alias("folder_id"), "dir")
    ok = R.gated(dirs, verdicts)
    # A folder out of scope, and all of a stopped space, is carried on.
    outside = before_folders if scopes is None else L.in_scopes(before_folders, scopes).where("not in_scope").drop("in_scope")
    outside = outside if scopes is not None else outside.limit(0)
    carried = R.gated(outside, verdicts).unionByName(before_folders.join(verdicts.where("verdict <> 'ok'").select("space_id"), "space_id", "left_semi"))
    after_folders = stored(ok.unionByName(carried.join(ok, ["space_id", "folder_id"], "left_anti").select("space_id", "folder_id", "dir")))
    gone = R.gated(R.stale_folders(before_folders, after_folders), verdicts).orderBy(F.desc("depth"), "dir")

    manifest = R.gated(A.media_manifest(named, placed, digests, shown).join(writes.select(*KEY), "page_id"), verdicts)
    fetch = A.incremental(atts, digests, stock).where("status = 'fetch'").join(wanted.select(*KEY), "page_id")
    downloads = A.download_plan(_plain(fetch, "page_id"), options.site_url or "https://localhost").join(_plain(wanted.select(*KEY), "page_id"), "page_id")
    warnings = stored(_plain(R.warnings_table(R.guard_warnings(verdicts), R.render_warnings(rendered), L.unreached(tree, placed.where("kind <> 'archive'")), R.download_warnings(downloads)), "key"))
    if given.damage is not None:
        warnings = warnings.unionByName(R.damage_warnings(given.damage))
    summary = R.export_summary(actions, R.gated(kept.where("not kept"), verdicts), warnings)

    # A space that was stopped as another's output isn't known from this run.
    names = guarded.join(verdicts.where("verdict = 'ok'").select("space_id"), "space_id", "left_semi").select("space_id", "space_key", "root")
    names = names.unionByName(own_held("state_spaces").join(verdicts.where("verdict <> 'ok'").select("space_id"), "space_id", "left_semi").select("space_id", "space_key", "root"))
    bodies = R.gated(links, verdicts).unionByName(own_held("body_blobs").join(stays, KEY, "left_semi").select(*KEY, "digest"))
    tables = {"state_pages": _plain(after, "page_id"), "state_attachments": _plain(after_media, "page_id"), "state_rendered": _plain(after_shown, "page_id"), "state_folders": after_folders, "state_spaces": names, "body_blobs": _plain(bodies, "page_id")}
    version = S.save_state(spark, tables, folder, spaces=mine, base=base, run=this)

    garbage = None
    if given.blobs is not None:
        # What any space's state names stays, also of spaces that this run didn't see.
        states = S.load_state(spark, folder, "state_attachments", version=version).select("blob").unionByName(S.load_state(spark, folder, "state_rendered", version=version).select("blob"))
        keep = R.keep_set(S.load_state(spark, folder, "body_blobs", version=version), digests, given.derived, (given.fresh if given.fresh is not None else given.derived.limit(0)), states, A.RENDER_VERSION)
        garbage = R.blob_gc(given.blobs, keep, verdicts)
    return Outcome(verdicts, _plain(actions, "page_id"), deletions, gone, S.documents_of(spark, folder, documents_named(documents, this)), _plain(manifest, "page_id"), downloads, A.render_queue(pairs, digests, derived, stock), derived, garbage, warnings, summary, version, totals)


def documents_named(documents: DataFrame, run_id: str) -> DataFrame:
    return documents.select("space_id", "rel_path", F.lit(run_id).alias("doc_run"))
