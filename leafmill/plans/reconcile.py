"""Previous and current state as set differences, behind guards that are evaluated before anything is written.

state: space_id, page_id, dir, file, title, version, status, fingerprint. plan: the same for pages of this run's layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.names import nfc_casefold
from leafmill.operators.attachments import packed, unpacked
from leafmill.operators.layout import in_scope, in_scopes

KEY = ["space_id", "page_id"]
#: Full runs that would prune more than this part of at least so many pages are refused.
MASS_PART, MASS_LEAST = 0.5, 10


def flagged(rows: DataFrame, flags: DataFrame | None, **defaults: bool) -> DataFrame:
    """rows with a column for each flag, as flags (space_id and some of them) says for their space, else the default."""
    known = [f for f in defaults if flags is not None and f in flags.columns]
    if known:
        rows = rows.join(flags.select("space_id", *[F.col(f).alias(f"_{f}") for f in known]), "space_id", "left")
    return rows.withColumns({f: F.coalesce(F.col(f"_{f}"), F.lit(d)) if f in known else F.lit(d) for f, d in defaults.items()}).drop(*[f"_{f}" for f in known])


def skip_or_write(plan: DataFrame, state: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Each planned page with action 'skip' (nothing about it changed, its output is there) or 'write', and whether it moved."""
    old = state.select(*KEY, F.col("dir").alias("old_dir"), F.col("file").alias("old_file"), F.col("fingerprint").alias("_fp"))
    rows = plan.join(old, KEY, "left")
    there = F.lit(True)
    if present is not None:
        rows = rows.join(present.select("space_id", F.col("file").alias("old_file"), F.lit(True).alias("_there")), ["space_id", "old_file"], "left")
        there = F.coalesce("_there", F.lit(False))
    same = F.coalesce((F.col("old_dir") == F.col("dir")) & (F.col("old_file") == F.col("file")) & (F.col("_fp") == F.col("fingerprint")) & (F.col("_fp") != ""), F.lit(False)) & there
    moved = F.coalesce(F.col("old_dir") != F.col("dir"), F.lit(False))
    return rows.withColumn("action", F.when(same, "skip").otherwise("write")).withColumn("moved", ~same & moved).drop("_fp", "_there", "old_file")


def detect_moves(actions: DataFrame) -> DataFrame:
    return actions.where("moved").select(*KEY, "old_dir", F.col("dir").alias("new_dir"))


def diff(plan: DataFrame, state: DataFrame, scope: str | None = None, *, scopes: DataFrame | None = None) -> DataFrame:
    """space_id, page_id, change (added, changed, moved, deleted), label, old_dir, new_dir; pages without a change are left out.

    With a scope (or scopes by space), the previous side is limited to it; a path that names nothing is an error.
    """
    old = state if scope is None else state.where(in_scope(F.col("dir"), F.lit(scope)))
    if scopes is not None:
        lost = scopes.where("node_id is null").select("space_id", "path").limit(5).collect()
        if lost:
            raise LookupError(f"no page or folder at {', '.join(f'{r.space_id}:{r.path}' for r in lost)}")
        old = in_scopes(state, scopes).where("in_scope").drop("in_scope")
    old = old.select(*KEY, F.col("dir").alias("old_dir"), F.col("title").alias("_title"), F.col("version").alias("_version"))
    rows = plan.select(*KEY, F.col("dir").alias("new_dir"), "title", "version").join(old, KEY, "full_outer")
    change = F.when(F.col("old_dir").isNull(), "added").when(F.col("new_dir").isNull(), "deleted").when(F.col("old_dir") != F.col("new_dir"), "moved").when(F.col("version") != F.col("_version"), "changed")
    label = F.coalesce(F.nullif("title", F.lit("")), F.nullif("_title", F.lit("")), F.col("page_id"))
    return rows.select(*KEY, change.alias("change"), label.alias("label"), "old_dir", "new_dir").where("change is not null")


def missing_from_plan(state: DataFrame, plan: DataFrame) -> DataFrame:
    return state.join(plan.select(*KEY), KEY, "left_anti")


def survivors(state: DataFrame, plan: DataFrame, listed: DataFrame, *, include_archived: bool, scope: str | None = None, no_children: bool = False, flags: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Previous pages that aren't planned, with kept: archived ones this run didn't fetch, live ones out of scope, others out of scope.

    flags: include_archived by space, where spaces differ, and pages_complete, without which nothing of a space is pruned;
    scopes: by space, as resolve_subtrees gives them.
    """
    rows = missing_from_plan(state, plan).join(listed.select(*KEY, F.lit(True).alias("_listed")), KEY, "left")
    rows = flagged(rows, flags, include_archived=include_archived, pages_complete=True)
    kept = F.coalesce("_listed", F.lit(False)) | (~F.col("include_archived") & (F.col("status") == "archived")) | ~F.col("pages_complete")
    if scope is not None:
        kept = kept | ~(F.col("dir") == scope if no_children else in_scope(F.col("dir"), F.lit(scope)))
    if scopes is not None:
        rows = in_scopes(rows, scopes)
        return rows.withColumn("kept", kept | ~F.col("in_scope")).drop("_listed", "include_archived", "pages_complete", "in_scope")
    return rows.withColumn("kept", kept).drop("_listed", "include_archived", "pages_complete")


def prune_set(*args, **kwargs) -> DataFrame:
    return survivors(*args, **kwargs).where("not kept").select(*KEY, "dir", "file")


def guard_verdicts(spaces: DataFrame, plan: DataFrame, state: DataFrame, *, include_archived: bool, full: bool = True, allow_mass_delete: bool = False, resolved: bool = True, flags: DataFrame | None = None) -> DataFrame:
    """One row per space: verdict ok, keep_all (delete nothing, state stays) or error (another space's output or snapshot), with why.

    spaces: space_id, space_key, those the state was written for (state_space_id, state_space_key; '' unknown) and, where an
    earlier snapshot is used again, that one's space (snapshot_space_key). flags: include_archived, full and resolved (its
    scope names something) by space. state_rows: how much the state has for the space it names, where that is another's.
    """
    plan_n = plan.groupBy("space_id").agg(F.count("*").alias("planned"))
    prev_n = state.groupBy("space_id").agg(F.count("*").alias("previous"))
    gone = flagged(missing_from_plan(state, plan), flags, include_archived=include_archived).where("include_archived or status <> 'archived'")
    gone_n = gone.groupBy("space_id").agg(F.count("*").alias("prunable"))
    rows = spaces.join(plan_n, "space_id", "left").join(prev_n, "space_id", "left").join(gone_n, "space_id", "left").fillna(0, ["planned", "previous", "prunable"])
    a, b, c, d = (F.trim(F.coalesce(x, F.lit(""))) for x in ("state_space_id", "space_id", "state_space_key", "space_key"))
    other = F.when((a != "") & (b != ""), a != b).when((c != "") & (d != ""), c != d).otherwise(False)
    reused = F.trim(F.coalesce("snapshot_space_key", F.lit(""))) if "snapshot_space_key" in spaces.columns else F.lit("")
    rows = flagged(rows, flags, full=full, resolved=resolved)
    owned = F.col("previous") > 0
    if "state_rows" in spaces.columns:
        owned = owned | (F.coalesce("state_rows", F.lit(0)) > 0)
    why = F.when((reused != "") & (reused != d), "other_snapshot").when(owned & other, "other_space")
    why = why.when(F.col("full") & (F.col("planned") == 0) & (F.col("previous") > 0), "empty_plan")
    if not allow_mass_delete:
        why = why.when(F.col("full") & (F.col("previous") >= MASS_LEAST) & (F.col("prunable") > F.col("previous") * MASS_PART), "mass_delete")
    why = why.when(~F.col("full") & ~F.col("resolved"), "unresolved_scope").otherwise("")
    verdict = F.when(why == "", "ok").when(why.isin("other_space", "other_snapshot"), "error").otherwise("keep_all")
    return rows.select("space_id", "planned", "previous", "prunable", verdict.alias("verdict"), why.alias("why"))


def gated(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Only rows of spaces whose verdict is ok."""
    return rows.join(verdicts.where("verdict = 'ok'").select("space_id"), "space_id", "left_semi")


def owned_paths(pages: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """space_id, path, key (the path without regard to case) of all files that a state owns."""
    rows = pages.select("space_id", F.col("file").alias("path"))
    if "html" in pages.columns:
        rows = rows.unionByName(pages.where("html <> ''").select("space_id", F.col("html").alias("path")))
    if media is not None:
        rows = rows.unionByName(media.join(pages.select(*KEY, "dir"), KEY).select("space_id", F.concat("dir", F.lit("/.media/"), "file").alias("path")))
    # Dealt by key, by which deletions compares them as well.
    return rows.where("path <> ''").withColumn("key", nfc_casefold("path")).repartition("space_id", "key").distinct()


def deletions(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Paths owned before and no longer, as owned_paths gives both."""
    return previous.join(new.select("space_id", "key"), ["space_id", "key"], "left_anti").select("space_id", "path")


def stale_folders(previous: DataFrame, new: DataFrame, scope: str | None = None) -> DataFrame:
    """Directories of folders that are gone, deepest first; out of scope they are carried on."""
    rows = previous.join(new.select("space_id", "folder_id"), ["space_id", "folder_id"], "left_anti")
    rows = rows if scope is None else rows.where(in_scope(F.col("dir"), F.lit(scope)))
    return rows.select("space_id", "folder_id", "dir", F.size(F.split("dir", "/")).cast("long").alias("depth")).orderBy(F.desc("depth"), "dir")


def carry_media(previous: DataFrame, current: DataFrame, *, media: bool = True, complete: bool = True, moved: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Attachment states of written pages for the new state: (space_id, page_id, att_id, version, file, blob, carried).

    Media off: the previous ones. What the listing lacks is carried if the listing is incomplete. On a page that moved
    (moved: space_id, page_id; None: all did), an attachment without bytes of its new version keeps its previous state, so
    that its last good bytes are put at the new place, unless its old name is another's by now. flags: media and complete
    by space, from `completeness` and the run's options.
    """
    # Whether there are bytes is told before rows meet, so a digest goes along only where it is asked for, and as bytes. Each
    # look-up is of the side that needs it, not of both together.
    has = F.coalesce("blob", F.lit("")) != ""
    now = current.select(*KEY, "att_id", "version", "file", packed("blob").alias("blob"), has.alias("_there"), F.lit(True).alias("_listed"))
    if moved is not None:
        now = now.join(moved.select(*KEY).distinct().withColumn("_moved", F.lit(True)), KEY, "left")
    # Names under which this run has put bytes on the page.
    put = current.where(has).select(*KEY, nfc_casefold("file").alias("_key")).distinct().withColumn("_put", F.lit(True))
    old = previous.select(*KEY, "att_id", F.col("version").alias("_version"), F.col("file").alias("_file"), packed("blob").alias("_blob"), has.alias("_had"), nfc_casefold("file").alias("_key"))
    old = old.join(put, [*KEY, "_key"], "left").drop("_key")
    rows = flagged(now.join(old, [*KEY, "att_id"], "full_outer"), flags, media=media, complete=complete)
    there, had, listed = F.coalesce("_there", F.lit(False)), F.coalesce("_had", F.lit(False)), F.col("_listed").isNotNull()
    rescued = listed & ~there & had & F.col("_put").isNull() & (F.coalesce("_moved", F.lit(False)) if moved is not None else F.lit(True))
    lacking = ~listed & F.col("_version").isNotNull()
    use_old = F.when(~F.col("media"), F.col("_version").isNotNull()).otherwise(rescued | (lacking & ~F.col("complete")))
    stays = F.when(~F.col("media"), F.col("_version").isNotNull()).otherwise(listed | ~F.col("complete"))
    rows = rows.withColumn("carried", use_old).where(stays).select(*KEY, "att_id", *[F.when(F.col("carried"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("version", "file", "blob")], "carried")
    return rows.withColumn("blob", unpacked("blob"))


def stale_media(previous: DataFrame, current: DataFrame, rendered: DataFrame, *, complete: bool = True, flags: DataFrame | None = None) -> DataFrame:
    """Previous media files of pages written in place that nothing names any more; none of spaces whose listing is incomplete."""
    now = current.select(*KEY, "file").unionByName(rendered.select(*KEY, "file")).withColumn("key", nfc_casefold("file"))
    old = flagged(previous.select(*KEY, "file"), flags, complete=complete).where("complete and file <> ''").withColumn("key", nfc_casefold("file"))
    return old.join(now, [*KEY, "key"], "left_anti").select(*KEY, "file")


def merge_derived(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached renderings with this run's put in their place."""
    return previous.join(fresh, ["render_version", "xml_digest"], "left_anti").unionByName(fresh)


def keep_set(bodies: DataFrame, attachments: DataFrame, derived: DataFrame, fresh: DataFrame, state_media: DataFrame, version: int) -> DataFrame:
    """Digests in use: bodies, attachments, renderings of the current version whose diagram lives, this run's renderings, the new state's media."""
    live = derived.where(F.col("render_version") == version).join(attachments.select(F.col("digest").alias("xml_digest")).distinct(), "xml_digest", "left_semi")
    parts = [bodies.select("digest"), attachments.select("digest"), live.select(F.col("png_digest").alias("digest")), fresh.select(F.col("png_digest").alias("digest")), state_media.where("blob <> ''").select(F.col("blob").alias("digest"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("digest <> ''").distinct()


def blob_gc(blobs: DataFrame, keep: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Digests to delete; an empty keep set beside existing blobs is refused.

    Spaces share their blobs, so while any space is guarded (verdicts) nothing is deleted.
    """
    if verdicts is not None and verdicts.where("verdict <> 'ok'").limit(1).count():
        return blobs.select("digest").limit(0)
    if keep.limit(1).count() == 0 and blobs.limit(1).count():
        raise ValueError("nothing is in use: refusing to delete every blob")
    return blobs.select("digest").join(keep, "digest", "left_anti")


def new_state(actions: DataFrame, state: DataFrame, kept: DataFrame) -> DataFrame:
    """Skipped pages as they were, written ones as planned, survivors carried."""
    columns = ["space_id", "page_id", "dir", "file", "title", "version", "status", "fingerprint"]
    skipped = state.join(actions.where("action = 'skip'").select(*KEY), KEY, "left_semi").select(*columns)
    written = actions.where("action = 'write'").select(*columns)
    return skipped.unionByName(written).unionByName(kept.where("kept").select(*columns))


def added_deleted(plan: DataFrame, state: DataFrame) -> DataFrame:
    """space_id, page_id, side ('added' or 'deleted')."""
    a, b = plan.select(*KEY), state.select(*KEY)
    return a.exceptAll(b).withColumn("side", F.lit("added")).unionByName(b.exceptAll(a).withColumn("side", F.lit("deleted")))


def export_summary(actions: DataFrame, pruned: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row per space: written, skipped, moved, pruned, warnings."""
    rows = actions.groupBy("space_id").agg(F.count_if(F.col("action") == "write").alias("written"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if("moved").alias("moved"))
    gone = pruned.groupBy("space_id").agg(F.count("*").alias("pruned"))
    out = rows.join(gone, "space_id", "full_outer")
    if warnings is not None:
        out = out.join(warnings.groupBy("space_id").agg(F.count("*").alias("warnings")), "space_id", "full_outer")
    else:
        out = out.withColumn("warnings", F.lit(0).cast(T.LongType()))
    return out.fillna(0, ["written", "skipped", "moved", "pruned", "warnings"])


def warnings_table(*parts: DataFrame) -> DataFrame:
    """What went wrong in a run, from all its stages: space_id, stage, kind, key, message."""
    columns = ("space_id", "stage", "kind", "key", "message")
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def damage_flags(spaces: DataFrame, damaged: DataFrame) -> DataFrame:
    """complete and pages_complete by space, from the damage of its listings (as read_landing gives it; a null space means all)."""
    tree = F.col("kind").startswith("pages") | F.col("kind").startswith("folders")
    by = damaged.groupBy("space_id").agg(F.bool_or(tree).alias("_tree"))
    # One row at most.
    every = by.where("space_id is null").select("_tree").first()
    rows = spaces.select("space_id").distinct().join(by.where("space_id is not null"), "space_id", "left")
    return rows.select("space_id", (F.col("_tree").isNull() & F.lit(every is None)).alias("complete"), (~F.coalesce("_tree", F.lit(False)) & F.lit(not (every and every[0]))).alias("pages_complete"))


def damage_warnings(damaged: DataFrame) -> DataFrame:
    return damaged.select(F.coalesce("space_id", F.lit("")).alias("space_id"), F.lit("listing").alias("stage"), F.lit("damaged lines").alias("kind"), F.col("source").alias("key"), F.concat_ws(" ", "lines", F.lit("lines of"), "kind").alias("message"))


def guard_warnings(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict <> 'ok'").select("space_id", F.lit("guard").alias("stage"), F.col("why").alias("kind"), F.col("space_id").alias("key"), F.concat_ws(" ", F.lit("planned"), "planned", F.lit("of"), "previous", F.lit("would prune"), "prunable").alias("message"))


def render_warnings(rendered: DataFrame) -> DataFrame:
    """The warnings of rendered pages, a row each; the kind stands before the colon."""
    rows = rendered.select("space_id", "page_id", F.explode("warnings").alias("w"))
    return rows.select("space_id", F.lit("render").alias("stage"), F.substring_index("w", ": ", 1).alias("kind"), F.col("page_id").alias("key"), F.regexp_replace("w", "^[^:]*: ", "").alias("message"))


def download_warnings(downloads: DataFrame) -> DataFrame:
    """Attachments that can't be fetched, as their address isn't the site's: space_id and what download_plan gives."""
    return downloads.where("url = ''").select("space_id", F.lit("download").alias("stage"), F.lit("no address").alias("kind"), F.col("att_id").alias("key"), F.concat(F.lit("attachment of page "), "page_id").alias("message"))
