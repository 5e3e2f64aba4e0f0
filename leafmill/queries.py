"""All queries of the export, by inventory name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.adapters import Tree, current, previous
from leafmill.functions import names as N
from leafmill.functions.render import jobs as J
from leafmill.lineage import settled
from leafmill.operators import attachments as A
from leafmill.operators import bodies as B
from leafmill.operators import layout as L
from leafmill.oracles import ATT, DIGESTS, LAYOUT, NAMED, PAIRS, SNAPSHOTS, TREE, q
from leafmill.plans import fingerprints as P
from leafmill.plans import reconcile as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[Tree], DataFrame]) -> Callable[[Tree], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tree(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def placed(t: Tree) -> DataFrame:
    return L.layout(t.spaces(), t.pages(), t.folders())


def ids(column: str) -> str:
    return f"array_to_string({column}, '/') {column}"


@query(q(LAYOUT, "select space_id, node_id, kind, dir, coalesce(file, '') file from placed"))
def w3_assemble_paths(t: Tree) -> DataFrame:
    return placed(t).select("space_id", "node_id", "kind", "dir", F.coalesce("file", F.lit("")).alias("file"))


@query(q(LAYOUT, "select space_id, dir as path, repeat('  ', greatest(len(string_split(dir, '/')) - 2, 0)::int) || string_split(dir, '/')[-1] || case when kind = 'folder' then '/' else '' end line, greatest(len(string_split(dir, '/')) - 2, 0)::bigint depth from placed where kind in ('page', 'folder')"))
def f6_page_tree(t: Tree) -> DataFrame:
    return L.page_tree(placed(t))


@query(q(LAYOUT, "select space_id, node_id, kind, parent_id, synthetic from parents"))
def j1_resolve_parents(t: Tree) -> DataFrame:
    return L.resolve_parents(L.nodes(t.pages(), t.folders())).select("space_id", "node_id", "kind", "parent_id", "synthetic")


@query(q(LAYOUT, "select space_id, node_id, kind, title, archived from nodes"))
def u1_nodes(t: Tree) -> DataFrame:
    return L.nodes(t.pages(), t.folders()).select("space_id", "node_id", "kind", "title", "archived")


@query(q(LAYOUT, "select space_id, node_id, rank::bigint rank from ranked"))
def w1_sibling_rank(t: Tree) -> DataFrame:
    return L.sibling_rank(L.resolve_parents(L.nodes(t.pages(), t.folders()))).select("space_id", "node_id", F.col("rank").cast("long").alias("rank"))


@query(q(LAYOUT, "select space_id, node_id, segment from segmented"))
def w2_allocate_segments(t: Tree) -> DataFrame:
    return L.allocate_segments(L.sibling_rank(L.resolve_parents(L.nodes(t.pages(), t.folders())))).select("space_id", "node_id", "segment")


@query(q(LAYOUT, "select space_id, node_id, row_number() over (partition by space_id order by ranks) ord from placed where kind = 'page'"))
def w4_preorder(t: Tree) -> DataFrame:
    return L.preorder(placed(t)).select("space_id", "node_id", "ord")


@query(q(TREE, ", f as (select distinct p.space_id, p.parent_id folder_id from pages p join folders g on g.space_id = p.space_id and g.node_id = p.parent_id where p.parent_type = 'folder') select space_id, folder_id from f"))
def j2_folder_closure(t: Tree) -> DataFrame:
    return L.folder_closure(t.pages(), t.folders())


@query(q(TREE, "select space_id, page_id, status from pages where status <> 'archived'"))
def f1_current_only(t: Tree) -> DataFrame:
    return L.current_only(t.pages()).select("space_id", "page_id", "status")


@query(q(LAYOUT, "select p.space_id, p.page_id, coalesce(l.dir, p.title) place from pages p left join placed l on l.space_id = p.space_id and l.node_id = p.page_id and l.kind = 'page' where status <> 'archived' and contains(lower(p.title), 'urgent')"))
def f4_find_pages(t: Tree) -> DataFrame:
    return L.find_pages(placed(t), t.pages(), "URGENT")


@query(q(LAYOUT, "select space_id, node_id, kind, dir from placed where space_id = 'r2' and list_contains(path_ids, (select node_id from placed where space_id = 'r2' and parent_id = '' and lower(title) = 'nation_2'))"))
def f8_restrict_layout(t: Tree) -> DataFrame:
    plan = placed(t)
    return L.restrict(plan, "r2", L.resolve_subtree(plan, "r2", "/nation_2/")).select("space_id", "node_id", "kind", "dir")


@query(q(LAYOUT, "select space_id, node_id from placed where space_id = 'r2' and lower(title) = 'building' and parent_id = (select node_id from placed where space_id = 'r2' and parent_id = '' and lower(title) = 'nation_7') order by rank limit 1"))
def f7_resolve_subtree(t: Tree) -> DataFrame:
    plan = placed(t)
    node = L.resolve_subtree(plan, "r2", "NATION_7/building")
    return plan.where((F.col("space_id") == "r2") & (F.col("node_id") == node)).select("space_id", "node_id")


@query(q(LAYOUT, "select space_id, node_id, dir from placed where dir = 'ASIA/NATION_2' or dir like 'ASIA/NATION_2/%'"))
def f9_dir_in_scope(t: Tree) -> DataFrame:
    return placed(t).where(L.in_scope(F.col("dir"), F.lit("ASIA/NATION_2"))).select("space_id", "node_id", "dir")


@query(q(LAYOUT, "select count(*) as paths, count(*) filter (coalesce(file, dir) like '/%' or list_contains(string_split(coalesce(file, dir), '/'), '..')) as unsafe from placed"))
def f10_safe_paths(t: Tree) -> DataFrame:
    plan = placed(t)
    return plan.agg(F.count("*").alias("paths")).crossJoin(L.unsafe_paths(plan).agg(F.count("*").alias("unsafe")))  # one row each


@query(q(LAYOUT, "select space_id, count(*) pages from placed where kind = 'page' group by 1"))
def a9_counts(t: Tree) -> DataFrame:
    return placed(t).where("kind = 'page'").groupBy("space_id").agg(F.count("*").alias("pages"))


# Attachments of orders. A digest stands for the bytes: those of files of some sizes are missing.


def listed(t: Tree) -> DataFrame:
    # What is kept of a listing's order is its ids; among rows without repeats they are an order as well.
    return t.once("listed", lambda: t.described(A.first_seen(t.lines(), "listing")).withColumn("listing", F.struct("listing.l_orderkey", "listing.l_linenumber")))


def named(t: Tree) -> DataFrame:
    return t.once("named", lambda: A.plan_names(listed(t), "listing", seen=True).select("page_id", "att_id", "title", "media_type", "version", "created_at", "folded", "local_name"))


def digests(t: Tree) -> DataFrame:
    rows = listed(t).where(F.col("file_size") % 5 != 0)
    return rows.select("att_id", "version", F.sha2(F.concat_ws("@", "att_id", F.col("version").cast("string")), 256).alias("digest"))


def derived(t: Tree) -> DataFrame:
    """Some bytes have a cached rendering, of the current version or the one before."""
    code = lambda at: F.ascii(F.substring("digest", at, 1))
    return digests(t).where(code(1) % 3 == 0).select((F.when(code(2) % 2 == 0, 2).otherwise(1)).alias("render_version"), F.col("digest").alias("xml_digest"), F.sha2(F.concat(F.lit("png"), "digest"), 256).alias("png_digest"))


def stocked(t: Tree) -> DataFrame:
    """blobs, of which some may be named twice: for those who only ask whether bytes are there."""
    return digests(t).select("digest").unionByName(derived(t).select(F.col("png_digest").alias("digest")))


def blobs(t: Tree) -> DataFrame:
    return stocked(t).distinct()


@query(q(ATT, "select page_id, att_id, title, version from listed"))
def w6_first_seen(t: Tree) -> DataFrame:
    return listed(t).select("page_id", "att_id", "title", "version")


@query(q(ATT, "select page_id, att_id, title from atts where not (starts_with(trim(title), '~$') or (starts_with(trim(title), '~') and ends_with(trim(title), '.tmp')))"))
def f2_drop_noise(t: Tree) -> DataFrame:
    return A.drop_noise(t.attachments()).select("page_id", "att_id", "title")


@query(q(ATT + NAMED, "select page_id, att_id, title, local_name from named"))
def w5_plan_attachment_names(t: Tree) -> DataFrame:
    return named(t).select("page_id", "att_id", "title", "local_name")


@query(q(ATT + NAMED, "select page_id, att_id, count(*) over (partition by page_id, lower(title)) = 1 fold_unique from named"))
def a10_unambiguous_fold(t: Tree) -> DataFrame:
    return A.unambiguous_fold(named(t)).select("page_id", "att_id", "fold_unique")


@query(
    q(
        ATT + NAMED,
        """select distinct r.page_id, r.att_id, r.title, coalesce(i.local_name, e.local_name, f.local_name, r.title) local_name
        from (select page_id, case when ascii(md5(att_id)) % 2 = 0 then att_id else '' end att_id, case when ascii(substr(md5(att_id), 2)) % 3 = 0 then upper(title) else title end title from atts) r
        left join named i on i.page_id = r.page_id and i.att_id = r.att_id
        left join (select page_id, title, arg_min(local_name, (created_at, att_id, local_name)) local_name from named group by 1, 2) e on e.page_id = r.page_id and e.title = r.title
        left join (select page_id, lower(title) t, min(local_name) local_name from named group by 1, 2 having count(*) = 1) f on f.page_id = r.page_id and f.t = lower(r.title)""",
    )
)
def j5_resolve_attachment_refs(t: Tree) -> DataFrame:
    # Half of the references give the id, a third the title in other letters.
    code = lambda at: F.ascii(F.substring(F.md5("att_id"), at, 1))
    refs = t.attachments().select("page_id", F.when(code(1) % 2 == 0, F.col("att_id")).otherwise("").alias("att_id"), F.when(code(2) % 3 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"))
    return A.resolve_refs(refs.distinct(), named(t)).select("page_id", "att_id", "title", "local_name")


@query(q(ATT + DIGESTS, "select l.page_id, l.att_id, coalesce(d.digest, '') digest, case when d.digest is null then 'fetch' else 'reuse' end status from listed l left join digests d on d.att_id = l.att_id and d.version = l.version"))
def j3_incremental_attachments(t: Tree) -> DataFrame:
    rows = A.incremental(listed(t), digests(t), stocked(t))
    return rows.select("page_id", "att_id", F.coalesce("digest", F.lit("")).alias("digest"), "status")


@query(q(ATT + PAIRS, "select page_id, xml_id, coalesce(png_id, '') png_id, preview_fresh from pairs"))
def j7_drawio_pairs(t: Tree) -> DataFrame:
    return A.drawio_pairs(listed(t), "listing").select("page_id", "xml_id", F.coalesce("png_id", F.lit("")).alias("png_id"), "preview_fresh")


@query(q(ATT + PAIRS + DIGESTS, "select distinct d.digest xml_digest from pairs p join digests d on d.att_id = p.xml_id and d.version = p.xml_version where not preview_fresh and d.digest not in (select xml_digest from derived where render_version = 2)"))
def j9_render_queue(t: Tree) -> DataFrame:
    return A.render_queue(A.drawio_pairs(listed(t), "listing"), digests(t), derived(t), stocked(t))


def rendered(t: Tree) -> DataFrame:
    return A.rendered_media(A.drawio_pairs(listed(t), "listing"), named(t), digests(t), derived(t), stocked(t))


RENDERED = r""",
rendered as (
  select * from (
    select p.page_id, p.xml_title,
      case when preview_fresh then case when pd.digest is not null then n.local_name end
           when c.png_digest is not null then
             case when exists (select 1 from named o where o.page_id = p.page_id and o.local_name = regexp_replace(xml_title, '\.[^.]*$', '') || '.png' and o.att_id <> coalesce(p.png_id, ''))
               then regexp_replace(xml_title, '\.[^.]*$', '') || '-rendered.png' else regexp_replace(xml_title, '\.[^.]*$', '') || '.png' end end local_name,
      case when not preview_fresh then coalesce(c.png_digest, '') else '' end png_digest
    from pairs p left join digests pd on pd.att_id = p.png_id and pd.version = p.png_version
    left join digests xd on xd.att_id = p.xml_id and xd.version = p.xml_version
    left join derived c on c.xml_digest = xd.digest and c.render_version = 2
    left join named n on n.page_id = p.page_id and n.att_id = p.png_id
  ) where local_name is not null
)
"""


@query(q(ATT + NAMED + PAIRS + DIGESTS + RENDERED, "select * from rendered"))
def j10_rendered_media(t: Tree) -> DataFrame:
    return rendered(t).withColumn("png_digest", F.coalesce("png_digest", F.lit("")))


@query(q(ATT + NAMED + PAIRS + DIGESTS + RENDERED, "select page_id, array_to_string(list_sort(list_distinct(list(local_name))), '|') as \"names\" from (select n.page_id, local_name from named n join digests d on d.att_id = n.att_id and d.version = n.version union all select page_id, local_name from rendered) group by 1"))
def j21_available_media(t: Tree) -> DataFrame:
    return A.available_media(named(t), digests(t), rendered(t)).select("page_id", F.array_join("names", "|").alias("names"))


@query(
    q(
        LAYOUT + ", " + ATT + NAMED + PAIRS + DIGESTS + RENDERED,
        """select f.page_id, dir || '/.media/' || local_name as path, digest, mtime from (
        select n.page_id, local_name, digest, epoch(created_at::timestamp)::double mtime from named n join digests d on d.att_id = n.att_id and d.version = n.version
        union all select page_id, local_name, min(png_digest), null from rendered where png_digest <> '' group by 1, 2) f join placed l on l.node_id = f.page_id and l.kind = 'page'""",
    )
)
def s14_media_manifest(t: Tree) -> DataFrame:
    return A.media_manifest(named(t), placed(t), digests(t), rendered(t))


@query(q(ATT, "select page_id, att_id, version, 'https://wiki.example.com/wiki/rest/api/content/' || page_id || '/child/attachment/' || att_id || '/download' url, case when file_size > 0 then greatest(file_size * 2, 268435456) else 8589934592 end::bigint cap from listed"))
def s15_download_plan(t: Tree) -> DataFrame:
    return A.download_plan(listed(t).withColumn("download_url", F.lit("")), "https://wiki.example.com")


@query("select doc_id, greatest(1, least(greatest(1, least(3, round_even(14.0 / (2 + doc_id % 16), 0)::int)), floor(12000.0 / greatest(n_chars + doc_id % 5, 1))::int))::int scale from documents")
def a7_render_scale(t: Tree) -> DataFrame:
    model = F.concat(F.lit('<mxGraphModel><mxCell style="fontSize='), (2 + F.col("doc_id") % 16).cast("string"), F.lit(';"/><mxGeometry x="'), (F.col("doc_id") % 5).cast("string"), F.lit('" y="0" width="'), F.col("n_chars").cast("string"), F.lit('" height="1"/><mxGeometry x="0" y="0" width="1" height="1"/></mxGraphModel>'))
    return t.read("documents").select("doc_id", A.render_scale(model).alias("scale"))


# Bodies: documents as pages of their source.


def documents(t: Tree) -> DataFrame:
    d = t.read("documents")
    return d.select(F.col("source").alias("space_id"), F.col("doc_id").cast("string").alias("page_id"), F.coalesce("text", F.lit("")).alias("body"))


@query("select source space_id, doc_id::varchar page_id, sha256(text) digest from documents where text <> ''")
def s9_store_bodies(t: Tree) -> DataFrame:
    return B.store_bodies(documents(t))[1]


@query("select sha256(text) digest, min(strlen(text))::bigint size from documents where text <> '' group by 1")
def a4_dedup_blobs(t: Tree) -> DataFrame:
    return B.store_bodies(documents(t))[2].select("digest", "size")


@query("select source space_id, doc_id::varchar page_id from documents where coalesce(text, '') = ''")
def f3_needs_body(t: Tree) -> DataFrame:
    return B.needs_body(documents(t)).select("space_id", "page_id")


@query(f"select source space_id, doc_id::varchar page_id, case when length(text) % 2 = 0 and text <> '' and ascii(sha256(text)) % 3 <> 0 then sha256(text) else '{B.EMPTY}' end digest from documents")
def j4_carry_failed_bodies(t: Tree) -> DataFrame:
    """No body could be had. Before, those of an even length were there; some of their bytes are gone."""
    pages = documents(t)
    _, links, _ = B.store_bodies(pages)
    _, before, _ = B.store_bodies(pages.where(F.char_length("body") % 2 == 0))
    return B.carry_failed_bodies(pages, before, links.where(F.ascii("digest") % 3 != 0).select("digest").distinct())


@query(q(TREE, "select distinct author from pages where author <> ''"))
def a2_author_ids(t: Tree) -> DataFrame:
    return B.author_ids(t.pages(), t.pages().select(F.lit("").alias("author")).limit(0))


@query(q(TREE, "select space_id, page_id, unnest(regexp_extract_all(body, 'account-id=\"([^\"]+)\"', 1)) account_id from bodies"))
def r3_extract_mentions(t: Tree) -> DataFrame:
    return B.mentions(t.pages()).select("space_id", "page_id", "account_id")


def users(t: Tree, pages: DataFrame | None = None) -> DataFrame:
    """Half of the authors have a name."""
    return (t.pages() if pages is None else pages).select(F.col("author").alias("account_id")).distinct().where(F.substring("account_id", 2, 9).cast("int") % 2 == 0).withColumn("display_name", F.concat(F.lit("User "), F.substring("account_id", 2, 9)))


@query(q(TREE, "select space_id, page_id, author || ':' || case when substr(author, 2)::int % 2 = 0 then 'User ' || substr(author, 2) else '' end authors from pages"))
def a3_author_resolution(t: Tree) -> DataFrame:
    rows = B.author_resolution(t.pages(), users(t))
    return rows.select("space_id", "page_id", F.array_join(F.transform("authors", lambda a: F.concat(a["account_id"], F.lit(":"), a["name"])), "|").alias("authors"))


@query(q(TREE, "select space_id, page_id, author account_id, case when substr(author, 2)::int % 2 = 0 then 'User ' || substr(author, 2) else '' end as \"name\" from pages"))
def j6_resolve_users(t: Tree) -> DataFrame:
    rows = B.resolve_users(B.mentions(t.pages()), users(t))
    return rows.select("space_id", "page_id", F.explode("users").alias("account_id", "name"))


@query(q(TREE, "select space_id, bool_and(position < 6) complete from pages group by 1"))
def a5_completeness(t: Tree) -> DataFrame:
    return B.completeness(t.pages().select("space_id", (F.col("position") < 6).alias("listed"), F.lit(True).alias("downloaded")))


@query("select user_id::varchar page_id, count(*)::int as \"number\", max_by(strftime(ts, '%Y-%m-%d'), (ts, event_id)) created_at from events group by 1")
def a2b_latest_versions(t: Tree) -> DataFrame:
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    edits = t.read("events").select(F.col("user_id").cast("string").alias("page_id"), nth.alias("number"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.col("user_id").cast("string").alias("author_id"))
    return B.latest_versions(edits).select("page_id", "number", "created_at")


@query(q(TREE, "select space_id, space_key, name, \"type\" from spaces"))
def f5_list_spaces(t: Tree) -> DataFrame:
    return t.spaces().select("space_id", "space_key", "name", "type")


# Two snapshots: what a run does, given what the one before left.


def plan(t: Tree, rows: DataFrame) -> DataFrame:
    """Pages of a layout with version, status and fingerprint, as a state has them."""
    mark = F.sha2(F.concat_ws("@", "page_id", F.col("version").cast("string")), 256)

    def made() -> DataFrame:
        laid = L.layout(t.spaces(), rows, t.folders()).where("kind = 'page'").select("space_id", F.col("node_id").alias("page_id"), "dir", "file")
        return laid.join(rows.select("space_id", "page_id", "title", "version", "status"), ["space_id", "page_id"]).withColumn("fingerprint", mark)

    return settled(made)


def moved(pages: DataFrame) -> DataFrame:
    n = F.substring("page_id", 2, 20).cast("long") % 10
    return pages.withColumn("parent_id", F.when((n == 3) & F.col("page_id").startswith("c"), "").otherwise(F.col("parent_id")))


def before_and_now(t: Tree) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State of the previous snapshot, plan of the current one, and the current pages. Some pages have another parent now."""
    rows = t.once("pages", lambda: t.pages().drop("body"))
    now = moved(current(rows, "page_id"))
    return plan(t, previous(rows, "page_id")), plan(t, now), now


@query(q(SNAPSHOTS, "select space_id, page_id, case when s.page_id is not null and s.dir = p.dir and s.file = p.file and s.fingerprint = p.fingerprint then 'skip' else 'write' end as action, s.page_id is not null and s.dir <> p.dir moved from now_plan p left join old_plan s using (space_id, page_id)"))
def j11_skip_or_write(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.skip_or_write(new, state).select("space_id", "page_id", "action", "moved")


@query(q(SNAPSHOTS, "select space_id, page_id, s.dir old_dir, p.dir new_dir from now_plan p join old_plan s using (space_id, page_id) where s.dir <> p.dir"))
def j12_detect_moves(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.detect_moves(R.skip_or_write(new, state))


@query(
    q(
        SNAPSHOTS,
        """select * from (select space_id, page_id, case when s.dir is null then 'added' when p.dir is null then 'deleted' when s.dir <> p.dir then 'moved' when s.version <> p.version then 'changed' end as change,
        coalesce(p.title, s.title) as label, coalesce(s.dir, '') old_dir, coalesce(p.dir, '') new_dir from now_plan p full join old_plan s using (space_id, page_id)) where change is not null""",
    )
)
def j13_diff(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.diff(new, state).fillna("", ["old_dir", "new_dir"])


@query(q(SNAPSHOTS, "select s.space_id, s.page_id, s.dir, s.file from old_plan s anti join now_plan p using (space_id, page_id) anti join now_pages n using (space_id, page_id) where s.status <> 'archived'"))
def j14_prune_set(t: Tree) -> DataFrame:
    state, new, now = before_and_now(t)
    return R.prune_set(state, new, now, include_archived=False)


@query(q(SNAPSHOTS, "select space_id, s.file path from old_plan s where lower(s.file) not in (select lower(p.file) from now_plan p where p.space_id = s.space_id)"))
def j15_deletions(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.deletions(R.owned_paths(state), R.owned_paths(new))


@query(q(SNAPSHOTS, "select space_id, page_id, 'added' side from now_plan anti join old_plan using (space_id, page_id) union all select space_id, page_id, 'deleted' from old_plan anti join now_plan using (space_id, page_id)"))
def u4_added_deleted(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.added_deleted(new, state)


@query(
    q(
        SNAPSHOTS,
        """select space_id, planned, previous, prunable, case when why = '' then 'ok' when why in ('other_space', 'other_snapshot') then 'error' else 'keep_all' end verdict, why from (
        select s.space_id, coalesce(p.n, 0) planned, coalesce(o.n, 0) previous, coalesce(g.n, 0) prunable,
          case when s.space_id = 'r1' then 'other_snapshot' when coalesce(o.n, 0) > 0 and s.space_id = 'r4' then 'other_space' when coalesce(p.n, 0) = 0 and coalesce(o.n, 0) > 0 then 'empty_plan' when coalesce(o.n, 0) >= 10 and coalesce(g.n, 0) > o.n * 0.5 then 'mass_delete' else '' end why
        from spaces s
        left join (select space_id, count(*) n from now_plan where space_id <> 'r2' and (space_id <> 'r3' or page_id like 'o%1') group by 1) p on p.space_id = s.space_id
        left join (select space_id, count(*) n from old_plan group by 1) o on o.space_id = s.space_id
        left join (select space_id, count(*) n from old_plan anti join (select * from now_plan where space_id <> 'r2' and (space_id <> 'r3' or page_id like 'o%1')) k using (space_id, page_id) where status <> 'archived' group by 1) g on g.space_id = s.space_id)""",
    )
)
def a8_guard_verdicts(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    # Space r2 lists nothing, r3 a tenth; r4's output was another space's, r1's snapshot is.
    new = new.where("space_id <> 'r2' and (space_id <> 'r3' or page_id like 'o%1')")
    spaces = t.spaces().withColumn("state_space_id", F.when(F.col("space_id") == "r4", "r9").otherwise(F.col("space_id"))).withColumn("state_space_key", F.lit("")).withColumn("snapshot_space_key", F.when(F.col("space_id") == "r1", "ZZZ").otherwise(""))
    return R.guard_verdicts(spaces, new, state, include_archived=False)


@query(
    q(
        SNAPSHOTS,
        """select space_id, count(*) filter (act = 'write') written, count(*) filter (act = 'skip') skipped, count(*) filter (act = 'write' and moved) moved, max(g.n) pruned, 0::bigint warnings from (
        select space_id, page_id, case when s.page_id is not null and s.dir = p.dir and s.file = p.file and s.fingerprint = p.fingerprint then 'skip' else 'write' end act, coalesce(s.dir <> p.dir, false) moved from now_plan p left join old_plan s using (space_id, page_id))
        join (select space_id, count(*) n from old_plan anti join now_plan using (space_id, page_id) group by 1) g using (space_id) group by 1""",
    )
)
def a6_export_summary(t: Tree) -> DataFrame:
    state, new, _ = before_and_now(t)
    return R.export_summary(R.skip_or_write(new, state), R.missing_from_plan(state, new))


@query(q(SNAPSHOTS, "select space_id, page_id, dir, file, version, status from now_plan union all select s.space_id, s.page_id, s.dir, s.file, s.version, s.status from old_plan s anti join now_plan p using (space_id, page_id) where s.status = 'archived'"))
def u3_new_state(t: Tree) -> DataFrame:
    state, new, now = before_and_now(t)
    kept = R.survivors(state, new, now, include_archived=False)
    return R.new_state(R.skip_or_write(new, state), state, kept).select("space_id", "page_id", "dir", "file", "version", "status")


@query(q(LAYOUT, "select space_id, node_id folder_id, dir, len(string_split(dir, '/'))::bigint depth from placed where kind = 'folder' and substr(node_id, 2)::int % 4 = 1"))
def j16_stale_folder_dirs(t: Tree) -> DataFrame:
    folders = placed(t).where("kind = 'folder'").select("space_id", F.col("node_id").alias("folder_id"), "dir")
    return R.stale_folders(folders, folders.where(F.substring("folder_id", 2, 9).try_cast("int") % 4 != 1))


@query(q(ATT + DIGESTS, "select digest from (select digest from digests union select png_digest from derived) where digest not in (select digest from digests where ascii(digest) % 2 = 0 union select d.png_digest from derived d join digests x on x.digest = d.xml_digest and ascii(x.digest) % 2 = 0 where render_version = 2)"))
def j17_blob_gc(t: Tree) -> DataFrame:
    live = digests(t).where(F.ascii("digest") % 2 == 0)
    none = live.limit(0)
    keep = R.keep_set(none, live, derived(t), none.select(F.col("digest").alias("png_digest")), none.select(F.col("digest").alias("blob")), 2)
    return R.blob_gc(blobs(t), keep)


@query(q(ATT + DIGESTS, "select digest from digests where ascii(digest) % 2 = 0 union select d.png_digest from derived d join digests x on x.digest = d.xml_digest and ascii(x.digest) % 2 = 0 where render_version = 2"))
def u2_keep_set(t: Tree) -> DataFrame:
    live = digests(t).where(F.ascii("digest") % 2 == 0)
    none = live.limit(0)
    return R.keep_set(none, live, derived(t), none.select(F.col("digest").alias("png_digest")), none.select(F.col("digest").alias("blob")), 2)


@query(q(ATT + DIGESTS, "select render_version, xml_digest, case when ascii(xml_digest) % 3 = 0 then 'fresh' else png_digest end png_digest from derived"))
def j20_merge_derived(t: Tree) -> DataFrame:
    old = derived(t)
    return R.merge_derived(old, old.where(F.ascii("xml_digest") % 3 == 0).withColumn("png_digest", F.lit("fresh")))


def media_states(t: Tree) -> tuple[DataFrame, DataFrame]:
    """Previous attachment states and current ones: every seventh is gone now, every third has a new version, every other of these no bytes."""
    n, m = F.substring("page_id", 2, 20).cast("long"), F.substring_index("att_id", "-", -1).cast("int")
    rows = listed(t).select(F.lit("s").alias("space_id"), "page_id", "att_id", "version", F.col("title").alias("file"), F.sha2(F.concat_ws("@", "att_id", F.col("version").cast("string")), 256).alias("blob"))
    now = rows.where((n + m) % 7 != 0).withColumn("version", F.col("version") + F.when(n % 3 == 0, 1).otherwise(0)).withColumn("file", F.when(n % 3 == 0, F.concat(F.lit("new-"), "file")).otherwise(F.col("file"))).withColumn("blob", F.when((n % 3 == 0) & (m % 2 == 0), "").otherwise(F.col("blob")))
    return rows, now


STATES = """,
old_media as (select 's' space_id, page_id, att_id, version, title file, sha256(att_id || '@' || version) blob, substr(page_id, 2)::bigint n, split_part(att_id, '-', 2)::int m from listed),
now_media as (select space_id, page_id, att_id, version + case when n % 3 = 0 then 1 else 0 end as version, case when n % 3 = 0 then 'new-' || file else file end file, case when n % 3 = 0 and m % 2 = 0 then '' else blob end blob from old_media where (n + m) % 7 <> 0)
"""


@query(
    q(
        ATT + STATES,
        """select space_id, page_id, att_id, case when carried then o_version else c_version end as version, case when carried then o_file else c_file end file, carried from (
        select space_id, page_id, att_id, o.version o_version, o.file o_file, c.version c_version, c.file c_file, c.att_id is null or (c.blob = '' and substr(page_id, 2)::bigint % 2 = 0
          and lower(o.file) not in (select lower(p.file) from now_media p where p.page_id = o.page_id and p.blob <> '')) carried from now_media c full join old_media o using (space_id, page_id, att_id))""",
    )
)
def j18_carry_media(t: Tree) -> DataFrame:
    """An incomplete listing; every other page has moved."""
    old, now = media_states(t)
    moved = old.select("space_id", "page_id").where(F.substring("page_id", 2, 20).cast("long") % 2 == 0)
    return R.carry_media(old, now, complete=False, moved=moved).select("space_id", "page_id", "att_id", "version", "file", "carried")


@query(q(ATT + STATES, "select o.space_id, o.page_id, o.file from old_media o where not exists (select 1 from now_media c where c.page_id = o.page_id and lower(c.file) = lower(o.file))"))
def j19_stale_media(t: Tree) -> DataFrame:
    old, now = media_states(t)
    return R.stale_media(old, now, now.limit(0).select("space_id", "page_id", "file"))


@query(
    q(
        TREE + ", " + ATT + NAMED,
        """, files as (select page_id, string_agg('{"att_id":"' || att_id || '","version":' || version || ',"local_name":"' || local_name || '"}', ',' order by att_id, version, local_name) atts from named group by 1)
        select space_id, page_id, sha256('{"version":' || version || ',"converter_version":1,"include_html":false,"media":true,"render_drawio":true,"site_url":"","atts":[' || coalesce(atts, '') || '],"digest":"' || sha256(body)
        || '","pngs":[],"author_lookup":true,"authors":[{"account_id":"' || author || '","name":"' || case when substr(author, 2)::int % 2 = 0 then 'User ' || substr(author, 2) else '' end || '"}]}') fingerprint
        from bodies left join files using (page_id)""",
    )
)
def a1_page_fingerprint(t: Tree) -> DataFrame:
    pages = t.once("bodies", t.pages)
    _, links, _ = B.store_bodies(pages)
    none = pages.select("page_id", F.lit("").alias("png_digest")).limit(0)
    return P.page_fingerprints(pages, named(t), links, none, B.author_resolution(pages, users(t, pages)))


# Names.


@query("select page_id, case when s = '' then 'untitled' else s end segment from (select page_id, rtrim(left(trim(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-'), 100), '-') s from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages))")
def x2_sanitize_filename(t: Tree) -> DataFrame:
    return t.read("pages").select("page_id", N.sanitize_filename(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("segment"))


@query("select page_id, replace(lower(nfc_normalize(regexp_extract(html, '<title>([^<]*)</title>', 1))), 'ß', 'ss') folded from pages")
def x1_nfc_casefold(t: Tree) -> DataFrame:
    return t.read("pages").select("page_id", N.nfc_casefold(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("folded"))


@query("select page_id, '.media/' || replace(replace(url_encode(regexp_extract(html, '<title>([^<]*)</title>', 1)), '+', '%20'), '*', '%2A') as media from pages")
def x7_media_url(t: Tree) -> DataFrame:
    return t.read("pages").select("page_id", N.media_url(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("media"))


@query("select page_id, regexp_replace(url, '[\\[\\]()\r\n]', '', 'g') as label, case when url ~ '^https?://' then url else '' end safe, sha256(url) digest from pages")
def x9_labels_and_urls(t: Tree) -> DataFrame:
    return t.read("pages").select("page_id", N.markdown_label(F.col("url")).alias("label"), N.safe_external_url(F.col("url")).alias("safe"), F.sha2("url", 256).alias("digest"))


# Rendering. The tables hold no macros: pages' own HTML, and mentions in the bodies of TREE.


def html_pages(t: Tree) -> DataFrame:
    return t.read("pages").select(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("space_id"), F.col("page_id").cast("string").alias("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("body"))


@query()
def r1_render_markdown(t: Tree) -> DataFrame:
    return J.render_markdown(J.wide(html_pages(t))).select("space_id", "page_id", "markdown")


@query(q(TREE, "select space_id, page_id, '# ' || title || chr(10) || chr(10) || 'by @' || case when substr(author, 2)::int % 2 = 0 then 'User ' || substr(author, 2) else author end || ' on ' || page_id markdown from pages"))
def r1b_render_mentions(t: Tree) -> DataFrame:
    pages = t.once("bodies", t.pages)
    rows = J.wide(pages, users=B.resolve_users(B.mentions(pages), users(t, pages)))
    return J.render_markdown(rows).select("space_id", "page_id", "markdown")


def macro_pages(t: Tree) -> DataFrame:
    """Documents as bodies with a macro, a link to an attachment and a task list each."""
    d = documents(t).withColumn("title", F.concat(F.lit("Doc "), "page_id"))
    body = F.concat(
        F.lit('<ac:structured-macro ac:name="'), F.when(F.col("page_id").cast("long") % 2 == 0, "info").otherwise("note"), F.lit('"><ac:parameter ac:name="title">T'), "page_id",
        F.lit('</ac:parameter><ac:rich-text-body><ac:structured-macro ac:name="status"><ac:parameter ac:name="title">S</ac:parameter></ac:structured-macro></ac:rich-text-body></ac:structured-macro><ac:link><ri:attachment ri:filename="f'), "page_id",
        F.lit('.png"/></ac:link><ac:task-list><ac:task><ac:task-status>'), F.when(F.col("page_id").cast("long") % 3 == 0, "complete").otherwise("incomplete"), F.lit("</ac:task-status><ac:task-body>do "), "page_id", F.lit("</ac:task-body></ac:task></ac:task-list>"),
    )
    return d.withColumn("body", body)


@query(
    """select source space_id, doc_id::varchar page_id, '# Doc ' || doc_id || chr(10) || chr(10) || '> **T' || doc_id || '**' || chr(10) || '>' || chr(10) || '> **S**' || chr(10) || chr(10)
    || case when doc_id % 2 = 0 then '[f' || doc_id || '.png](.media/f' || doc_id || '.png)' else 'Missing attachment: f' || doc_id || '.png' end || chr(10) || chr(10)
    || '* [' || case when doc_id % 3 = 0 then 'x' else ' ' end || '] do ' || doc_id as markdown, doc_id % 2 as missing from documents"""
)
def r1c_render_macros(t: Tree) -> DataFrame:
    return rendered_macros(t).select("space_id", "page_id", "markdown", F.size("warnings").cast("long").alias("missing"))


def rendered_macros(t: Tree) -> DataFrame:
    """The pages of macro_pages; every other one has the file that it links to."""
    pages = macro_pages(t)
    files = pages.where(F.col("page_id").cast("long") % 2 == 0).select("page_id", F.concat(F.lit("a"), "page_id").alias("att_id"), F.concat(F.lit("f"), "page_id", F.lit(".png")).alias("title"), F.lit("image/png").alias("media_type"), F.lit(1).alias("version"), F.lit("2024").alias("created_at"), F.lit(0).alias("ord"))
    names = A.plan_names(files)
    have = names.groupBy("page_id").agg(F.collect_set("local_name").alias("names"))
    return J.render_markdown(J.wide(pages, names, have))


@query("select doc_id::varchar page_id, case when doc_id % 2 = 0 then 'info' else 'note' end as \"name\", 'T' || doc_id title, true has_rich_body, 0::bigint depth from documents union all select doc_id::varchar, 'status', 'S', false, 1 from documents")
def r2_extract_macros(t: Tree) -> DataFrame:
    return J.extract_macros(macro_pages(t)).select("page_id", "name", F.col("params")["title"].alias("title"), "has_rich_body", "depth")


@query("select doc_id::varchar page_id, 'attachment' kind, 'f' || doc_id || '.png' as \"name\", false image from documents")
def r4_extract_refs(t: Tree) -> DataFrame:
    return J.extract_refs(macro_pages(t)).select("page_id", "kind", "name", "image")


@query("select doc_id::varchar page_id, 'task' kind, doc_id % 3 = 0 done, 'do ' || doc_id as \"text\", 0::bigint depth from documents")
def r5_extract_tasks(t: Tree) -> DataFrame:
    return J.extract_tasks(macro_pages(t)).select("page_id", "kind", "done", "text", "depth")


@query(q(TREE, "select space_id, page_id, title, parent_id, parent_type, position, status, version, '' web_url from pages"))
def s8_normalize(t: Tree) -> DataFrame:
    from leafmill.tables import normalize

    rows = t.pages().withColumn("version", F.struct(F.col("version").alias("number"), F.lit(None).cast("string").alias("message"))).withColumn("status", F.when(F.col("status") == "archived", "archived")).drop("author")
    return normalize(rows, "pages").select("space_id", "page_id", "title", "parent_id", "parent_type", "position", "status", F.col("version.number").alias("version"), "web_url")


# Listings: the tree's rows as the JSON that a wiki's listing would be, parsed and mapped again.


def v1_listing(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    p = t.pages()
    record = F.struct(F.col("page_id").alias("id"), "title", "status", F.struct(F.col("space_id").alias("id")).alias("space"), F.array(F.struct(F.lit("top").alias("id")), F.struct(F.col("parent_id").alias("id"))).alias("ancestors"), F.struct(F.col("position").cast("string").alias("position")).alias("extensions"), F.struct(F.col("version").alias("number"), F.lit("2024-01-01").alias("when"), F.struct(F.col("author").alias("userKey")).alias("by")).alias("version"))
    envelope = F.from_json(F.to_json(F.struct(F.array(record).alias("results"))), f"results array<struct<{S.RECORDS['pages_v1']}>>")
    return S.records(p.select(F.lit("").alias("source"), envelope["results"].alias("results")))


@query(q(TREE, "select space_id, page_id, title, parent_id, 'page' parent_type, position, status, version as \"number\", author author_id from pages"))
def s2_pages_from_v1(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    return S.pages_from_v1(v1_listing(t)).select("space_id", "page_id", "title", "parent_id", "parent_type", "position", "status", F.col("version.number").alias("number"), F.col("version.author_id").alias("author_id"))


def v2_listing(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    record = F.struct(F.col("page_id").alias("id"), "title", F.col("space_id").alias("spaceId"), F.col("parent_id").alias("parentId"), F.col("parent_type").alias("parentType"), "position", F.nullif("status", F.lit("current")).alias("status"), F.struct(F.struct(F.col("body").alias("value")).alias("storage")).alias("body"), F.struct(F.col("version").alias("number"), F.lit("2024-01-01").alias("createdAt"), F.struct(F.col("author").alias("accountId")).alias("author")).alias("version"))
    envelope = F.from_json(F.to_json(F.struct(F.array(record).alias("results"))), f"results array<struct<{S.RECORDS['pages_v2']}>>")
    return S.records(t.pages().select(F.lit("").alias("source"), envelope["results"].alias("results")))


@query(q(TREE, "select space_id, page_id, title, parent_id, parent_type, position, status, body, version as \"number\", author author_id from bodies"))
def s1_pages_from_v2(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    return S.pages_from_v2(v2_listing(t)).select("space_id", "page_id", "title", "parent_id", "parent_type", "position", "status", "body", F.col("version.number").alias("number"), F.col("version.author_id").alias("author_id"))


@query(q(ATT, "select page_id, att_id, title, media_type, file_size from atts"))
def s3_attachments_from_v1(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    record = F.struct(F.col("att_id").alias("id"), "title", F.struct(F.lit("").alias("mediaType")).alias("metadata"), F.struct(F.col("media_type").alias("mediaType"), F.col("file_size").alias("fileSize")).alias("extensions"), F.struct(F.col("page_id").alias("id")).alias("container"))
    envelope = F.from_json(F.to_json(F.struct(F.array(record).alias("results"))), f"results array<struct<{S.RECORDS['attachments_v1']}>>")
    rows = S.records(t.attachments().select(F.lit("").alias("source"), envelope["results"].alias("results")))
    return S.attachments_from_v1(rows).select("page_id", "att_id", "title", "media_type", "file_size")


@query(q(TREE, "select folder_id, title, position from (select node_id folder_id, title, position from folders)"))
def s4_folders_from_v2(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    record = F.struct(F.col("folder_id").alias("id"), "title", "position")
    envelope = F.from_json(F.to_json(F.struct(F.array(record).alias("results"))), f"results array<struct<{S.RECORDS['folders_v2']}>>")
    return S.folders_from_v2(S.records(t.folders().select(F.lit("").alias("source"), envelope["results"].alias("results")))).select("folder_id", "title", "position")


@query("select user_id::varchar account_id, 'name ' || user_id display_name from events where user_id % 3 > 0 group by 1, 2")
def s7_users_from_json(t: Tree) -> DataFrame:
    from leafmill.sources import listings as S

    name = F.concat(F.lit("name "), "user_id")
    record = F.struct(F.col("user_id").alias("accountId"), F.when(F.col("user_id") % 3 == 1, name).otherwise("").alias("displayName"), F.when(F.col("user_id") % 3 == 2, name).alias("publicName"))
    envelope = F.from_json(F.to_json(F.struct(F.array(record).alias("results"))), f"results array<struct<{S.RECORDS['users']}>>")
    return S.users_from_json(S.records(t.read("events").select("user_id").distinct().select(F.lit("").alias("source"), envelope["results"].alias("results"))))


# The rest registers itself.
from leafmill import queries_more  # noqa: E402, F401
