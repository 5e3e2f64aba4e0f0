"""DuckDB SQL for the same answers, as views and queries over the driver's tables."""

from __future__ import annotations

TREE = """
spaces as (select 'r' || r_regionkey space_id, upper(substr(r_name, 1, 3)) space_key, r_name as name, case when r_regionkey % 2 = 0 then 'global' else 'personal' end as "type" from region),
folders as (select 'r' || n_regionkey space_id, 'n' || n_nationkey node_id, 'folder' kind, n_name title, '' parent_id, n_nationkey::int position, false archived from nation),
pages as (
  select 'r' || n_regionkey space_id, 'c' || c_custkey page_id, c_mktsegment title, 'n' || c_nationkey parent_id, 'folder' parent_type, (c_custkey % 7)::int position, 'current' status, 1 as version, 'u' || (c_custkey % 50) author
  from customer join nation on c_nationkey = n_nationkey
  union all
  select 'r' || n_regionkey, 'o' || o_orderkey, o_orderpriority, 'c' || o_custkey, 'page', 0, case when o_orderstatus = 'P' then 'archived' else 'current' end, year(o_orderdate)::int, 'u' || (o_custkey % 50)
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
),
bodies as (select *, '<p>by <ri:user ri:account-id="' || author || '"/> on ' || page_id || '</p>' body from pages)
"""

# Sanitised names of this data have no marks besides separators; collisions are of equal names only.
LAYOUT = (
    TREE
    + """,
nodes as (select space_id, page_id node_id, 'page' kind, title, parent_id, position, status = 'archived' archived from pages union all select * from folders),
parented as (
  select n.space_id, n.node_id, n.kind, n.title, n.position, false synthetic,
    case when n.kind = 'folder' then case when a.node_id is not null then n.parent_id else '' end
         when n.archived then case when a.kind = 'page' and a.archived then n.parent_id else '_archived' end
         when a.node_id is not null and not a.archived then n.parent_id else '' end parent_id
  from nodes n left join nodes a on a.space_id = n.space_id and a.node_id = n.parent_id
),
parents as (
  select * from parented
  union all select distinct space_id, '_archived', 'archive', '_archived', 0, true, '' from parented where parent_id = '_archived'
),
ranked as (select *, row_number() over (partition by space_id, parent_id order by synthetic desc, position, node_id) rank,
  case when synthetic then title else trim(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-') end base from parents),
segmented as (select *, base || case when nth > 1 then '-' || nth else '' end segment from (select *, row_number() over (partition by space_id, parent_id, lower(base) order by rank) nth from ranked)),
placed as (
  with recursive walk as (
    select s.space_id, node_id, kind, title, parent_id, position, rank, segment, trim(regexp_replace(sp.name, '[-\\s]+', '-', 'g'), '-') || '/' || segment dir, [node_id] path_ids, [rank] ranks
    from segmented s join spaces sp on sp.space_id = s.space_id where parent_id = ''
    union all
    select s.space_id, s.node_id, s.kind, s.title, s.parent_id, s.position, s.rank, s.segment, w.dir || '/' || s.segment, list_append(w.path_ids, s.node_id), list_append(w.ranks, s.rank)
    from segmented s join walk w on w.space_id = s.space_id and w.node_id = s.parent_id
  )
  select *, case when kind = 'page' then dir || '/' || segment || '.md' end file from walk
)
"""
)

ATT = """
atts as (
  select 'o' || l_orderkey page_id, l_orderkey || '-' || l_linenumber att_id,
    split_part(p_name, ' ', 2) || case l_linenumber % 3 when 0 then '.drawio' when 1 then '.drawio.png' else '.pdf' end title,
    case l_linenumber % 3 when 0 then 'application/vnd.jgraph' when 1 then 'image/png' else 'application/pdf' end media_type,
    l_quantity::bigint file_size, strftime(l_shipdate, '%Y-%m-%d') created_at, year(l_shipdate)::int as version,
    row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) ord
  from lineitem join part on l_partkey = p_partkey
),
listed as (select * exclude n from (select *, row_number() over (partition by page_id, att_id order by ord) n from atts) where n = 1)
"""


NAMED = """,
grouped as (select *, row_number() over (partition by page_id, lower(title) order by created_at, lower(title), att_id) nth from listed),
named as (select * exclude nth, case when nth = 1 then title else regexp_replace(title, '^([^.]*)', '\\1-' || att_id) end local_name from grouped)
"""

PAIRS = """,
diagrams as (select page_id, att_id xml_id, title xml_title, version xml_version, created_at xml_at from listed where ends_with(title, '.drawio')),
previews as (select page_id, title, arg_max(att_id, ord) png_id, arg_max(version, ord) png_version, arg_max(created_at, ord) png_at from listed where media_type = 'image/png' group by 1, 2),
pairs as (select d.page_id, xml_id, xml_title, xml_version, png_id, png_version, coalesce(png_at >= xml_at, false) preview_fresh from diagrams d left join previews p on p.page_id = d.page_id and p.title = d.xml_title || '.png')
"""

DIGESTS = """,
digests as (select distinct att_id, version, sha256(att_id || '@' || version) digest from listed where file_size % 5 <> 0),
derived as (select case when ascii(substr(digest, 2)) % 2 = 0 then 2 else 1 end render_version, digest xml_digest, sha256('png' || digest) png_digest from digests where ascii(digest) % 3 = 0)
"""


def _snapshot(name: str, pages: str) -> str:
    """A layout of some of the pages as views of its own."""
    views = LAYOUT.split("bodies as", 1)[1].split("nodes as", 1)[1]
    views = "nodes as" + views
    for view in ("nodes", "parented", "parents", "ranked", "segmented", "placed"):
        for before, after in ((f"{view} as (", f"{name}_{view} as ("), (f"from {view} ", f"from {name}_{view} "), (f"from {view})", f"from {name}_{view})"), (f"join {view} ", f"join {name}_{view} "), (f"from {view}\n", f"from {name}_{view}\n")):
            views = views.replace(before, after)
    views = views.replace("from pages union all", f"from {name}_pages union all")
    plan = f"{name}_plan as (select l.space_id, l.node_id page_id, dir, file, p.title, p.version, p.status, sha256(l.node_id || '@' || p.version) fingerprint from {name}_placed l join {name}_pages p on p.space_id = l.space_id and p.page_id = l.node_id where l.kind = 'page')"
    return f"{name}_pages as ({pages}), {views}, {plan}"


SNAPSHOTS = (
    TREE
    + ", "
    + _snapshot("old", "select * from pages where substr(page_id, 2)::bigint % 10 <> 0")
    + ", "
    + _snapshot("now", "select * replace (version + case when substr(page_id, 2)::bigint % 10 = 2 then 1 else 0 end as version, case when substr(page_id, 2)::bigint % 10 = 3 and page_id like 'c%' then '' else parent_id end as parent_id) from pages where substr(page_id, 2)::bigint % 10 <> 1")
)


def q(views: str, select: str) -> str:
    return f"with recursive {views} {select}"
