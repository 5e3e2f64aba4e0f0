"""From pages and folders to paths: parents, sibling order, segments, directories, depth-first order.

Everything is keyed by (space_id, parent_id), so a space with very many pages spreads over tasks; paths are put together by
doubling pointers, in rounds logarithmic in the tree's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.functions.names import LONGEST, fold, nfc_casefold, sanitize_filename
from leafmill.lineage import numbered, stored
from leafmill.operators.groups import add_column

ARCHIVE = "_archived"


def nodes(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """Pages and folders as one table; a page wins an id it shares with a folder, of rows with one id the last listed wins."""
    p = pages.select("space_id", F.col("page_id").alias("node_id"), F.lit("page").alias("kind"), "title", "parent_id", "position", (F.col("status") == "archived").alias("archived"), "ord")
    f = folders.select("space_id", F.col("folder_id").alias("node_id"), F.lit("folder").alias("kind"), "title", "parent_id", "position", F.lit(False).alias("archived"), "ord")
    both = p.unionByName(f).where("node_id <> ''")
    last = W.partitionBy("space_id", "node_id").orderBy(F.desc(F.col("kind") == "page"), F.desc("ord"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "ord")


def resolve_parents(tree: DataFrame) -> DataFrame:
    """Effective parent of each node ('' for the space's root), and one synthetic archive node in spaces that need it."""
    above = tree.select("space_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("_kind"), F.col("archived").alias("_archived"), F.lit(True).alias("_found"))
    joined = tree.join(above, ["space_id", "parent_id"], "left")
    found = F.coalesce("_found", F.lit(False))
    parent = (
        F.when(F.col("kind") == "folder", F.when(found, F.col("parent_id")).otherwise(""))
        .when(F.col("archived"), F.when(found & (F.col("_kind") == "page") & F.col("_archived"), F.col("parent_id")).otherwise(ARCHIVE))
        .otherwise(F.when(found & ~F.col("_archived"), F.col("parent_id")).otherwise(""))
    )
    out = joined.select("space_id", "node_id", "kind", "title", parent.alias("parent_id"), "position", F.lit(False).alias("synthetic"), (F.col("archived") | (F.col("parent_id") == ARCHIVE)).alias("_archive"))
    # Only these can stand there; the others take no part in looking for them.
    archive = out.where(F.col("_archive") & (F.col("parent_id") == ARCHIVE)).select("space_id").distinct()
    archive = archive.select("space_id", F.lit(ARCHIVE).alias("node_id"), F.lit("archive").alias("kind"), F.lit(ARCHIVE).alias("title"), F.lit("").alias("parent_id"), F.lit(0).alias("position"), F.lit(True).alias("synthetic"))
    return out.drop("_archive").unionByName(archive)


def sibling_rank(tree: DataFrame) -> DataFrame:
    order = W.partitionBy("space_id", "parent_id").orderBy(F.desc("synthetic"), "position", "node_id")
    return tree.withColumn("rank", F.row_number().over(order))


def _segments(rows: list) -> list[str]:
    """Segments of one family of names among siblings, in their order: the base, or the smallest free number behind it."""
    taken, following, out = set(), {}, []
    for row in rows:
        name, n = row.base, following.get(row.base, 2)
        while fold(name) in taken:
            suffix = f"-{n}"
            name = (row.base[: LONGEST - len(suffix)].rstrip("-") or "untitled") + suffix
            n += 1
        following[row.base] = n
        taken.add(fold(name))
        out.append(name)
    return out


def allocate_segments(ranked: DataFrame) -> DataFrame:
    """Adds segment: unique among siblings without regard to case.

    Names that could meet another base's numbered name form a family: they agree without trailing numbers. A family in which
    all bases are one plain name is numbered by row_number; only the others go through Python, family by family.
    """
    based = ranked.withColumn("base", F.when(F.col("synthetic"), F.col("title")).otherwise(sanitize_filename(F.col("title"))))
    based = based.withColumn("folded", nfc_casefold("base")).withColumn("family", F.substring(F.regexp_replace("folded", r"(-[0-9]+)+$", ""), 1, 80))
    family = W.partitionBy("space_id", "parent_id", "family")
    plain = (F.col("folded") == F.col("family")) & (F.char_length("base") <= LONGEST - 20)
    # Both kinds of families are taken from it. Numbers are given before, where siblings are together anyway.
    based = stored(based.withColumns({"n": F.row_number().over(family.orderBy("rank")), "plain": F.min(plain).over(family)}))
    quick = based.where("plain").withColumn("segment", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))))
    slow = based.where("not plain").drop("n")
    slow = stored(add_column(slow, ["space_id", "parent_id", "family"], ["rank"], "segment", _segments))
    return quick.drop("n").unionByName(slow).drop("base", "folded", "family", "plain")


def assemble_paths(segments: DataFrame, spaces: DataFrame) -> DataFrame:
    """Adds dir, file (pages only), path_ids (from the top, itself included) and ranks. Nodes that no root reaches are left out.

    First the paths of nodes with something below them: pointers are doubled, each node knows the path from an ancestor down,
    and joins it to what that ancestor knows, so a tree of any depth takes rounds in the logarithm of its depth, and nodes
    that have come to the root take no further part. One whose path meets a node twice hangs in a cycle. Then every node's
    path is its parent's and one more; so most nodes, which have nothing below, are moved once.
    """
    root = spaces.select("space_id", sanitize_filename(F.col("name")).alias("root"))
    rows = segments
    parts = ["segments", "path_ids", "ranks"]
    own = {"segments": F.array("segment"), "path_ids": F.array("node_id"), "ranks": F.array("rank")}
    parents = rows.where("parent_id <> ''").select("space_id", F.col("parent_id").alias("node_id")).distinct()
    paths = stored(rows.join(parents, ["space_id", "node_id"], "left_semi").select("space_id", "node_id", F.col("parent_id").alias("up"), *[v.alias(c) for c, v in own.items()]))
    done, open_ = [paths.where("up = ''")], paths.where("up <> ''")
    known = paths
    while open_.limit(1).count():
        above = known.select("space_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in parts])
        # An ancestor that isn't there any more hung in a cycle.
        went = open_.join(above, ["space_id", "up"]).select("space_id", "node_id", F.col("_up").alias("up"), *[F.concat(f"_{c}", c).alias(c) for c in parts])
        went = stored(went.where((F.col("up") == "") | (F.size(F.array_distinct("path_ids")) == F.size("path_ids"))))
        done.append(went.where("up = ''"))
        open_ = went.where("up <> ''")
        # A node still open is twice as far from an ancestor as before; the others are asked for no more.
        known = went
        for more in done[:-1]:
            known = known.unionByName(more)
    inner = done[0]
    for more in done[1:]:
        inner = inner.unionByName(more)
    above = inner.select("space_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"_{c}") for c in parts])
    below = rows.where("parent_id <> ''").join(above, ["space_id", "parent_id"]).withColumns({c: F.concat(f"_{c}", v) for c, v in own.items()})
    # Tops have no parent to meet.
    out = below.drop(*[f"_{c}" for c in parts]).unionByName(rows.where("parent_id = ''").withColumns(own)).join(root, "space_id")
    out = out.withColumn("dir", F.concat("root", F.lit("/"), F.array_join("segments", "/"))).drop("root", "segments")
    return out.withColumn("file", F.when(F.col("kind") == "page", F.concat("dir", F.lit("/"), "segment", F.lit(".md"))))


def preorder(paths: DataFrame) -> DataFrame:
    """Adds ord to pages: their place in a depth-first walk of their space, from 1.

    A rank array is its parent's and one more, so array order is the walk's. All pages are sorted in ranges, each range is
    numbered behind those before it, and a space's first number is taken away; so neither a space nor a chain of pages under
    one top is a task's work.
    """
    pages = paths.where("kind = 'page'")
    placed = numbered(pages.orderBy("space_id", "ranks"), "_place")
    first = placed.groupBy("space_id").agg(F.min("_place").alias("_first"))
    return placed.join(first, "space_id").withColumn("ord", (F.col("_place") - F.col("_first") + 1).cast("long")).drop("_place", "_first")


def in_order(paths: DataFrame) -> DataFrame:
    """Pages as a depth-first walk of each space meets them."""
    return preorder(paths).orderBy("space_id", "ord")


def layout(spaces: DataFrame, pages: DataFrame, folders: DataFrame) -> DataFrame:
    """space_id, node_id, kind, title, parent_id, segment, dir, file, path_ids, ranks of every node that a root reaches."""
    # Nodes meet their parents among themselves.
    placed = assemble_paths(allocate_segments(sibling_rank(resolve_parents(stored(nodes(pages, folders))))), spaces)
    return placed.select("space_id", "node_id", "kind", "title", "parent_id", "position", "rank", "segment", "dir", "file", "path_ids", "ranks")


def unreached(tree: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes whose parents form a cycle: no path, one warning row each."""
    return tree.join(placed, ["space_id", "node_id"], "left_anti").select("space_id", F.lit("layout").alias("stage"), F.lit("cycle").alias("kind"), F.col("node_id").alias("key"), F.concat(F.lit("no path to the root: "), "title").alias("message"))


def folder_closure(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders that hold pages, and their folders, up to the top: (space_id, folder_id). Missing ones are skipped, cycles end.

    Pointers are doubled: with each round, what has been reached is joined to its ancestor twice as far up as before.
    """
    key = ["space_id", "folder_id"]
    known = stored(folders.select(*key, F.when(F.col("parent_type") == "folder", F.col("parent_id")).alias("up")).dropDuplicates(key))
    there = known.select("space_id", F.col("folder_id").alias("up"), F.lit(True).alias("_there"))
    jumps = known.where("up is not null").join(there, ["space_id", "up"]).select(*key, "up")
    reached = stored(known.select(*key).join(pages.where("parent_type = 'folder'").select("space_id", F.col("parent_id").alias("folder_id")).distinct(), key, "left_semi"))
    while True:
        jumps = stored(jumps)
        new = stored(jumps.join(reached, key, "left_semi").select("space_id", F.col("up").alias("folder_id")).distinct().join(reached, key, "left_anti"))
        # If ancestors at this distance are all there, so are all nearer ones, and nothing lies beyond.
        if new.limit(1).count() == 0:
            return reached
        reached = stored(reached.unionByName(new))
        further = jumps.select("space_id", F.col("folder_id").alias("up"), F.col("up").alias("_up"))
        jumps = jumps.join(further, ["space_id", "up"]).select(*key, F.col("_up").alias("up"))


def resolve_subtree(placed: DataFrame, space_id: str, path: str) -> str | None:
    """The node that a path of raw titles names, level by level without regard to case; the first sibling wins."""
    parent = ""
    steps = [s for s in path.strip("/").split("/") if s]
    for step in steps:
        row = placed.where((F.col("space_id") == space_id) & (F.col("parent_id") == parent) & (F.lower("title") == step.lower())).orderBy("rank").select("node_id").first()
        if row is None:
            return None
        parent = row[0]
    return parent or None


def restrict(placed: DataFrame, space_id: str, node_id: str | None, *, no_children: bool = False) -> DataFrame:
    """A plan of the whole tree limited to a node and what is below; paths stay. Without a node nothing is left."""
    space = placed.where(F.col("space_id") == space_id)
    if node_id is None:
        return space.where(F.lit(False))
    below = F.array_contains("path_ids", node_id)
    if no_children:
        return space.where(below & ((F.col("kind") == "folder") | (F.col("node_id") == node_id)))
    return space.where(below)


def resolve_subtrees(placed: DataFrame, scopes: DataFrame) -> DataFrame:
    """scopes (space_id, path, no_children: any number of paths a space) with node_id and dir of the node each path names; null where none does.

    All paths go down together, one join a level of the longest path: titles are compared without regard to case, the first
    sibling wins, and there is no way back from it. A path without steps names nothing.
    """
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    open_ = stored(scopes.select("space_id", "path", F.coalesce("no_children", F.lit(False)).alias("no_children")).distinct().withColumns({"steps": steps, "node_id": F.lit(""), "dir": F.lit(None).cast("string")}))
    kids = placed.select("space_id", F.col("parent_id").alias("node_id"), F.lower("title").alias("step"), F.struct("rank", F.col("node_id").alias("id"), F.col("dir").alias("at")).alias("kid"))
    longest = open_.agg(F.max(F.size("steps"))).first()[0] or 0
    for k in range(longest):
        wanted = open_.where((F.size("steps") > k) & F.col("node_id").isNotNull()).withColumn("step", F.lower(F.get("steps", F.lit(k))))
        # Only siblings that are asked for are grouped.
        met = kids.join(wanted.select("space_id", "node_id", "step").distinct(), ["space_id", "node_id", "step"], "left_semi").groupBy("space_id", "node_id", "step").agg(F.min("kid").alias("kid"))
        went = wanted.join(met, ["space_id", "node_id", "step"], "left").select("space_id", "path", "no_children", "steps", F.col("kid.id").alias("node_id"), F.col("kid.at").alias("dir"))
        open_ = stored(went.unionByName(open_.where((F.size("steps") <= k) | F.col("node_id").isNull())))
    return open_.select("space_id", "path", "no_children", F.nullif("node_id", F.lit("")).alias("node_id"), "dir")


def restrict_scopes(placed: DataFrame, resolved: DataFrame) -> DataFrame:
    """A plan of whole trees, limited in spaces with scopes (as resolve_subtrees gives them) to their nodes and what is below; with no_children to a node itself and the folders below.

    Nodes meet scopes by the ids on their paths, so a large space spreads over tasks.
    """
    scoped = resolved.select("space_id").distinct()
    tops = resolved.where("node_id is not null").groupBy("space_id", F.col("node_id").alias("top")).agg(F.min("no_children").alias("_alone"))
    inside = placed.join(scoped, "space_id", "left_semi").select("space_id", "node_id", "kind", F.explode("path_ids").alias("top")).join(tops, ["space_id", "top"])
    kept = inside.where((F.col("kind") == "folder") | (F.col("node_id") == F.col("top")) | ~F.col("_alone")).select("space_id", "node_id").distinct()
    return placed.join(scoped, "space_id", "left_anti").unionByName(placed.join(kept, ["space_id", "node_id"], "left_semi"))


def in_scopes(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds in_scope to rows with space_id and dir: whether dir is a scope's or, without no_children, below it; all of it in spaces without scopes."""
    scoped = resolved.select("space_id", F.lit(True).alias("_scoped")).distinct()
    dirs = resolved.where("dir is not null").groupBy("space_id", F.col("dir").alias("top")).agg(F.min("no_children").alias("_alone"))
    parts = F.split("dir", "/")
    above = rows.join(scoped, "space_id", "left_semi").select("space_id", "dir").distinct().select("space_id", "dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("top"))
    met = above.join(dirs, ["space_id", "top"]).where((F.col("dir") == F.col("top")) | ~F.col("_alone")).select("space_id", "dir").distinct().withColumn("_met", F.lit(True))
    out = rows.join(scoped, "space_id", "left").join(met, ["space_id", "dir"], "left")
    return out.withColumn("in_scope", F.col("_scoped").isNull() | F.col("_met").isNotNull()).drop("_scoped", "_met")


def in_scope(directory, prefix):
    """Whether a directory is prefix or below it."""
    return (directory == prefix) | F.startswith(directory, F.concat(prefix, F.lit("/")))


def unsafe() -> Column:
    """Whether a planned path is absolute or holds a `..` step."""
    path = F.coalesce("file", "dir")
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def unsafe_paths(placed: DataFrame) -> DataFrame:
    """Planned paths that are absolute or hold a `..` step: none, or the plan is wrong."""
    return placed.where(unsafe())


def current_only(pages: DataFrame, include_archived: bool = False) -> DataFrame:
    return pages if include_archived else pages.where("status <> 'archived'")


def last_listed(rows: DataFrame, key: str) -> DataFrame:
    """Of rows of a space with one id, the last listed."""
    last = W.partitionBy("space_id", key).orderBy(F.desc("ord"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def page_tree(placed: DataFrame) -> DataFrame:
    """Lines of the tree as text, by path: two spaces a level, folders with a slash at their end."""
    depth = F.greatest(F.size(F.split("dir", "/")) - 2, F.lit(0))
    name = F.concat(F.element_at(F.split("dir", "/"), -1), F.when(F.col("kind") == "folder", "/").otherwise(""))
    return placed.where("kind in ('page', 'folder')").select("space_id", F.col("dir").alias("path"), F.concat(F.repeat(F.lit("  "), depth), name).alias("line"), depth.cast("long").alias("depth")).orderBy("space_id", "path")


def find_pages(placed: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """Current pages whose title holds query, without regard to case: page_id, and their directory or else their title."""
    hits = current_only(pages).where(F.contains(F.lower("title"), F.lit(query.lower()))).select("space_id", "page_id", "title")
    dirs = placed.where("kind = 'page'").select("space_id", F.col("node_id").alias("page_id"), "dir")
    return hits.join(dirs, ["space_id", "page_id"], "left").select("space_id", "page_id", F.coalesce("dir", "title").alias("place"))
