"""The converter and its companions as Spark jobs: one Arrow pass over pages each, no look-ups inside."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.names import heading_text, safe_attachment_name
from leafmill.functions.render import page as P
from leafmill.functions.render.tree import Node, parse
from leafmill.lineage import stored
from leafmill.operators.attachments import match_diagram, resolve_refs


def wide(pages: DataFrame, named: DataFrame | None = None, available: DataFrame | None = None, users: DataFrame | None = None, rendered: DataFrame | None = None, *, order: str = "ord") -> DataFrame:
    """One row per page with all that its rendering needs: heading, files, listed, available, users, diagrams.

    What references and diagrams in a body mean is joined here (resolve_refs, match_diagram), not looked up while rendering.
    rendered: page_id, xml_title, local_name of diagrams that can be shown.
    """
    rows = pages.select("space_id", "page_id", heading_text(F.coalesce("title", F.lit(""))).alias("heading"), "body")
    kinds = {"files": "array<struct<name:string,att_id:string,local:string>>", "listed": "array<struct<title:string,local:string>>", "available": "array<string>", "users": "array<struct<account_id:string,name:string>>", "diagrams": "array<struct<name:string,picture:string,source:string>>"}
    if named is not None:
        # Only elements of these names make such references, in whatever case they are written.
        some = F.lower("body").rlike("ri:attachment|ac:structured-macro|ac:adf-extension")
        refs = stored(extract_refs(pages.where(some)).where("kind in ('attachment', 'diagram')").select("page_id", "kind", "name", "att_id").distinct())
        files = resolve_refs(refs.where("kind = 'attachment'").select("page_id", F.col("name").alias("title"), "att_id"), named)
        rows = rows.join(files.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("title").alias("name"), "att_id", F.col("local_name").alias("local")))).alias("files")), "page_id", "left")
        rows = rows.join(named.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("att_id", "title", "local_name"))), lambda a: F.struct(a["title"].alias("title"), a["local_name"].alias("local"))).alias("listed")), "page_id", "left")
        meant = match_diagram(refs.where("kind = 'diagram'").select("page_id", "name"), named, order)
        source = named.select("page_id", "att_id", "title", F.col("local_name").alias("_source")).dropDuplicates(["page_id", "att_id", "title"])
        meant = meant.join(source, ["page_id", "att_id", "title"], "left").withColumn("_source", F.coalesce("_source", safe_attachment_name(F.concat(F.regexp_replace("name", r"\.drawio$", ""), F.lit(".drawio")))))
        picture = rendered.groupBy("page_id", F.col("xml_title").alias("title")).agg(F.min("local_name").alias("_picture")) if rendered is not None else source.select("page_id", "title", F.lit("").alias("_picture")).limit(0)
        meant = meant.join(picture, ["page_id", "title"], "left")
        rows = rows.join(meant.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("name", F.coalesce("_picture", F.lit("")).alias("picture"), F.col("_source").alias("source")))).alias("diagrams")), "page_id", "left")
    if available is not None:
        rows = rows.join(available.select("page_id", F.col("names").alias("available")), "page_id", "left")
    if users is not None:
        rows = rows.join(users.select("space_id", "page_id", F.transform(F.map_entries("users"), lambda e: F.struct(e["key"].alias("account_id"), e["value"].alias("name"))).alias("users")), ["space_id", "page_id"], "left")
    return rows.select("space_id", "page_id", "heading", "body", *[F.coalesce(F.col(c), F.array().cast(k)).alias(c) if c in rows.columns else F.array().cast(k).alias(c) for c, k in kinds.items()])


def render_markdown(rows: DataFrame, *, plug_ins: dict[str, P.Handler] | None = None) -> DataFrame:
    """space_id, page_id, markdown, warnings of wide rows. plug_ins: handlers by macro name, of this run only, before the own ones.

    A page that a handler fails on has no markdown and says why in its warnings. Rows are dealt to tasks anew, as bodies
    often come in few files.
    """
    own = dict(plug_ins or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, warned = [], []
            for heading, body, known in zip(frame["heading"], frame["body"], frame["known"], strict=True):
                r = json.loads(known) if known else {}
                page = P.Page(
                    {(f["name"], f["att_id"]): f["local"] for f in r.get("files") or []},
                    [(a["title"], a["local"]) for a in r.get("listed") or []],
                    frozenset(r.get("available") or []),
                    {u["account_id"]: u["name"] for u in r.get("users") or []},
                    {d["name"]: (d["picture"], d["source"]) for d in r.get("diagrams") or []},
                    own,
                )
                try:
                    text = P.render(heading or "", body or "", page)
                    texts.append(text)
                    warned.append(sorted({f"missing attachment: {m}" for m in re.findall(r"Missing attachment: ([^\n]*)", text)}) if "Missing attachment: " in text else [])
                except Exception as e:  # noqa: BLE001  (a plug-in may raise anything; the page's row says so)
                    texts.append("")
                    warned.append([f"not rendered: {type(e).__name__}: {e}"])
            yield pd.DataFrame({"space_id": frame["space_id"], "page_id": frame["page_id"], "markdown": texts, "warnings": warned})

    kinds = ("files", "listed", "available", "users", "diagrams")
    # Nested columns cost a page's row more than its rendering, even where they are empty; so they come as one text.
    known = F.to_json(F.struct(*kinds), {"ignoreNullFields": "false"})
    some = F.lit(False)
    for kind in kinds:
        some = some | (F.size(kind) > 0)
    dealt = rows.repartition("space_id", "page_id").select("space_id", "page_id", "heading", "body", F.when(some, known).alias("known"))
    return dealt.mapInPandas(run, "space_id string, page_id string, markdown string, warnings array<string>")


def _rows(pages: DataFrame, find: Callable[[Node], list[tuple]], schema: str) -> DataFrame:
    # Fields of a struct have no space between them.
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(s, p, n, *row) for s, p, body in zip(frame["space_id"], frame["page_id"], frame["body"], strict=True) for n, row in enumerate(find(parse(body or "")))]
            yield pd.DataFrame(out, columns=["space_id", "page_id", "n", *names])

    return pages.select("space_id", "page_id", "body").mapInPandas(run, f"space_id string, page_id string, n long, {schema}")


def _below(root: Node, state: object, step: Callable[[Node, object], object]) -> None:
    """Calls step(node, state) for all nodes below in document order; what it returns is the state of the node's children."""
    waiting = [(k, state) for k in reversed(root.elements())]
    while waiting:
        node, given = waiting.pop()
        own = step(node, given)
        waiting += [(k, own) for k in reversed(node.elements())]


def extract_macros(pages: DataFrame) -> DataFrame:
    """One row per macro in document order: name, own parameters, whether it has a rich body, plain body, depth among macros."""

    def find(root: Node) -> list[tuple]:
        out = []

        def step(node: Node, depth: int) -> int:
            if node.tag not in P.MACROS:
                return depth
            m = P.Macro(node)
            out.append((m.name, sorted((a, b) for a, b in m.params.items() if a), m.rich is not None, m.plain, depth))
            return depth + 1

        _below(root, 0, step)
        return out

    rows = _rows(pages, find, "name string, params array<struct<k:string,v:string>>, has_rich_body boolean, plain_body string, depth long")
    return rows.withColumn("params", F.map_from_entries("params"))


def extract_refs(pages: DataFrame) -> DataFrame:
    """One row per reference: kind (attachment, diagram, page, url, user, link), what it names, the attachment id, whether it is an image's."""
    #: Elements that are references, with their kind and the attribute that names what they mean.
    kinds = {"ri:page": ("page", "ri:content-title"), "ri:url": ("url", "ri:value"), "ri:user": ("user", "ri:account-id"), "a": ("link", "href")}

    def find(root: Node) -> list[tuple]:
        out = []

        def step(node: Node, image: bool) -> bool:
            if node.tag == "ri:attachment":
                out.append(("attachment", *P.reference(node), image))
            elif node.tag in kinds and (node.tag != "a" or node.get("href")):
                out.append((kinds[node.tag][0], node.get(kinds[node.tag][1]), "", image))
            elif node.tag in P.MACROS and node.get("ac:name") in (*P.FILES, *P.DIAGRAMS):
                macro = P.Macro(node)
                if macro.name in P.DIAGRAMS:
                    out.append(("diagram", macro.diagram(), "", image))
                elif macro.node.find("ri:attachment") is None and macro.file()[0]:
                    out.append(("attachment", *macro.file(), image))
            return image or node.tag == "ac:image"

        _below(root, False, step)
        return out

    return _rows(pages, find, "kind string, name string, att_id string, image boolean")


def extract_tasks(pages: DataFrame) -> DataFrame:
    """One row per task or decision: kind, whether it is done, its own text, depth among lists."""

    def own(node: Node) -> str:
        """Its text without that of lists, states and ids in it."""
        out, waiting = [], node.kids[::-1]
        while waiting:
            k = waiting.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in ("ac:task-list", "ac:task-status", "ac:task-id") and k.get("type") not in P.DECISION_LISTS:
                waiting += k.kids[::-1]
        return "".join(out).strip()

    def find(root: Node) -> list[tuple]:
        out = []

        def step(node: Node, depth: int) -> int:
            if node.tag == "ac:task":
                status = node.child("ac:task-status")
                out.append(("task", status is not None and status.text().strip() == "complete", own(node), depth))
            elif node.get("type") in P.DECISION_ITEMS:
                out.append(("decision", node.get("state").strip().upper() == "DECIDED", own(node), depth))
            return depth + (node.tag == "ac:task-list" or node.get("type") in P.DECISION_LISTS)

        _below(root, -1, step)
        return out

    return _rows(pages, find, "kind string, done boolean, text string, depth long")


#: Words that YAML reads as truth values or nothing; letters of which no number and no time is made.
RESERVED, WORDY = ("yes", "no", "true", "false", "on", "off", "null", "y", "n"), "[G-SU-WYg-suvwy]"
#: Texts with blanks are folded in lines of more than eighty characters; shorter ones than this never are.
UNFOLDED = 50


def _yaml(value: Column) -> Column:
    """A text as the library writes it; null for one that it may quote, escape or fold in another way."""
    plain = value.rlike(r"^\p{L}[\p{L}\p{N}_./+ -]*+\z") & ~F.lower(value).isin(*RESERVED)
    # What begins with a digit may be a number or a time, but for letters that these don't have.
    plain = plain | (value.rlike(r"^[0-9][\p{L}\p{N}_./+ -]*+\z") & value.rlike(WORDY))
    plain = plain & ~value.endswith(" ") & ((F.char_length(value) <= UNFOLDED) | ~F.contains(value, F.lit(" ")))
    plain = plain | value.rlike(r"^https?://[\p{L}\p{N}_./?=&%~+:-]*[\p{L}\p{N}_/]\z")
    quoted = value.rlike(r"^(?:0|[1-9][0-9]*+|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?)?|)\z")
    return F.when(plain, value).when(quoted, F.concat(F.lit("'"), value, F.lit("'")))


def frontmatter(pages: DataFrame) -> DataFrame:
    """Adds frontmatter, a YAML block, to rows with title, page_id, space_key, path, url, last_modified, version, status, attachments (name, type, size).

    Blocks of texts that YAML leaves as they are, or only puts between quotes, are put together here; the others are the library's.
    """
    texts = ["title", "page_id", "space_key", "path", "url", "last_modified"]

    def run(rows: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(rows)
        for at in rows.notna().to_numpy().nonzero()[0]:
            import yaml

            r = json.loads(rows.iloc[at])
            block = {k: r.get(k) for k in texts} | {"version": int(r["version"])}
            if r.get("status") == "archived":
                block["status"] = "archived"
            if r["attachments"]:
                block["attachments"] = [{"name": a.get("name"), "type": a.get("type"), "size": int(a["size"])} for a in r["attachments"]]
            out[at] = "---\n" + yaml.safe_dump(block, sort_keys=False, allow_unicode=True, default_flow_style=False) + "---\n\n"
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    # A join of texts leaves out nulls, so they are looked for.
    files = F.transform("attachments", lambda a: F.concat(line("- name", _yaml(a["name"])), line("  type", _yaml(a["type"])), line("  size", a["size"].cast("bigint").cast("string"))))
    files = F.when(F.size("attachments") == 0, "").when(~F.exists(files, lambda f: f.isNull()), F.concat(F.lit("attachments:\n"), F.array_join(files, "")))
    status = F.when(F.col("status") == "archived", F.lit("status: archived\n")).otherwise("")
    block = F.concat(F.lit("---\n"), *[line(c, _yaml(F.col(c))) for c in texts], line("version", F.col("version").cast("bigint").cast("string")), status, files, F.lit("---\n\n"))
    # Python gets the open ones only, in one column, as each column costs something in every row.
    given = F.when(F.col("_block").isNull(), F.to_json(F.struct(*texts, "version", "status", "attachments")))
    return pages.withColumn("_block", block).withColumn("frontmatter", F.coalesce("_block", F.pandas_udf(run, "string")(given))).drop("_block")


def documents(rows: DataFrame) -> DataFrame:
    """space_id, rel_path, content of pages with file, frontmatter and markdown."""
    content: Column = F.concat("frontmatter", "markdown", F.lit("\n"))
    return rows.select("space_id", F.col("file").alias("rel_path"), content.alias("content"))
