"""Attachments: which count, what they are called on disk, which diagram belongs to which preview, what must be fetched."""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.functions.names import fold, nfc_casefold, parse_mtime, safe_attachment_name, with_token
from leafmill.lineage import stored
from leafmill.operators.groups import add_column

#: Version of the renderer in cache keys, target font and edge of a rendering in pixels, bounds of downloads.
RENDER_VERSION, FONT, DEFAULT_FONT, MOST_SCALE, LONGEST_EDGE = 2, 14.0, 12.0, 3, 12000
#: Rounds in which names are asked for before what is left is named one after another.
ROUNDS = 24
LEAST_CAP, UNSIZED_CAP = 256 * 1024**2, 8 * 1024**3


def packed(digest: Column | str) -> Column:
    """A digest as bytes: 64 hex digits take half as much in shuffles. Different digests stay different."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    # Others are longer than the 32 bytes of these.
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.unhex(digest)).otherwise(F.encode(F.concat(digest, F.lit("#" * 64)), "UTF-8"))


def unpacked(key: Column | str) -> Column:
    """The digest that packed was given."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.decode(key, "UTF-8")
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(F.substring(text, F.lit(1), F.char_length(text) - 64))


def drop_noise(atts: DataFrame) -> DataFrame:
    """Without editors' lock and temporary files."""
    title = F.trim("title")
    return atts.where(~(title.startswith("~$") | (title.startswith("~") & title.endswith(".tmp"))))


def first_seen(atts: DataFrame, order: str = "ord") -> DataFrame:
    """Of rows of a page with one att_id, the first listed; rows without an id all stay."""
    nth = F.row_number().over(W.partitionBy("page_id", "att_id").orderBy(order))
    return atts.withColumn("_n", F.when(F.col("att_id") == "", 1).otherwise(nth)).where("_n = 1").drop("_n")


def _page_names(rows: list) -> list[str]:
    """Names of one page on which some titles collide, its rows by base and age: later ones get a mark of their owner, tried until it is free."""
    taken, out, before = {r.base_key for r in rows}, [], None
    for r in rows:
        name, retry = r.base, 0
        while r.base_key == before and (retry == 0 or fold(name) in taken):
            name = with_token(r.base, r.att_id or r.title or "attachment", retry)
            if fold(name) not in taken:
                break
            retry += 1
        taken.add(fold(name))
        before = r.base_key
        out.append(name)
    return out


def _token_names(base: Column, owner: Column, retry: Column) -> Column:
    """Names with their owner's mark."""

    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([with_token(b, o, int(k)) for b, o, k in zip(frame["base"], frame["owner"], frame["retry"], strict=True)], dtype=object)

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.struct(base.alias("base"), owner.alias("owner"), retry.alias("retry")))


def plan_names(atts: DataFrame, order: str = "ord", *, rounds: int = ROUNDS, seen: bool = False) -> DataFrame:
    """Adds local_name: one per attachment and page, unique without regard to case; the earliest keeps its title's name.

    seen: atts are as first_seen gives them.

    The others are named in rounds, all of them at once: each asks for its base name with a mark of its owner, a name that is
    a base name on the page is never given, of those that ask for another the first in order has it, and who is turned down
    (also later on, by one before it) asks for its next name. When nobody is, each has the first name of its own that none
    before it has, just as if they had been named one after another. Rows with equal marks begin at different names. Pages
    still open after some rounds are named one after another, in one task a page.
    """
    rows = (atts if seen else first_seen(atts, order)).withColumn("base", safe_attachment_name(F.col("title")))
    # Ids are a page's own, so only rows without one are told apart by their places.
    place = F.when(F.col("att_id") == "", F.col(order).cast("string")).otherwise("")
    rows = rows.withColumns({"base_key": nfc_casefold("base"), "folded": nfc_casefold("title"), "place": place})
    line = ["created_at", "folded", "att_id", "place"]
    rows = stored(rows.withColumn("_nth", F.row_number().over(W.partitionBy("page_id", "base_key").orderBy(*line))))
    first = rows.where("_nth = 1").withColumn("local_name", F.col("base")).drop("_nth")
    owner = F.coalesce(F.nullif("att_id", F.lit("")), F.nullif("title", F.lit("")), F.lit("attachment"))
    rest = rows.where("_nth > 1").drop("_nth").withColumn("_owner", owner)
    rest = rest.withColumn("_try", F.row_number().over(W.partitionBy("page_id", "base", "_owner").orderBy("base_key", *line)) - 1)
    asking = stored(rest.withColumn("_line", F.struct("base_key", *line)))
    if asking.limit(1).count() == 0:
        return first.drop("base", "base_key", "place")
    # Each base name once, of pages on which one asks.
    reserved = rows.where("_nth = 1").select("page_id", F.col("base_key").alias("_key")).join(asking.select("page_id").distinct(), "page_id", "left_semi")
    reserved = stored(reserved.withColumn("_reserved", F.lit(True)))
    for k in range(rounds):
        asked = asking.withColumn("local_name", _token_names(F.col("base"), F.col("_owner"), F.col("_try"))).withColumn("_key", nfc_casefold("local_name"))
        asked = stored(asked)
        has = asked.groupBy("page_id", "_key").agg(F.min("_line").alias("_has"))
        told = asked.join(has, ["page_id", "_key"]).join(reserved, ["page_id", "_key"], "left")
        told = stored(told.withColumn("_lost", F.coalesce("_reserved", F.lit(False)) | (F.col("_has") != F.col("_line"))).drop("_has", "_reserved"))
        open_ = told.where("_lost").select("page_id").distinct()
        if open_.limit(1).count() == 0:
            break
        asking = told.withColumn("_try", F.col("_try") + F.col("_lost").cast("int")).drop("local_name", "_key", "_lost")
    else:
        slow = rows.drop("_nth").join(open_, "page_id", "left_semi")
        slow = add_column(slow, ["page_id"], ["base_key", *line], "local_name", _page_names)
        first, told = first.join(open_, "page_id", "left_anti").unionByName(slow), told.join(open_, "page_id", "left_anti")
    return first.unionByName(told.select(*first.columns)).drop("base", "base_key", "place")


def unambiguous_fold(named: DataFrame) -> DataFrame:
    """Adds fold_unique: the folded title is this attachment's alone on its page."""
    return named.withColumn("fold_unique", F.count("*").over(W.partitionBy("page_id", "folded")) == 1)


def resolve_refs(refs: DataFrame, named: DataFrame) -> DataFrame:
    """Adds local_name to references (page_id, att_id, title): by id, by title, by unambiguous folded title, else the title made safe."""
    by_id = named.where("att_id <> ''").select("page_id", "att_id", F.col("local_name").alias("_id"))
    # Equal titles fold alike, so both look-ups by title are one, in which rows meet once.
    titles = named.where("title is not null").select("page_id", "folded", "title", F.struct("created_at", "att_id", "local_name").alias("_who")).repartition("page_id", "folded")
    titles = titles.groupBy("page_id", "folded", "title").agg(F.min("_who")["local_name"].alias("_name"), F.count("*").alias("_rows"))
    titles = titles.groupBy("page_id", "folded").agg(F.map_from_entries(F.collect_list(F.struct("title", "_name"))).alias("_titles"), F.when(F.sum("_rows") == 1, F.min("_name")).alias("_fold"))
    rows = refs.withColumn("folded", nfc_casefold("title")).join(by_id, ["page_id", "att_id"], "left").join(titles, ["page_id", "folded"], "left")
    return rows.withColumn("local_name", F.coalesce("_id", F.col("_titles")[F.col("title")], "_fold", safe_attachment_name(F.col("title")))).drop("_id", "_titles", "_fold", "folded")


def is_diagram() -> Column:
    return F.col("folded").endswith(".drawio") | F.contains(F.lower("media_type"), F.lit("drawio"))


def drawio_pairs(atts: DataFrame, order: str = "ord") -> DataFrame:
    """Each diagram with its preview (image of the same title and .png; the last listed wins) and whether that is as new.

    page_id, xml_id, xml_title, xml_version, png_id, png_version, preview_fresh, xml_ord.
    """
    rows = atts.withColumn("folded", nfc_casefold("title"))
    xml = rows.where(is_diagram()).select("page_id", F.col("att_id").alias("xml_id"), F.col("title").alias("xml_title"), F.col("version").alias("xml_version"), F.col("created_at").alias("xml_at"), F.concat("folded", F.lit(".png")).alias("key"), F.col(order).alias("xml_ord"))
    png = rows.where((F.col("media_type") == "image/png") & ~is_diagram()).withColumn("_n", F.row_number().over(W.partitionBy("page_id", "folded").orderBy(F.desc(order)))).where("_n = 1")
    png = png.select("page_id", F.col("folded").alias("key"), F.col("att_id").alias("png_id"), F.col("version").alias("png_version"), F.col("created_at").alias("png_at"))
    fresh = F.coalesce(F.coalesce(parse_mtime(F.col("png_at")), F.lit(0.0)) >= F.coalesce(parse_mtime(F.col("xml_at")), F.lit(0.0)), F.lit(False))
    pairs = xml.join(png, ["page_id", "key"], "left")
    return pairs.withColumn("preview_fresh", F.col("png_id").isNotNull() & fresh).drop("key", "xml_at", "png_at")


def match_diagram(refs: DataFrame, atts: DataFrame, order: str = "ord") -> DataFrame:
    """For references (page_id, name): the diagram meant, as att_id and title; null if none."""
    bare = F.regexp_replace("name", r"\.drawio$", "")
    squeeze = lambda c: F.regexp_replace(nfc_casefold(F.regexp_replace(F.trim(c), r"\s+", " ")), r"\.drawio$", "")
    diagrams = atts.withColumn("folded", nfc_casefold("title")).where(is_diagram()).select("page_id", "att_id", F.col("title").alias("found"), F.col(order).alias("_ord")).withColumn("squeezed", squeeze(F.col("found")))
    # An exact title goes by the last listed of that title, the squeezed one by the first.
    exact = F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("name").alias("key")), F.struct(F.lit(2).alias("rank"), F.concat(bare, F.lit(".drawio")).alias("key")), F.struct(F.lit(3).alias("rank"), bare.alias("key"))))
    wanted = refs.select("page_id", "name").distinct()
    tries = wanted.withColumn("t", exact).select("page_id", "name", "t.rank", F.col("t.key").alias("found")).join(diagrams, ["page_id", "found"])
    ranked = tries.select("page_id", "name", F.struct("rank", (-F.col("_ord")).alias("o"), "att_id", "found").alias("c"))
    loose = wanted.withColumn("squeezed", squeeze(F.col("name"))).join(diagrams, ["page_id", "squeezed"]).select("page_id", "name", F.struct(F.lit(4).alias("rank"), F.col("_ord").alias("o"), "att_id", "found").alias("c"))
    best = ranked.unionByName(loose).groupBy("page_id", "name").agg(F.min("c").alias("c"))
    return refs.join(best, ["page_id", "name"], "left").select(*refs.columns, F.col("c.att_id").alias("att_id"), F.col("c.found").alias("title"))


def incremental(atts: DataFrame, known: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds digest (reused) and status: 'reuse' where (att_id, version) was there before and its bytes still are, else 'fetch'."""
    usable = known.select("att_id", "version", packed("digest").alias("_key")).join(blobs.select(packed("digest").alias("_key")), "_key", "left_semi").dropDuplicates(["att_id", "version"])
    return atts.join(usable, ["att_id", "version"], "left").withColumn("digest", unpacked("_key")).drop("_key").withColumn("status", F.when(F.col("digest").isNull(), "fetch").otherwise("reuse"))


def download_plan(atts: DataFrame, base: str) -> DataFrame:
    """Of attachments to fetch: url ('' is reported and skipped) and the most bytes to take."""
    dl = F.coalesce("download_url", F.lit(""))
    origin = F.try_parse_url(F.lit(base), F.lit("HOST"))
    rest = F.concat(F.lit(base + "/wiki/rest/api/content/"), "page_id", F.lit("/child/attachment/"), "att_id", F.lit("/download"))
    site = F.concat(F.lit(base), F.when(dl.startswith("/wiki"), dl).otherwise(F.concat(F.lit("/wiki"), dl)))
    own = dl.startswith("https://") & F.coalesce(F.try_parse_url(dl, F.lit("HOST")) == origin, F.lit(False))
    url = F.when((F.col("page_id") != "") & (F.col("att_id") != ""), rest).when(dl == "", "").when(dl.rlike("^https?://"), F.when(own, dl).otherwise("")).otherwise(site)
    cap = F.when(F.col("file_size") > 0, F.greatest(F.col("file_size") * 2, F.lit(LEAST_CAP))).otherwise(F.lit(UNSIZED_CAP))
    return atts.select("page_id", "att_id", "version", url.alias("url"), cap.cast("long").alias("cap"))


def _cached(derived: DataFrame, blobs: DataFrame, version: int) -> DataFrame:
    """xml_key and png_key (packed) of renderings of a version whose bytes are there."""
    rows = derived.where(F.col("render_version") == version).select(packed("xml_digest").alias("xml_key"), packed("png_digest").alias("png_key"))
    return rows.join(blobs.select(packed("digest").alias("png_key")), "png_key", "left_semi")


def _keys(digests: DataFrame) -> DataFrame:
    """att_id, version, key: one packed digest each."""
    return digests.select("att_id", "version", packed("digest").alias("key")).dropDuplicates(["att_id", "version"])


def render_queue(pairs: DataFrame, digests: DataFrame, derived: DataFrame, blobs: DataFrame, version: int = RENDER_VERSION) -> DataFrame:
    """xml_digest of diagrams without a fresh preview or a cached rendering, each once."""
    xml = _keys(digests).select(F.col("att_id").alias("xml_id"), F.col("version").alias("xml_version"), F.col("key").alias("xml_key"))
    rows = pairs.where("not preview_fresh").select("xml_id", "xml_version").join(xml, ["xml_id", "xml_version"]).select("xml_key")
    return rows.join(_cached(derived, blobs, version).select("xml_key"), "xml_key", "left_anti").distinct().select(unpacked("xml_key").alias("xml_digest"))


def rendered_media(pairs: DataFrame, named: DataFrame, digests: DataFrame, derived: DataFrame, blobs: DataFrame, version: int = RENDER_VERSION) -> DataFrame:
    """page_id, xml_title, local_name, png_digest (null: the file is an attachment) of each diagram that can be shown.

    A fresh preview is shown if its bytes are there, else the cached rendering of the diagram's bytes; so of each pair one
    attachment's bytes are asked for, and what has none goes no further.
    """
    of = lambda c: F.when(F.col("preview_fresh"), F.col(f"png_{c}")).otherwise(F.col(f"xml_{c}"))
    wanted = pairs.select("page_id", "xml_title", "png_id", "preview_fresh", of("id").alias("att_id"), of("version").alias("version"))
    rows = stored(wanted.join(_keys(digests).where("key is not null"), ["att_id", "version"]).drop("att_id", "version"))
    names = named.select("page_id", F.col("att_id").alias("png_id"), "local_name").dropDuplicates(["page_id", "png_id"])
    fresh = rows.where("preview_fresh").join(names, ["page_id", "png_id"]).select("page_id", "xml_title", "local_name", F.lit(None).cast("binary").alias("png_key"))
    cached = _cached(derived, blobs, version).dropDuplicates(["xml_key"])
    made = rows.where("not preview_fresh").withColumnRenamed("key", "xml_key").join(cached, "xml_key").drop("xml_key")
    stem = F.regexp_replace("xml_title", r"\.[^.]*$", "")
    made = made.withColumn("plain", safe_attachment_name(F.concat(stem, F.lit(".png")))).withColumn("marked", safe_attachment_name(F.concat(stem, F.lit("-rendered.png"))))
    # The plain name may already be another attachment's.
    owner = named.select("page_id", F.col("local_name").alias("plain"), F.col("att_id").alias("_owner")).groupBy("page_id", "plain").agg(F.collect_set("_owner").alias("_owners"))
    made = made.join(owner, ["page_id", "plain"], "left")
    used = F.size(F.array_except(F.coalesce("_owners", F.array().cast("array<string>")), F.array(F.coalesce("png_id", F.lit(""))))) > 0
    made = made.select("page_id", "xml_title", F.when(used, F.col("marked")).otherwise(F.col("plain")).alias("local_name"), "png_key")
    return fresh.unionByName(made).where("local_name is not null").withColumn("png_digest", unpacked("png_key")).drop("png_key")


def available_media(named: DataFrame, digests: DataFrame, rendered: DataFrame, *, media: bool = True, carried: DataFrame | None = None) -> DataFrame:
    """page_id, names: sorted file names that a rendered page may link to. carried: page_id, file of states carried on from an incomplete listing."""
    have = named.join(digests.select("att_id", "version").distinct(), ["att_id", "version"], "left_semi").select("page_id", "local_name")
    names = have.unionByName(rendered.select("page_id", "local_name"))
    if carried is not None:
        names = names.unionByName(carried.where("file <> ''").select("page_id", F.col("file").alias("local_name")))
    return (names if media else names.where(F.lit(False))).groupBy("page_id").agg(F.array_sort(F.collect_set("local_name")).alias("names"))


def media_manifest(named: DataFrame, placed: DataFrame, digests: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """page_id, path, digest, mtime of each attachment whose bytes are there, and of each rendering that isn't one (its mtime is null)."""
    dirs = placed.where("kind = 'page'").select(F.col("node_id").alias("page_id"), "dir")
    files = named.select("page_id", "att_id", "version", "local_name", "created_at").join(_keys(digests), ["att_id", "version"]).select("page_id", "local_name", "key", parse_mtime(F.col("created_at")).alias("mtime"))
    if rendered is not None:
        # Of diagrams of one title on a page, one rendering stands under the name.
        made = rendered.where("png_digest is not null").groupBy("page_id", "local_name").agg(packed(F.min("png_digest")).alias("key"))
        files = files.unionByName(made.withColumn("mtime", F.lit(None).cast("double")))
    return files.join(dirs, "page_id").select("page_id", F.concat("dir", F.lit("/.media/"), "local_name").alias("path"), unpacked("key").alias("digest"), "mtime")


def decode_diagram(content: bytes) -> str:
    """A diagram file's text and, behind it, what its compressed parts hold."""
    text = content.decode("utf-8", "replace")
    out = [text]
    for payload in re.findall(r"<diagram\b[^>]*>([^<]+)</diagram>", text):
        try:
            out.append(urllib.parse.unquote(zlib.decompress(base64.b64decode(payload.strip()), -15).decode("utf-8", "replace")))
        except (binascii.Error, zlib.error, ValueError):
            continue
    return "\n".join(out)


def inflate_diagram(content: Column | str) -> Column:
    """decode_diagram of a binary column; Spark has no inflate.

    Not in Arrow batches: a hundred files are in a worker's memory at once, and not as many as 64 MB hold, which inflate to many times that.
    """

    def run(value: bytes | None) -> str | None:
        return None if value is None else decode_diagram(bytes(value))

    return F.udf(run, "string", useArrow=False)(content)


def render_scale(model: Column) -> Column:
    """1 to 3: how much larger than life a diagram must be drawn for its smallest letters, within the longest edge."""
    fonts = F.filter(F.transform(F.regexp_extract_all(model, F.lit(r"fontSize=([0-9]+(?:\.[0-9]+)?)")), lambda s: s.cast("double")), lambda s: s >= 2.0)
    font = F.coalesce(F.array_min(fonts), F.lit(DEFAULT_FONT))
    attr = lambda tag, name: F.try_to_number(F.nullif(F.regexp_extract(tag, rf'\b{name}="(-?[0-9.]+)"', 1), F.lit("")), F.lit("S999999999.999999")).cast("double")
    boxes = F.filter(F.transform(F.regexp_extract_all(model, F.lit(r"<mxGeometry\b[^>]*>"), F.lit(0)), lambda t: F.struct(F.coalesce(attr(t, "x"), F.lit(0.0)).alias("x"), F.coalesce(attr(t, "y"), F.lit(0.0)).alias("y"), attr(t, "width").alias("w"), attr(t, "height").alias("h"))), lambda b: b["w"].isNotNull() & b["h"].isNotNull())
    span = lambda at, size: F.array_max(F.flatten(F.transform(boxes, lambda b: F.array(b[at], b[at] + b[size])))) - F.array_min(F.flatten(F.transform(boxes, lambda b: F.array(b[at], b[at] + b[size]))))
    edge = F.coalesce(F.greatest(span("x", "w"), span("y", "h")), F.lit(0.0))
    scale = F.greatest(F.lit(1), F.least(F.lit(MOST_SCALE), F.bround(F.lit(FONT) / font).cast("int")))
    return F.greatest(F.lit(1), F.when(edge > 0, F.least(scale, F.floor(F.lit(LONGEST_EDGE) / edge).cast("int"))).otherwise(scale))
