"""One digest over all that a written page depends on; scope is no part of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONVERTER_VERSION = 1


@dataclass(frozen=True)
class Options:
    include_html: bool = False
    media: bool = True
    render_drawio: bool = True
    site_url: str = ""
    author_lookup: bool = True
    converter_version: int = CONVERTER_VERSION


def page_fingerprints(pages: DataFrame, named: DataFrame, digests: DataFrame, pngs: DataFrame, authors: DataFrame, options: Options = Options()) -> DataFrame:
    """space_id, page_id, fingerprint.

    pages: version; named: att_id, version, local_name by page; digests: of bodies; pngs: page_id, png_digest; authors: as author_resolution gives.
    """
    atts = named.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("att_id", "version", "local_name"))).alias("atts"))
    used = pngs.groupBy("page_id").agg(F.sort_array(F.collect_list("png_digest")).alias("pngs"))
    rows = pages.select("space_id", "page_id", "version").join(digests.select("space_id", "page_id", "digest"), ["space_id", "page_id"], "left").join(atts, "page_id", "left").join(used, "page_id", "left").join(authors, ["space_id", "page_id"], "left")
    flags = [F.lit(getattr(options, f)).alias(f) for f in ("converter_version", "include_html", "media", "render_drawio", "site_url")]
    content = F.struct("version", *flags, F.coalesce("atts", F.array().cast(atts.schema["atts"].dataType)).alias("atts"), F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("pngs", F.array().cast("array<string>")).alias("pngs"), F.lit(options.author_lookup).alias("author_lookup"), F.col("authors").alias("authors"))
    return rows.select("space_id", "page_id", F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
