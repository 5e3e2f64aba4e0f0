"""Bodies and authors: content addresses, carried digests, who a page refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def needs_body(pages: DataFrame) -> DataFrame:
    return pages.where("body = ''")


def store_bodies(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages without bodies, body_blobs, and each distinct body once as (digest, size, content)."""
    digest = F.sha2(F.encode("body", "UTF-8"), 256)
    full = pages.where("body <> ''")
    links = full.select("space_id", "page_id", digest.alias("digest"))
    return pages.withColumn("body", F.lit("")), links, dedup_blobs(full.select(digest.alias("digest"), F.encode("body", "UTF-8").alias("content")))


def dedup_blobs(blobs: DataFrame) -> DataFrame:
    """digest, size, content: one row per digest."""
    return blobs.dropDuplicates(["digest"]).select("digest", F.length("content").cast("long").alias("size"), "content")


def carry_failed_bodies(failed: DataFrame, previous: DataFrame, blobs: DataFrame) -> DataFrame:
    """Digests for pages whose body could not be had: the previous one if its bytes are there, else the empty body's."""
    usable = previous.join(blobs.select("digest"), "digest", "left_semi").select("space_id", "page_id", "digest")
    return failed.select("space_id", "page_id").join(usable, ["space_id", "page_id"], "left").withColumn("digest", F.coalesce("digest", F.lit(EMPTY)))


def author_ids(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Distinct authors of pages and attachments."""
    return pages.select("author").unionByName(attachments.select("author")).where("author <> ''").distinct()


def mentions(pages: DataFrame) -> DataFrame:
    """space_id, page_id, account_id of each mention in a body, in order and with repeats."""
    return pages.select("space_id", "page_id", F.posexplode(F.regexp_extract_all("body", F.lit('account-id="([^"]+)"'))).alias("n", "account_id"))


def author_resolution(pages: DataFrame, users: DataFrame, *, lookup: bool = True) -> DataFrame:
    """space_id, page_id, authors: sorted (id, name or '') of a page's author and all it mentions; none with lookup off."""
    whom = mentions(pages).select("space_id", "page_id", "account_id").unionByName(pages.where("author <> ''").select("space_id", "page_id", F.col("author").alias("account_id"))).distinct()
    named = (whom if lookup else whom.where(F.lit(False))).join(users, "account_id", "left")
    sets = named.groupBy("space_id", "page_id").agg(F.array_sort(F.collect_set(F.struct("account_id", F.coalesce("display_name", F.lit("")).alias("name")))).alias("authors"))
    return pages.select("space_id", "page_id").join(sets, ["space_id", "page_id"], "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<struct<account_id:string,name:string>>")))


def resolve_users(found: DataFrame, users: DataFrame) -> DataFrame:
    """space_id, page_id, users: map of account id to name ('' if unknown) for the renderer."""
    named = found.select("space_id", "page_id", "account_id").distinct().join(users, "account_id", "left")
    return named.groupBy("space_id", "page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("account_id", F.coalesce("display_name", F.lit("")).alias("name"))))).alias("users"))


def completeness(listings: DataFrame) -> DataFrame:
    """space_id, complete: all listings and downloads of a space went well; true for none."""
    return listings.groupBy("space_id").agg(F.coalesce(F.bool_and(F.col("listed") & F.col("downloaded")), F.lit(True)).alias("complete"))


def latest_versions(edits: DataFrame) -> DataFrame:
    """Of edits (page_id, number, created_at, author_id), each page's last."""
    return edits.groupBy("page_id").agg(F.max(F.struct("number", "created_at", "author_id")).alias("version")).select("page_id", "version.*")
