"""Landed listing dumps of both dialects as canonical tables.

Read a dump with an explicit schema (`read_listing`), then map its records. A field that is null, missing or empty falls
through to the next candidate; canonical tables hold no nulls. ord is the place in the listing, where order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.tables import first_filled, normalize

_V2_VERSION = "struct<number:int,createdAt:string,message:string,authorId:string,author:struct<accountId:string>>"
_V1_VERSION = "struct<number:int,createdAt:string,when:string,message:string,by:struct<accountId:string,account_id:string,userKey:string,username:string>>"

#: Record types by listing; ids may be numbers, which a string field takes.
RECORDS = {
    "pages_v2": f"id:string,title:string,spaceId:string,parentId:string,parentType:string,position:int,status:string,body:struct<storage:struct<value:string>>,version:{_V2_VERSION},_links:struct<webui:string>",
    "pages_v1": f"id:string,title:string,status:string,space:struct<id:string>,ancestors:array<struct<id:string>>,extensions:struct<position:string>,body:struct<storage:struct<value:string>>,version:{_V1_VERSION},_links:struct<webui:string>",
    "attachments_v2": f"id:string,title:string,mediaType:string,fileSize:bigint,pageId:string,downloadLink:string,version:{_V2_VERSION},_links:struct<download:string>",
    "attachments_v1": f"id:string,title:string,mediaType:string,metadata:struct<mediaType:string>,extensions:struct<mediaType:string,fileSize:bigint>,container:struct<id:string>,version:{_V1_VERSION},_links:struct<download:string>",
    "folders_v2": "id:string,title:string,parentId:string,parentType:string,position:int",
    "spaces_v2": "id:string,key:string,name:string,type:string,homepageId:string",
    "spaces_v1": "id:string,key:string,name:string,type:string,homepageId:string,homepage:struct<id:string>",
    "users": "accountId:string,displayName:string,publicName:string",
}


def read_listing(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Envelopes below path (one JSON object a line) as records: columns source, r, ord. Null results are none."""
    envelopes = spark.read.schema(f"results array<struct<{RECORDS[kind]}>>, _links struct<next:string>").json(path)
    return records(envelopes.withColumn("source", F.input_file_name()))


def read_landing(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The records below path, and what of it is damaged: space_id, kind, source, lines (that can't be read, or only in part).

    Where folders are named space_id=<id>, damage is that space's and records carry it as well; elsewhere its space is null
    and may be any.
    """
    shape = f"results array<struct<{RECORDS[kind]}>>, _bad string"
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("source", F.input_file_name())
    space = F.col("space_id").cast("string") if "space_id" in lines.columns else F.lit(None).cast("string")
    read = lines.select("source", space.alias("space_id"), F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    damaged = read.where("e._bad is not null").groupBy("space_id", "source").agg(F.count("*").alias("lines")).select("space_id", F.lit(kind).alias("kind"), "source", "lines")
    return records(read.select("source", "space_id", F.col("e.results").alias("results"))), damaged


def records(envelopes: DataFrame) -> DataFrame:
    more = ["space_id"] if "space_id" in envelopes.columns else []
    return envelopes.select("source", *more, F.posexplode("results").alias("at", "r")).select("source", "r", F.col("at").cast("bigint").alias("ord"), *more)


def version_v2(v: Column) -> Column:
    return F.struct(v["number"].alias("number"), first_filled(v["createdAt"]).alias("created_at"), first_filled(v["message"]).alias("message"), first_filled(v["author"]["accountId"], v["authorId"]).alias("author_id"))


def version_v1(v: Column) -> Column:
    by = v["by"]
    return F.struct(v["number"].alias("number"), first_filled(v["createdAt"], v["when"]).alias("created_at"), first_filled(v["message"]).alias("message"), first_filled(by["accountId"], by["account_id"], by["userKey"], by["username"]).alias("author_id"))


def _table(rows: DataFrame, table: str, **columns: Column) -> DataFrame:
    keep = ["ord"] if table in ("pages", "folders", "attachments") else []
    return normalize(rows.select(*keep, *[c.alias(n) for n, c in columns.items()]), table)


def pages_from_v2(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return _table(rows, "pages", space_id=r["spaceId"], page_id=r["id"], title=r["title"], parent_id=r["parentId"], parent_type=r["parentType"], position=r["position"], status=first_filled(r["status"], F.lit("current")), body=r["body"]["storage"]["value"], version=version_v2(r["version"]), web_url=r["_links"]["webui"])


def pages_from_v1(rows: DataFrame) -> DataFrame:
    """The parent is the last ancestor."""
    r = F.col("r")
    parent = first_filled(F.get(r["ancestors"], F.size(r["ancestors"]) - 1)["id"])
    return _table(rows, "pages", space_id=r["space"]["id"], page_id=r["id"], title=r["title"], parent_id=parent, parent_type=F.when(parent != "", "page").otherwise(""), position=r["extensions"]["position"].try_cast("int"), status=first_filled(r["status"], F.lit("current")), body=r["body"]["storage"]["value"], version=version_v1(r["version"]), web_url=r["_links"]["webui"])


def attachments_from_v2(rows: DataFrame, space_id: Column | None = None, page_id: Column | None = None) -> DataFrame:
    r = F.col("r")
    return _table(rows, "attachments", space_id=F.lit("") if space_id is None else space_id, page_id=r["pageId"] if page_id is None else page_id, att_id=r["id"], title=r["title"], media_type=r["mediaType"], file_size=r["fileSize"], download_url=first_filled(r["_links"]["download"], r["downloadLink"]), version=version_v2(r["version"]))


def attachments_from_v1(rows: DataFrame, space_id: Column | None = None, page_id: Column | None = None) -> DataFrame:
    r = F.col("r")
    media = first_filled(r["mediaType"], r["metadata"]["mediaType"], r["extensions"]["mediaType"])
    return _table(rows, "attachments", space_id=F.lit("") if space_id is None else space_id, page_id=r["container"]["id"] if page_id is None else page_id, att_id=r["id"], title=r["title"], media_type=media, file_size=r["extensions"]["fileSize"], download_url=r["_links"]["download"], version=version_v1(r["version"]))


def folders_from_v2(rows: DataFrame, space_id: Column | None = None) -> DataFrame:
    r = F.col("r")
    return _table(rows, "folders", space_id=F.lit("") if space_id is None else space_id, folder_id=r["id"], title=r["title"], parent_id=r["parentId"], parent_type=r["parentType"], position=r["position"])


def spaces_from_v2(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return _table(rows, "spaces", space_id=r["id"], space_key=r["key"], name=r["name"], type=r["type"], homepage_id=r["homepageId"])


def spaces_from_v1(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return _table(rows, "spaces", space_id=r["id"], space_key=r["key"], name=r["name"], type=r["type"], homepage_id=first_filled(r["homepageId"], r["homepage"]["id"]))


def users_from_json(rows: DataFrame) -> DataFrame:
    """Users with a name; the others aren't stored."""
    r = F.col("r")
    named = _table(rows, "users", account_id=r["accountId"], display_name=first_filled(r["displayName"], r["publicName"]))
    return named.where("display_name <> '' and account_id <> ''")


def space_by_key(spaces: DataFrame, key: str) -> DataFrame:
    """The one space of a key; an error if there is none."""
    row = spaces.where(F.col("space_key") == key).limit(1)
    if row.count() == 0:
        raise LookupError(f"no space with key {key}")
    return row


def read_attachment_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files below path: (path, digest), and each distinct content once as digest, size, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), "content")
    return rows.select("path", "digest"), rows.dropDuplicates(["digest"]).select("digest", "size", "content")
