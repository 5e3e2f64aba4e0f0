"""Canonical tables: explicit schemas, and typing that treats null, absent and default alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}


def _schema(fields: str) -> T.StructType:
    """Fields as "name type, ..."; no session is needed for it."""
    return T.StructType([T.StructField(n, VERSION if k == "version" else _KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])


VERSION = _schema("number int, created_at string, message string, author_id string")

SCHEMAS = {
    "spaces": _schema("space_id string, space_key string, name string, type string, homepage_id string"),
    "pages": _schema("space_id string, page_id string, title string, parent_id string, parent_type string, position int, status string, body string, version version, web_url string, ord bigint"),
    "folders": _schema("space_id string, folder_id string, title string, parent_id string, parent_type string, position int, ord bigint"),
    "attachments": _schema("space_id string, page_id string, att_id string, title string, media_type string, file_size bigint, download_url string, version version, ord bigint"),
    "users": _schema("account_id string, display_name string"),
    "body_blobs": _schema("space_id string, page_id string, digest string"),
    "attachment_blobs": _schema("att_id string, version int, digest string"),
    "derived_blobs": _schema("render_version int, xml_digest string, png_digest string"),
    "blobs": _schema("digest string, size bigint"),
    "state_pages": _schema("space_id string, page_id string, dir string, file string, html string, title string, version int, status string, fingerprint string, doc_run string"),
    "state_attachments": _schema("space_id string, page_id string, att_id string, version int, file string, blob string, size bigint"),
    "state_rendered": _schema("space_id string, page_id string, file string, blob string"),
    "state_spaces": _schema("space_id string, space_key string, root string"),
    "state_folders": _schema("space_id string, folder_id string, dir string"),
}

#: Defaults that aren't the type's own.
DEFAULTS = {("pages", "status"): "current"}


def _leaf(value: Column, kind: T.DataType, default: object = None) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_leaf(value[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.StringType):
        return F.coalesce(value.cast("string"), F.lit(default if default is not None else ""))
    # What can't be read as a number is taken as absent.
    return F.coalesce(value.try_cast(kind.simpleString()), F.lit(default if default is not None else 0).cast(kind))


def normalize(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the columns of a canonical table, none of them null: missing and null columns take the default."""
    have, out = {f.name: f.dataType for f in df.schema}, []
    for field in SCHEMAS[table]:
        value = F.col(field.name) if field.name in have else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.StructType):
            inner = {f.name for f in have[field.name].fields} if field.name in have and isinstance(have[field.name], T.StructType) else set()
            value = F.struct(*[(F.col(f"{field.name}.{f.name}") if f.name in inner else F.lit(None).cast(f.dataType)).alias(f.name) for f in field.dataType])
        out.append(_leaf(value, field.dataType, DEFAULTS.get((table, field.name))).alias(field.name))
    return df.select(*out)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values], F.lit(""))
