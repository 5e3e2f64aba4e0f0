"""Snapshots, states and documents on shared storage, published space by space.

A run writes its tables into folders of its own, which nobody changes again, and a map that names the run in force for each
space and table: its own for its spaces, the earlier ones' for all others. Publishing is the exclusive creation of one small
file, the manifest of the next version. A run that fails before that leaves the version before it in force; of two runs at
once the second finds its version taken. If the first one published other spaces only, the second puts its map on top of
the first one's; else it fails and has changed nothing. A table of a space that has no rows any more is in the map as well,
so it is empty afterwards and not as it was.

    data/<table>/run=<run>/space_id=<space>/   rows
    maps/<run>/                                space_id, name, run
    manifests/<version>.json                   run, base, schemas
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.tables import empty

_MAP = "space_id string, name string, run string"


class PublishConflict(RuntimeError):
    """Another run has published spaces of this run since it read them, or is about to publish. Nothing was changed."""


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a file that wasn't there; False if it was."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(content, "utf-8"))
    out.close()
    return True


def _manifest(spark: SparkSession, folder: str, version: int) -> dict | None:
    """A version's manifest; None where its run has claimed the version but not written it yet."""
    fs, p = _path(spark, f"{folder}/manifests/{version:010d}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text else None


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, f"{folder}/manifests") if n.endswith(".json") and n[0].isdigit()]


def current(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The version in force and its manifest; 0 before the first."""
    for version in sorted(_versions(spark, folder), reverse=True):
        found = _manifest(spark, folder, version)
        if found is not None:
            return version, found
    return 0, None


def current_version(spark: SparkSession, folder: str) -> int:
    return current(spark, folder)[0]


def withdraw(spark: SparkSession, folder: str, version: int) -> None:
    """Frees a version whose run died between claiming and writing it."""
    if _manifest(spark, folder, version) is None:
        fs, p = _path(spark, f"{folder}/manifests/{version:010d}.json")
        fs.delete(p, False)


def _map(spark: SparkSession, folder: str, manifest: dict | None) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{folder}/maps/{manifest['run']}") if manifest else spark.createDataFrame([], _MAP)


def new_run() -> str:
    return uuid.uuid4().hex


def write_rows(df: DataFrame, folder: str, name: str, run: str) -> None:
    """A table's rows of one run, by space where it has spaces."""
    sort = [c for c in df.columns if c not in ("space_id", "body", "content") and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    # The writer keeps an order that begins with the column it divides by.
    writer = df.sortWithinPartitions(*(["space_id"] if "space_id" in df.columns else []), *sort).write.mode("overwrite")
    (writer.partitionBy("space_id") if "space_id" in df.columns else writer).parquet(f"{folder}/data/{name}/run={run}")


def save_state(spark: SparkSession, tables: dict[str, DataFrame], folder: str, *, spaces: DataFrame | None = None, base: int | None = None, run: str | None = None) -> int:
    """Publishes tables as the next version and returns it.

    spaces (space_id): those of this run; all their rows in these tables are replaced, also where there are none now. Left
    out, they are the spaces that the tables name. Tables that aren't given, and other spaces, stay as they are. base: the
    version that the run read, if an earlier one than that in force; run: where documents of this run were written.
    """
    version, manifest = current(spark, folder)
    base = version if base is None else base
    run = run or new_run()
    for name, df in tables.items():
        write_rows(df, folder, name, run)
    schemas = {name: df.schema.json() for name, df in tables.items()}
    by_space = [name for name, df in tables.items() if "space_id" in df.columns]
    if spaces is None:
        parts = [tables[name].select(F.coalesce("space_id", F.lit("")).alias("space_id")) for name in by_space]
        spaces = spark.createDataFrame([], "space_id string")
        for part in parts:
            spaces = spaces.unionByName(part)
    own = spaces.select(F.col("space_id").cast("string").alias("space_id")).distinct().withColumn("name", F.explode(F.array(*map(F.lit, by_space)).cast("array<string>")))
    # Tables without spaces are whole.
    whole = spark.createDataFrame([("", name) for name in tables if name not in by_space], "space_id string, name string")
    # Written before it is compared, so that it is read as cheaply as any map.
    own.unionByName(whole).withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{folder}/maps/{run}-own")
    own = spark.read.schema(_MAP).parquet(f"{folder}/maps/{run}-own")
    read = _manifest(spark, folder, base) if base else None
    while True:
        claimed = max(_versions(spark, folder), default=0)
        if claimed > version:
            raise PublishConflict(f"version {claimed} is being published; withdraw it if its run is dead")
        if version != base:
            before, now = (_map(spark, folder, m).join(own.select("space_id", "name"), ["space_id", "name"], "left_semi") for m in (read, manifest))
            if before.exceptAll(now).limit(1).count() or now.exceptAll(before).limit(1).count():
                raise PublishConflict(f"version {version} has replaced spaces of this run, which read version {base}")
        rest = _map(spark, folder, manifest).join(own.select("space_id", "name"), ["space_id", "name"], "left_anti")
        target = run if version == base else f"{run}-{version}"
        own.unionByName(rest).write.mode("overwrite").parquet(f"{folder}/maps/{target}")
        content = {"run": target, "base": version, "schemas": {**(manifest["schemas"] if manifest else {}), **schemas}}
        if _claim(spark, f"{folder}/manifests/{version + 1:010d}.json", json.dumps(content)):
            return version + 1
        version, manifest = current(spark, folder)


def load_state(spark: SparkSession, folder: str, name: str, *, version: int | None = None) -> DataFrame:
    """A table as the version in force (or another one) has it, or an empty one of the right schema if it was never written. A broken one is an error."""
    manifest = _manifest(spark, folder, version) if version else None if version == 0 else current(spark, folder)[1]
    if manifest is None or name not in manifest["schemas"]:
        return empty(spark, name)
    schema = T.StructType.fromJson(json.loads(manifest["schemas"][name]))
    wanted = _map(spark, folder, manifest).where(F.col("name") == name).drop("name")
    rows = spark.read.schema(T.StructType([*schema, T.StructField("run", T.StringType())])).parquet(f"{folder}/data/{name}")
    if "space_id" not in schema.names:
        return rows.join(wanted.select("run").distinct(), "run", "left_semi").select(*schema.names)
    rows = rows.withColumn("space_id", F.coalesce(F.col("space_id").cast("string"), F.lit("")))
    return rows.join(wanted, ["space_id", "run"], "left_semi").select(*schema.names)


def save_snapshot(tables: dict[str, DataFrame], folder: str, *, spaces: DataFrame | None = None) -> int:
    """What was fetched, by the same rules: spaces that aren't fetched again stay as they are."""
    return save_state(next(iter(tables.values())).sparkSession, tables, folder, spaces=spaces)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_state(spark, folder, name)


def without_failed_media(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """A page whose media could not be written gets an empty fingerprint, so the next run tries again."""
    bad = failed.select("space_id", "page_id").distinct().withColumn("_bad", F.lit(True))
    return pages.join(bad, ["space_id", "page_id"], "left").withColumn("fingerprint", F.when(F.col("_bad"), "").otherwise(F.col("fingerprint"))).drop("_bad")


def write_documents(rows: DataFrame, folder: str, run: str) -> None:
    """space_id, rel_path, content of what a run has written, beside the runs before it."""
    write_rows(rows.select("space_id", "rel_path", "content"), folder, "documents", run)


def documents_of(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """space_id, rel_path, content of the documents that names (space_id, rel_path, doc_run) points at."""
    if not exists(spark, f"{folder}/data/documents"):
        return spark.createDataFrame([], "space_id string, rel_path string, content string")
    written = spark.read.schema("rel_path string, content string, run string, space_id string").parquet(f"{folder}/data/documents")
    written = written.withColumn("space_id", F.coalesce("space_id", F.lit("")))
    return written.withColumnRenamed("run", "doc_run").join(names, ["space_id", "rel_path", "doc_run"], "left_semi").select("space_id", "rel_path", "content")


def load_documents(spark: SparkSession, folder: str, *, version: int | None = None) -> DataFrame:
    """space_id, rel_path, content of all documents in force: those the state names, from the runs that it names for them."""
    pages = load_state(spark, folder, "state_pages", version=version)
    if "doc_run" not in pages.columns:
        pages = pages.withColumn("doc_run", F.lit(""))
    names = pages.select("space_id", F.col("file").alias("rel_path"), "doc_run")
    if "html" in pages.columns:
        names = names.unionByName(pages.where("html <> ''").select("space_id", F.col("html").alias("rel_path"), "doc_run"))
    return documents_of(spark, folder, names)


def vacuum(spark: SparkSession, folder: str, *, keep: int = 2, older_than_hours: float = 24.0) -> int:
    """Deletes manifests before the last keep ones and the folders of runs that no kept one needs; how many folders went.

    Folders younger than older_than_hours stay, as their run may be about to publish. One row a run passes through the driver.
    """
    kept = [v for v in sorted(_versions(spark, folder), reverse=True) if _manifest(spark, folder, v) is not None][:keep]
    needed = spark.createDataFrame([], "run string")
    maps = set()
    for version in kept:
        manifest = _manifest(spark, folder, version)
        maps.add(manifest["run"])
        needed = needed.unionByName(_map(spark, folder, manifest).select("run"))
        pages = load_state(spark, folder, "state_pages", version=version)
        if "doc_run" in pages.columns:
            needed = needed.unionByName(pages.select(F.col("doc_run").alias("run")))
    used = {r.run for r in needed.distinct().collect()}
    fs, root = _path(spark, folder)
    limit = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3_600_000)
    gone = 0
    old = [(f"{folder}/data/{name}/{run}", run.removeprefix("run=") in used) for name in _names(spark, f"{folder}/data") for run in _names(spark, f"{folder}/data/{name}") if run.startswith("run=")]
    for path, there in [*old, *((f"{folder}/maps/{m}", m in maps) for m in _names(spark, f"{folder}/maps"))]:
        _, p = _path(spark, path)
        if not there and fs.getFileStatus(p).getModificationTime() <= limit:
            fs.delete(p, True)
            gone += 1
    for version in set(_versions(spark, folder)) - set(kept):
        if version < min(kept, default=0):
            fs.delete(_path(spark, f"{folder}/manifests/{version:010d}.json")[1], False)
    return gone

