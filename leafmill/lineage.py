"""Cutting the lineage of iterative plans, and the shared folder that this needs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Where `settled` keeps account of what is stored while it makes a table.
_STORED: ContextVar[list[str] | None] = ContextVar("_STORED", default=None)
_CLEANUP, _FACTOR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.sources.fileCompressionFactor"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="leafmill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Rows of df, written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, *, kept: bool = False) -> DataFrame:
    """Rows of df, computed and written once to the shared folder as compressed columns; their order and partitions are lost.

    A checkpoint computes its last stage twice and writes whole rows as they are. The shuffle files of the write go with it.
    kept: also `settled` leaves it in place.
    """
    # Parquet has no type for columns of nothing but null.
    if "void" in df.schema.simpleString():
        return cut(df)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    if _STORED.get() is not None and not kept:
        _STORED.get().append(path)
    # The files are many times smaller than their rows, which a broadcast would hold in memory.
    if spark.conf.get(_FACTOR) == "1.0":
        spark.conf.set(_FACTOR, "10.0")
    # Names that differ in case only are one to Parquet.
    rows = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    with shuffles_removed(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).toDF(*df.columns)


def settled(make: Callable[[], DataFrame], *, kept: bool = False) -> DataFrame:
    """The table that make gives, stored; what was stored on the way to it is removed."""
    own: list[str] = []
    token = _STORED.set(own)
    try:
        rows = make()
    finally:
        _STORED.reset(token)
    out = stored(rows, kept=kept)
    for path in own:
        p = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return out


def stored_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Rows of df as `stored` gives them, and aggregates over them, taken while they are written."""
    seen = Observation()
    rows = stored(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
    return rows, seen.get


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A sorted table with the place of each row, from 1: its place in its partition behind all partitions before."""
    rows = cut(df).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    # One row per partition: their number is the session's, not the data's.
    before = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.drop("count")), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
