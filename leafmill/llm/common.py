"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.lineage import cut, shared_folder

__all__ = ["MOST", "WORD", "ascii_lower", "components", "cut", "shared_folder", "small_batches", "spread_join", "table"]

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that a task may read in a join.
MOST = 1000
#: Bytes of rows that go to a Python worker at once.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python by about BATCH bytes, not by 64 MB, of which task and worker hold several copies; a size that is set stays.

    The setting is read when rows are computed, so it can't be taken back here.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows.join(side, key), whatever share of the rows a key has. side: one row for each key, with n, the rows of that key.

    Keys with more than MOST rows, or a 100,000th of all (so there are fewer than 100,000 of them), never come together in
    a task: their side rows are broadcast.
    """
    side = cut(side)
    total, most = side.agg(F.sum("n"), F.max("n")).first()
    limit = max(MOST, (total or 0) // 100_000)
    if (most or 0) <= limit:
        return rows.join(side.drop("n"), key)
    # Rows of these keys are told by a column that only they get.
    hot = F.broadcast(side.where(F.col("n") > limit).select(F.col(key).alias("_hot"), F.struct(*[c for c in side.columns if c not in (key, "n")]).alias("_side")))
    met = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    values = [c for c in side.columns if c not in (key, "n")]
    here = met.where("_hot is not null").select(*rows.columns, *[F.col(f"_side.{c}").alias(c) for c in values])
    rest = met.where("_hot is null").select(*rows.columns).join(side.where(F.col("n") <= limit).drop("n"), key)
    return here.unionByName(rest.select(*here.columns))


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node that can be reached.

    edges: columns a, b of one orderable type; loops and repeated rows are fine. Nodes without an edge to another node
    don't appear. Each round is a large-star and a small-star step: neighbours move to the smallest known neighbour, so
    the rounds grow with the logarithm of the longest path. Minima are aggregated map-side and joined back by spread_join,
    so a node with very many neighbours is no single task's work; lineage ends after each round.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = cut(large.distinct())
        down = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        small = spread_join(large, down, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = cut(small.select("e.*").where("u <> v").distinct())
        # Done when every node has one smaller neighbour, which itself has none: stars around the roots.
        open_nodes = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not open_nodes and not after.select("u").join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            pairs = after
            break
        pairs = after
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
