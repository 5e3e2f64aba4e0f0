"""Canonical tables derived from the driver's tables, so that each operator runs, and is checked, at any scale.

TREE: regions are spaces, nations folders, customers pages in them, orders pages below customers (a third archived).
ATT: line items are attachments of orders. PREV and CUR: two snapshots of both. BODY: documents. EDITS: events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.lineage import settled


class Tree:
    """TREE and ATT over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses more than once, made once for it."""
        if name not in self.made:
            self.made[name] = settled(make, kept=True)
        return self.made[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spaces(self) -> DataFrame:
        return self.read("region").select(F.concat(F.lit("r"), "r_regionkey").alias("space_id"), F.upper(F.substring("r_name", 1, 3)).alias("space_key"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "global").otherwise("personal").alias("type"), F.lit("").alias("homepage_id"))

    def folders(self) -> DataFrame:
        n = self.read("nation")
        return n.select(F.concat(F.lit("r"), "n_regionkey").alias("space_id"), F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.col("n_name").alias("title"), F.lit("").alias("parent_id"), F.lit("").alias("parent_type"), F.col("n_nationkey").cast("int").alias("position"), F.col("n_nationkey").cast("long").alias("ord"))

    def pages(self) -> DataFrame:
        nation = F.broadcast(self.read("nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("space_id")))  # 25 rows at any scale
        c = self.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        customers = c.select("space_id", F.concat(F.lit("c"), "c_custkey").alias("page_id"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lit("folder").alias("parent_type"), (F.col("c_custkey") % 7).cast("int").alias("position"), F.lit("current").alias("status"), F.lit(1).alias("version"), F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("u"), F.col("c_custkey") % 50).alias("author"))
        o = self.read("orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "space_id"), "o_custkey")
        orders = o.select("space_id", F.concat(F.lit("o"), "o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.lit("page").alias("parent_type"), F.lit(0).alias("position"), F.when(F.col("o_orderstatus") == "P", "archived").otherwise("current").alias("status"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("author"))
        body = F.concat(F.lit('<p>by <ri:user ri:account-id="'), "author", F.lit('"/> on '), "page_id", F.lit("</p>"))
        return customers.unionByName(orders).withColumn("body", body)

    def lines(self) -> DataFrame:
        """page_id, att_id (repeats), word, listing: attachments before they are described; listing is a total order of them."""
        p = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(F.split("p_name", " "), 2).alias("word"))
        rows = self.read("lineitem").join(p, "l_partkey")
        return rows.select(
            F.concat(F.lit("o"), "l_orderkey").alias("page_id"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("att_id"),
            "word",
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("listing"),
        )

    def described(self, lines: DataFrame) -> DataFrame:
        """page_id, att_id, title, media_type, file_size, created_at, version, listing of lines."""
        kind = F.col("listing.l_linenumber") % 3
        end = F.when(kind == 0, ".drawio").when(kind == 1, ".drawio.png").otherwise(".pdf")
        return lines.select(
            "page_id",
            "att_id",
            F.concat("word", end).alias("title"),
            F.when(kind == 0, "application/vnd.jgraph").when(kind == 1, "image/png").otherwise("application/pdf").alias("media_type"),
            F.col("listing.l_quantity").cast("long").alias("file_size"),
            F.date_format("listing.l_shipdate", "yyyy-MM-dd").alias("created_at"),
            F.year("listing.l_shipdate").cast("int").alias("version"),
            "listing",
        )

    def attachments(self) -> DataFrame:
        """page_id, att_id (repeats), title, media_type, file_size, created_at, version, listing: a total order of them."""
        return self.described(self.lines())


def previous(rows: DataFrame, key: str) -> DataFrame:
    """A table as it was in the previous snapshot: some rows weren't there yet."""
    return rows.where(F.substring(key, 2, 20).cast("long") % 10 != 0)


def current(rows: DataFrame, key: str) -> DataFrame:
    """As it is now: some rows are gone, some have a new version."""
    n = F.substring(key, 2, 20).cast("long") % 10
    return rows.where(n != 1).withColumn("version", F.col("version") + F.when(n == 2, 1).otherwise(0))
