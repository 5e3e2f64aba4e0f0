"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget. Whole epochs of a source come first; what is left of the budget is a weighted sample
without replacement: a document's exponential key is -ln(u) / quality, documents are taken in ascending key, and a prefix
sum of their sizes stops at the budget.

No task ever sorts a whole source: the key range in which the prefix sum crosses the budget is narrowed by histograms
(map-side sums per source and slice of the key range) until it holds few documents, and only those are sorted.

Defined cases: null text has size 0; a null source is a source of its own, the last; a null id takes part like any other;
repeated rows share a key, and where the budget ends among them, so many are taken as fit; an empty table gives an empty
result. Only the named columns are used, whatever other columns are called. The plan of the sources is made in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.llm.common import WORD, cut

#: Slices of one histogram, and the documents of a source that may be sorted in one task.
SLICES, SORTED = 1024, 20_000
#: A plan of this many sources at most is broadcast (about 100 bytes each); a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: What orders the documents of a source; rows that agree in all of it are copies.
PLACE = ("x", "id", "size", "th")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: less for texts with many characters that prose doesn't use."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4 * odd), F.lit(0.05))


def _keyed(docs: DataFrame, seed: str, id_col: str, source_col: str, text_col: str, *more: str) -> DataFrame:
    # The draw is taken from the id (the text, where that is null), so that reruns and other engines agree.
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    key = -F.log(draw) / quality(F.col(text_col))
    return docs.select(
        F.struct(*[F.col(c) for c in more]).alias("row") if more else F.lit(None).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (key / (1 + key)).alias("x"),
        F.xxhash64(text_col).alias("th"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """skey, source, source_size -> with target: shares by weight, none above cap times its size, the excess reshared."""
    every = W.partitionBy()
    ranked = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)))
    limit = F.col("source_size") * cap
    # Sources reach their caps in the order of cap / weight; the level is set by those that don't.
    full = ranked.withColumn("fills", limit / F.col("w"))
    before = W.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.first(F.when(F.col("level") <= F.col("fills"), F.col("level")), ignorenulls=True).over(W.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return full.withColumn("target", F.least(limit, F.coalesce(level, F.lit(0.0)) * F.col("w"))).drop("w", "fills", "level")


def _cuts(keyed: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """For each source, where its prefix sum reaches the part of the budget that whole epochs leave.

    Taken once more is what has x < low, or a PLACE up to last; of the rows at the place `edge`, which are copies of each
    other, so many as `few` says.
    """
    state = plan.select("skey", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0.0).alias("base"))
    rows = keyed.select("skey", *PLACE)
    for _ in range(6):
        inside = rows.join(F.broadcast(state) if few else state, "skey").where("x >= low and x < high")
        step = (F.col("high") - F.col("low")) / SLICES
        slices = inside.groupBy("skey", "rest", "low", "high", "base", F.least(F.floor((F.col("x") - F.col("low")) / step), F.lit(SLICES - 1)).cast("int").alias("slice")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        running = slices.withColumn("upto", F.col("base") + F.sum("words").over(W.partitionBy("skey").orderBy("slice")))
        # The first slice that passes the budget; if none does, an empty one after the last.
        crossing = running.groupBy("skey", "rest", "low", "high", "base").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("slice", (F.col("upto") - F.col("words")).alias("base"), "n"))).alias("c"), F.max("upto").alias("all")
        )
        state = cut(
            crossing.select(
                "skey",
                "rest",
                F.when(F.col("c").isNull(), F.col("high")).otherwise(F.col("low") + F.col("c.slice") * step).alias("low"),
                F.when(F.col("c").isNull(), F.col("high")).when(F.col("c.slice") == SLICES - 1, F.col("high")).otherwise(F.col("low") + (F.col("c.slice") + 1) * step).alias("high"),
                F.coalesce(F.col("c.base"), F.col("all")).cast("double").alias("base"),
                F.coalesce(F.col("c.n"), F.lit(0)).alias("n"),
            )
        )
        if (state.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        state = state.drop("n")
    state = state.drop("n")
    inside = rows.join(F.broadcast(state) if few else state, "skey").where("x >= low and x < high")
    order = W.partitionBy("skey").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    # Copies of a row are one entry. What is taken of an entry comes as near to the budget as it can.
    entries = inside.groupBy("skey", "base", "rest", *PLACE).agg(F.count("*").alias("copies"))
    before = F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    entries = entries.withColumn("fit", F.when(F.col("size") == 0, F.col("copies")).otherwise(F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((F.col("rest") - before) / F.col("size") + 0.5)))))
    place = F.struct(*PLACE)
    ends = entries.groupBy("skey").agg(F.max(F.when(F.col("fit") == F.col("copies"), place)).alias("last"), F.min(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("copies")), F.struct(*PLACE, "fit"))).alias("edge"))
    return state.select("skey", "low").join(ends, "skey", "left").select("skey", "low", "last", F.when(F.col("edge").isNotNull(), F.struct(*[F.col(f"edge.{c}") for c in PLACE])).alias("edge"), F.col("edge.fit").alias("few"))


def _some_copies(rows: DataFrame) -> DataFrame:
    """Of rows at their source's edge (on_edge), the first `few` by partition and place in it, as again. No task gets all copies."""
    rows = cut(rows).withColumn("part", F.spark_partition_id())
    own = rows.where("on_edge").groupBy("skey", "part").count()
    own = own.withColumn("first", F.coalesce(F.sum("count").over(W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("skey", "part").orderBy("part"))
    some = rows.where("on_edge").join(own, ["skey", "part"]).withColumn("again", F.col("first") + nth <= F.col("few")).drop("first")
    return rows.where("not on_edge").unionByName(some).drop("part")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, source, size, source_size, target, taken, copies; with keep: those columns and copies.

    weights are dealt to the sources in code-point order, again from the first when they run out. Together the targets
    are the words of all sources; none exceeds cap times its source. taken is a whole multiple of size.
    """
    keyed = cut(_keyed(docs, seed, id_col, source_col, text_col))
    sizes = keyed.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = targets(sizes, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(cap))).otherwise(F.lit(0))
    plan = cut(plan.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))))
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = cut(plan.join(_cuts(keyed, plan, few), "skey", "left").drop("source"))
    rows = _keyed(docs, seed, id_col, source_col, text_col, *keep) if keep else keyed
    joined = rows.join(F.broadcast(plan) if few else plan, "skey", "left")
    place = F.struct(*PLACE)
    again = (F.col("epochs") < cap) & ((F.col("x") < F.col("low")) | F.coalesce(place <= F.col("last"), F.lit(False)))
    joined = joined.withColumns({"again": again, "on_edge": (F.col("epochs") < cap) & ~again & F.coalesce(place.eqNullSafe(F.col("edge")) & F.col("edge").isNotNull(), F.lit(False))})
    if plan.where("edge is not null").limit(1).count():
        joined = _some_copies(joined)
    joined = joined.withColumn("copies", (F.col("epochs") + F.when(F.col("again"), 1).otherwise(0)).cast("int"))
    if keep:
        return joined.select(*[F.col(f"row.{c}").alias(c) for c in keep], "copies")
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
