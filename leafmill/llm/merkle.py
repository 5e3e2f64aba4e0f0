"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text is cut at blank lines into sections, at line ends into paragraphs, and each paragraph into runs of four words with
the white space that follows them; the runs tile the paragraph. A run's digest is its XXH64; a paragraph's digests fold
over its runs, a section's over its paragraphs, and the root over the sections. Equal roots mean equal texts.

A fingerprint is a string: the root, a colon, then sections parted by "/", paragraphs by ",", and each run's digest as
eight hex digits. Equality looks at the root alone; where trees differ, `differing` names the branches that do.
Everything is built from DataFrame functions.

Defined cases: a null text counts as empty; the empty text has one empty paragraph, and two of them have likeness 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RUN = r"(?:\S++\s*+){1,4}+|\s++"
#: Documents of one bucket when neighbours are found, and the most buckets; their bounds (8 bytes each) pass the driver.
BUCKET_DOCS, MOST_BUCKETS = 1000, 20_000


def tree(text: Column) -> Column:
    """array (sections) of array (paragraphs) of array (runs) of 64-bit digests."""
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), F.lit(0)), lambda r: F.xxhash64(r))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def runs(digests: Column) -> Column:
    """All runs of a tree, in order, by the 31 low bits of their digests."""
    return F.transform(F.flatten(F.flatten(digests)), lambda d: d.bitwiseAND(0x7FFFFFFF).cast("int"))


def fingerprint(digests: Column) -> Column:
    root = F.substring(F.sha2(F.concat_ws("/", F.transform(digests, lambda s: F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))))), 256), 1, 32)
    digit8 = lambda d: F.lpad(F.hex(d.bitwiseAND(0x7FFFFFFF)), 8, "0")
    body = F.concat_ws("/", F.transform(digests, lambda s: F.concat_ws(",", F.transform(s, lambda p: F.array_join(F.transform(p, digit8), "")))))
    return F.concat(root, F.lit(":"), body)


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct runs (as `runs` gives them) of both, from 0 to 1."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """Where two trees differ: array of (section, paragraph), from 0; a branch that only one has counts. Empty for equal trees.

    Equal sections are passed over whole; each level is gone through once.
    """
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    empty = F.array().cast("array<array<bigint>>")

    def inside(s: Column, i: Column) -> Column:
        same = F.zip_with(F.coalesce(s["x"], empty), F.coalesce(s["y"], empty), lambda p, q: p.eqNullSafe(q))
        found = F.filter(F.transform(same, lambda e, j: F.when(~e, F.struct(i.alias("section"), j.alias("paragraph")))), lambda e: e.isNotNull())
        return F.when(s["x"].eqNullSafe(s["y"]), none).otherwise(found)

    return F.flatten(F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), inside))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of each row's whole text."""
    trees = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(id_col, tree(F.col("t")).alias("t"))
    return trees.select(id_col, fingerprint(F.col("t")).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str, payload: dict[str, Column]) -> DataFrame:
    """id_col, the payload of each row, and that of the next one by id (nulls first; after the last: the first) as struct `next`.

    docs has id_col and what the payload is made from.

    Ids are cut into buckets of about equal numbers of rows. A bucket also gets the row at the next bucket's bound, so
    each bucket answers for itself, and no task orders the whole table.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_DOCS))
    bounds = docs.agg(F.percentile_approx(id_col, [i / buckets for i in range(buckets)], max(10_000, 10 * buckets))).first()[0] or []
    bounds = sorted(set(bounds)) or [0]
    # The number of bounds up to the id, found by halving; the bucket is one less.
    steps = F.array(*[F.lit(2**k) for k in range(math.ceil(math.log2(len(bounds) + 1)) - 1, -1, -1)])
    table = F.array(*[F.lit(b) for b in bounds])
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col(id_col), at + step).otherwise(at))
    placed = docs.withColumns({**payload, "bucket": F.greatest(upto - 1, F.lit(0)).cast("int")})
    own, before = F.struct(F.col("bucket"), F.lit(0).alias("extra")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("extra"))
    at_bound = (F.col("bucket") > 0) & (F.col(id_col) == F.get(table, F.col("bucket")))
    placed = placed.withColumn("place", F.explode(F.when(at_bound, F.array(own, before)).otherwise(F.array(own)))).select(id_col, *payload, "place.bucket", "place.extra")
    first = docs.where(F.col(id_col).isNull() if nulls else F.col(id_col) == bounds[0]).withColumns(payload).select(id_col, *payload)
    tie = F.xxhash64(*payload)
    first = first.orderBy(tie).limit(1).withColumns({"bucket": F.lit(len(bounds) - 1), "extra": F.lit(2)})
    order = W.partitionBy("bucket").orderBy("extra", F.col(id_col).asc_nulls_first(), tie)
    return placed.unionByName(first).withColumn("next", F.lead(F.struct(*payload)).over(order)).where("extra = 0").drop("bucket", "extra")


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of it with its last quarter replaced by the next document's beginning, likenesses, and the branches that the edit changed."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, id_col, {"text": F.col("text"), "runs": runs(tree(F.col("text")))})
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next.text"), F.lit(1), part)))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("tree"), tree(F.col("edited")).alias("edited_tree"), "runs", F.col("next.runs").alias("next_runs"))
    rows = rows.withColumn("edited_runs", runs(F.col("edited_tree")))
    return rows.select(
        id_col,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("runs"), F.col("edited_runs")).alias("near_edited"),
        likeness(F.col("runs"), F.col("next_runs")).alias("near_next"),
        differing(F.col("tree"), F.col("edited_tree")).alias("differing"),
    )
