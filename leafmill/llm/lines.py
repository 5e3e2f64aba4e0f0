"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line (by document id, then place) equals it or is within one edit (a character inserted,
deleted or replaced). Lines are compared without ASCII white space at their ends; empty ones always stay. exact_from and
near_from are the shortest lines, in characters, that are compared for equality and for one edit; by default all are.

Equal lines are found by hash. For the others, a line is cut in the middle: an edit falls into one half and the other keeps
its value, so lines that share no half (at their own length, or at that of the line a character shorter) can't be near. The
few that do are cut again, the half that may hold the edit into about as many pieces as a piece has characters, and keep
only pieces whose surroundings another line shares. These emit all variants of the piece with one character deleted, as
hashed keys: two lines of one length that differ in a character meet at the variant without it, and a line meets the one
that is a character longer at its own value. Equal variants are joined, the edit distance is verified, and the earliest
line wins. No pairs within a group are made: a group names its earliest line. The work for a line grows as its length
to the power of 1.5, and only for those that share a half.

All of it is DataFrame functions. Lines are kept between the steps as hashes; texts are read again. What is broadcast has
its rows counted first; beyond BROADCAST rows the same join runs by shuffle.

Defined cases: a null text has no lines and stays null; the empty text has one empty line, which is kept; null ids come
first; rows that share an id count as one document in the order, and lines at the same place of it don't drop each other;
an empty table gives no rows. Only the named columns are used; ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut

#: About 100 bytes a row.
BROADCAST = 200_000
SPACE = " \t\r\x0b\x0c"


def _small(df: DataFrame) -> DataFrame:
    """df, which is cut already, marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _stripped(line: Column) -> Column:
    plain = F.trim(line)
    odd = F.lit(False)
    for c in SPACE[1:]:
        odd = odd | plain.startswith(c) | plain.endswith(c)
    return F.when(odd, F.trim(plain, F.lit(SPACE))).otherwise(plain)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, no, line and order (one number, so that its minimum is hashed) of each line."""
    # The text's hash is made before its lines become rows, so that no row carries the text.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n", -1).alias("all"))
    rows = rows.select("id", "th", F.posexplode("all").alias("no", "line")).withColumn("line", _stripped(F.col("line")))
    order = (F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(11,0)") + F.col("no")).cast("decimal(38,0)")
    return rows.withColumn("order", order)


def _hashes() -> dict[str, Column]:
    return {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")}


def _half(m: Column) -> Column:
    return F.shiftright(m, 1)


def distinct_lines(docs: DataFrame, *, exact_from: int = 1, near_from: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, first (order of its first place), copies, n (characters) and four keys of each distinct line.

    The keys are hashes of its last and first half, as a line of n characters and as the longer one of a pair with n - 1;
    null for lines that aren't compared for an edit.
    """
    rows = _lines(docs, id_col, text_col).withColumn("n", F.char_length("line")).where(F.col("n") >= max(1, exact_from))
    keys = {}
    for longer in (0, 1):
        m = F.col("n") - longer
        left, right = _half(m), m - _half(m)
        keys[f"right{longer}"] = F.xxhash64(m, F.lit(0), F.right("line", right))
        keys[f"left{longer}"] = F.xxhash64(m, F.lit(1), F.left("line", left))
    near = F.col("n") >= near_from
    rows = rows.select("order", "n", *[c.alias(k) for k, c in _hashes().items()], *[F.when(near, c).alias(k) for k, c in keys.items()])
    return rows.groupBy("h1", "h2").agg(F.min("order").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in keys])


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Keys that a line shares with another, at least one of which isn't the longer one."""
    return rows.groupBy(key).agg(F.count("*").alias("met"), F.min("longer").alias("all_longer")).where("met > 1 and not all_longer").select(key)


def near_lines(docs: DataFrame, distinct: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, first (order of the earliest line within one edit) of each line that has an earlier one; distinct as of distinct_lines."""
    views = [F.struct(F.col(f"{side}{longer}").alias("key"), F.lit(half).alias("half"), F.lit(bool(longer)).alias("longer")) for half, side in enumerate(("right", "left")) for longer in (0, 1)]
    keys = distinct.where("right0 is not null").select("h1", "h2", "first", "n", F.explode(F.array(*views)).alias("v")).select("h1", "h2", "first", "n", "v.*")
    found = cut(keys.join(_small(cut(_met(keys, "key"))), "key"))
    # Their texts, from the documents: by place, then by hash where ids are shared.
    wanted = _small(cut(found.select("h1", "h2", F.col("first").alias("order")).distinct()))
    texts = _lines(docs, id_col, text_col).select("order", "line").join(wanted, "order")
    texts = texts.where((F.col("h1") == _hashes()["h1"]) & (F.col("h2") == _hashes()["h2"])).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    m = F.col("n") - F.col("longer").cast("int")
    part = F.when(F.col("half") == 0, F.left("line", F.col("n") - (m - _half(m)))).otherwise(F.right("line", F.col("n") - _half(m)))
    parts = cut(found.join(texts, ["h1", "h2"]).select("key", "h1", "h2", F.col("first").alias("order"), "longer", part.alias("part"), (F.char_length(part) - F.col("longer").cast("int")).alias("s")))
    # Pieces of the part, each with what surrounds it.
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt("s"))).cast("int")
    begin = lambda j: F.floor(F.col("s") * j / F.col("pieces")).cast("int")
    after = lambda j: F.col("s") - begin(j + 1)
    piece = lambda j: F.struct(F.xxhash64("key", j, F.left("part", begin(j)), F.right("part", after(j))).alias("sub"), F.substring("part", begin(j) + 1, F.char_length("part") - begin(j) - after(j)).alias("piece"))
    cast = parts.withColumn("pieces", pieces).select("h1", "h2", "order", "longer", F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), piece)).alias("p")).select("h1", "h2", "order", "longer", "p.*")
    live = cut(cast.join(_met(cast, "sub"), "sub"))
    # A line without the character at q meets lines of its length at (sub, q), shorter ones at (sub).
    size = F.char_length("piece")
    without = lambda q: F.concat(F.left("piece", q), F.substring("piece", q + 2, size))
    spots = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    replaced = F.transform(spots, lambda q: F.xxhash64("sub", F.lit("replaced"), q, without(q)))
    deleted = F.array_distinct(F.transform(spots, lambda q: F.xxhash64("sub", F.lit("deleted"), without(q))))
    own = F.array(F.xxhash64("sub", F.lit("deleted"), "piece"))
    some = lambda a: F.when(size > 0, a).otherwise(F.array().cast("array<bigint>"))
    variants = cut(live.select("sub", "h1", "h2", "order", "longer", F.explode(F.when(F.col("longer"), some(deleted)).otherwise(F.concat(own, some(replaced)))).alias("variant")))
    # Deletions meet only the shorter line's own value, so there the group is named by either side's earliest.
    named = variants.groupBy("variant").agg(F.count("*").alias("met"), F.min(F.when(~F.col("longer"), F.col("order"))).alias("short"), F.min(F.when(F.col("longer"), F.col("order"))).alias("long")).where("met > 1").drop("met")
    other = F.explode(F.array_compact(F.when(F.col("longer"), F.array("short")).otherwise(F.array("short", "long"))))
    pairs = variants.join(named, "variant").select("sub", "h1", "h2", "order", "longer", other.alias("o")).where("o < order").distinct()
    mine = live.select("sub", "h1", "h2", "longer", F.col("piece").alias("mine"))
    theirs = live.select("sub", F.col("order").alias("o"), F.col("piece").alias("theirs"))
    near = pairs.join(mine, ["sub", "h1", "h2", "longer"]).join(theirs, ["sub", "o"]).where(F.levenshtein("mine", "theirs", 1) >= 0)
    return near.groupBy("h1", "h2").agg(F.min("o").alias("first"))


def dedup_lines(docs: DataFrame, *, exact_from: int = 1, near_from: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without the dropped lines, and n_lines, n_dropped; all other columns stay."""
    distinct = cut(distinct_lines(docs, exact_from=exact_from, near_from=near_from, id_col=id_col, text_col=text_col))
    near = near_lines(docs, distinct, id_col=id_col, text_col=text_col)
    marked = _small(cut(distinct.where("copies > 1").select("h1", "h2", "first").unionByName(near).groupBy("h1", "h2").agg(F.min("first").alias("first"))))
    lines = _lines(docs, id_col, text_col).where("line <> ''").select("id", "th", "no", "order", *[c.alias(k) for k, c in _hashes().items()])
    dropped = lines.join(marked, ["h1", "h2"]).where(F.col("order") > F.col("first")).groupBy("id", "th").agg(F.collect_set("no").alias("_dropped"))
    # One row for each text that loses lines, beside which texts needn't be sorted.
    dropped = dropped.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_dropped").hint("shuffle_hash")
    rows = docs.join(dropped, docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th")), "left").drop("_id", "_th")
    # A text's lines are made once: a lambda's variable stands for them.
    rows = rows.withColumn("_every", F.split(text_col, "\n", -1))
    left = lambda every: F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("_dropped"))
    kept = F.get(F.transform(F.array("_every"), lambda every: F.array_join(F.transform(left(every), lambda i: F.get(every, i)), "\n")), 0)
    return rows.withColumns({"n_lines": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("_every")), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"), text_col: F.when(F.col("_dropped").isNull(), F.col(text_col)).otherwise(kept)}).drop("_dropped", "_every")
