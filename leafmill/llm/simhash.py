"""SimHash near-dedup by anchor points of a covering code.

Fingerprints: a text's words, ASCII letters lower-cased, make 4-word shingles (repeats included; a shorter text is one
shingle; no words: fingerprint zero). A bit is 1 if it is set in over half of the shingles' XXH64 values.

Two 64-bit fingerprints within four bits agree to within two bits on their low or on their high half. On 31 bits of each
half the anchors are the words of the Hamming code of length 31: every point is within one bit of an anchor (covering
radius 1). Two points within two bits of each other have a point within one bit of both, and its anchor is within two bits
of both. So each fingerprint is replicated to all anchors within two bits, one or sixteen on each half, and every pair
within the threshold meets at some anchor; pairs are compared there on all 64 bits. No candidate is dropped.

Equal fingerprints are one row before that. Anchors with very many fingerprints are cut into blocks and each pair of blocks
is compared by itself, so a dense group is no single task's work. Links leave a task as spanning edges, not as all pairs.

Defined cases: a null text has no words; a null id takes part and, being smallest, is its group's component; repeated rows
keep their rows; an empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import components, cut, small_batches, spread_join

SHINGLE, NEAR = 4, 4
#: Fingerprints at one anchor that one task compares; more are cut into blocks of this many.
BLOCK = 4096

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest, last = xxhash.xxh64_intdigest, ends[min(width, len(words)) - 1 :]
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), "<u8", n)
    set_in = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        set_in += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, bits: each row's fingerprint as a signed long."""

    def made(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series(np.array([simhash(t) for t in texts], "uint64").view("int64"))

    small_batches(docs.sparkSession)
    udf = F.pandas_udf(made, "long")
    return docs.select(F.col(id_col), *keep, udf(F.col(text_col)).alias("bits"))


def _syndrome(half: Column) -> Column:
    """Positions 1 to 31 of the set bits, added without carry: 0 at an anchor, else the position of the bit that leads to one."""
    out = None
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        part = F.shiftleft(F.bit_count(half.bitwiseAND(mask)).bitwiseAND(1), k)
        out = part if out is None else out.bitwiseOR(part)
    return out


def anchors(bits: Column) -> Column:
    """array of longs: all anchors within two bits on 31 bits of each half; anchors of the high half are negative."""

    def near(half: Column) -> Column:
        wrong = _syndrome(half)
        # Flipping the bit at `wrong` gives an anchor; so does flipping two bits whose positions add up to it.
        table = [F.array(F.lit(0).cast("long"))]
        for s in range(1, 32):
            flips = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s]
            table.append(F.array(*[F.lit(x).cast("long") for x in flips]))
        return F.transform(F.get(F.array(*table), wrong), lambda m: half.bitwiseXOR(m))

    low, high = bits.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(bits, 32).bitwiseAND(0x7FFFFFFF)
    return F.concat(near(low), F.transform(near(high), lambda a: -a - 1))


def _spanning(links_a: np.ndarray, links_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between values, one edge for each value that isn't the smallest of its group: to that smallest."""
    values, at = np.unique(np.concatenate([links_a, links_b]), return_inverse=True)
    i, j = at[: len(links_a)], at[len(links_a) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(values))
    return values[other], values[root[other]]


def _near_pairs(x: np.ndarray, y: np.ndarray, near: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within `near` bits of two blocks of fingerprints, as spanning edges of what they link."""
    ux, uy, out_a, out_b = x.view("uint64"), y.view("uint64"), [], []
    for k in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(ux[k : k + 256, None] ^ uy[None, :]) <= near)
        if same:
            keep = i + k < j
            i, j = i[keep], j[keep]
        if len(i):
            a, b = _spanning(x[i + k], y[j])
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return x[:0], x[:0]
    return _spanning(np.concatenate(out_a), np.concatenate(out_b))


def _compare_sorted(near: int):
    """For rows (anchor, bits) sorted by anchor: edges of each anchor's links. An anchor's rows may come in several batches."""

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_a, rest_b = np.array([], "int64"), np.array([], "int64")

        def edges(anchor: np.ndarray, bits: np.ndarray) -> Iterator[pd.DataFrame]:
            bounds = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(anchor)]))
            n = ends - starts
            # Small anchors all at once: each row with the one `lag` rows on, as long as that is at the same anchor.
            small = np.repeat(n <= 32, n)
            out_a, out_b, lag, at = [], [], 1, np.flatnonzero(small)
            while len(at := at[at + lag < len(anchor)]) and len(at := at[anchor[at] == anchor[at + lag]]):
                found = at[np.bitwise_count((bits[at] ^ bits[at + lag]).view("uint64")) <= near]
                out_a.append(bits[found])
                out_b.append(bits[found + lag])
                lag += 1
            for s, e in zip(starts[n > 32], ends[n > 32], strict=True):
                a, b = _near_pairs(bits[s:e], bits[s:e], near, True)
                out_a.append(a)
                out_b.append(b)
            a, b = (np.concatenate(o) if o else np.array([], "int64") for o in (out_a, out_b))
            if len(a):
                a, b = _spanning(a, b)
            yield pd.DataFrame({"a": a, "b": b})

        for frame in frames:
            anchor, bits = np.concatenate([rest_a, frame["anchor"].to_numpy()]), np.concatenate([rest_b, frame["bits"].to_numpy()])
            if not len(anchor):
                continue
            last = np.searchsorted(anchor, anchor[-1])
            rest_a, rest_b = anchor[last:], bits[last:]
            if last:
                yield from edges(anchor[:last], bits[:last])
        if len(rest_a):
            yield from edges(rest_a, rest_b)

    return links


def links(bits: DataFrame, *, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs of distinct fingerprints within `near` bits connect.

    bits: one row per distinct fingerprint, column bits. near is at most 4, for which the anchors are made.
    """
    if near > 4:
        raise ValueError("the anchors cover up to four bits")
    dealt = bits.select("bits", F.explode(anchors(F.col("bits"))).alias("anchor"))
    crowded = cut(dealt.groupBy("anchor").count().where(F.col("count") > block))
    quiet = dealt.join(crowded, "anchor", "left_anti") if crowded.limit(1).count() else dealt
    found = quiet.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compare_sorted(near), "a long, b long")
    if crowded.limit(1).count():
        # Each block of a crowded anchor meets each other block and itself once, in a group of its own.
        many = dealt.join(crowded, "anchor").withColumn("blocks", F.ceil(F.col("count") / (block / 2)).cast("int"))
        many = many.withColumn("mine", F.pmod(F.xxhash64("bits", F.lit("block")), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        many = many.withColumn("other", other).select("bits", "anchor", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))

        def meet(frame: pd.DataFrame) -> pd.DataFrame:
            p, q = frame["p"].iloc[0], frame["q"].iloc[0]
            x, y = (frame.loc[frame["mine"] == k, "bits"].to_numpy() for k in (p, q))
            a, b = _near_pairs(x, y, near, p == q)
            return pd.DataFrame({"a": a, "b": b})

        found = found.unionByName(many.groupBy("anchor", "p", "q").applyInPandas(meet, "a long, b long"))
    return found


def _rooted(prints: DataFrame, low: Column, near: int) -> tuple[DataFrame, DataFrame]:
    """For each distinct fingerprint: bits, n (its rows), low (the smallest of them); and of those with links: bits, root, low, n."""
    distinct = cut(prints.groupBy("bits").agg(F.min(low).alias("low"), F.count("*").alias("n")))
    groups = components(links(distinct.select("bits"), near=near).distinct())
    linked = cut(distinct.join(groups.select(F.col("node").alias("bits"), "root"), "bits"))
    return distinct, linked


def near_groups(docs: DataFrame, *, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, bits, component_id (the smallest id in reach) for each row."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    # Nulls first: a group with a null id has it as its smallest.
    distinct, linked = _rooted(prints, F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id")), near)
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"), F.count("*").alias("n"))
    named = spread_join(linked.select("bits", "root"), lowest, "root").select("bits", F.struct("lowest.id").alias("c"))
    named = distinct.join(named, "bits", "left").select("bits", F.coalesce("c", F.struct("low.id")).alias("c"), "n")
    return spread_join(prints, named, "bits").select(id_col, "bits", F.col("c.id").alias("component_id"))


def fingerprint_groups(docs: DataFrame, *, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 lowercase hex digits), component_id."""
    rows = near_groups(docs, near=near, id_col=id_col, text_col=text_col)
    return rows.select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that with the smallest id, nulls first; of those that share it, one."""
    # Rows are told apart by all they hold, as ids may be null or shared. Maps have no hash.
    rows = docs.withColumn("_row", F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind]))
    prints = cut(fingerprints(rows, id_col=id_col, text_col=text_col, keep=("_row",)))
    distinct, linked = _rooted(prints, F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), F.col("_row").alias("row")), near)
    alone = distinct.join(linked.select("bits"), "bits", "left_anti").select("low")
    kept = linked.groupBy("root").agg(F.min("low").alias("low")).select("low").unionByName(alone).select(F.col("low.id").alias("_kept"), F.col("low.row").alias("_kept_row"))
    # What is left twice are equal rows.
    return rows.join(kept, rows[id_col].eqNullSafe(kept["_kept"]) & (rows["_row"] == kept["_kept_row"]), "left_semi").dropDuplicates([id_col, "_row"]).drop("_row")
