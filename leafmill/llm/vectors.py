"""Embedding near-dedup by sorted projection passes.

Each pass projects the vectors of a label on its own random directions, concatenates the signs into a key and orders the
vectors by it; each is compared, in double precision, with those up to `window` places on. Pairs at or above the threshold
are links; components of the links are the near-duplicate groups. A pair that an earlier pass has compared isn't counted
again: each vector carries its places in all passes. Places in the order come from one range-partitioned sort and
per-partition counts; comparisons run in blocks of consecutive places, each with the first rows of the next block.

How many passes a label gets follows from its size and from how its vectors lie. One window holds a label of window + 1
vectors, so one pass finds all. In larger ones, were the vectors spread evenly, a pair at the threshold would agree in a bit
with chance 1 - acos(threshold) / pi, and stand within a window if it agrees in all bits that it takes to cut the label down
to half a window. Vectors that share a direction are cut more slowly, so the chance is measured as well: for a sample of the
label (SAMPLE vectors, by a hash) partners are made at the threshold, in the directions in which the label's vectors differ,
and TRIALS trial keys tell how often both agree in as many bits as leave a window's number of the label. Passes are added
until a pair is missed with chance `miss` at most by either. Closer pairs are missed more rarely. A label whose vectors
nearly all lie at the threshold can ask for more than MANY passes; where their windows would cover it whole, its blocks are
compared with each other instead.

That holds where links are thin. Where a vector is linked to a quarter of a window, its group may be larger than windows
are, so all pairs of that component are compared: its vectors are dealt to blocks, block meets block, and only counts come
back. Its links are then all counted; the work grows with the square of the component's distinct vectors.

Equal vectors of a label are one class beforehand, so a large group of exact copies costs one comparison and its links are
still all counted.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with
nothing and are their own component; vectors of unequal length don't link; a row that repeats a vec_id with the same label
and vector is the same vector and gets the same answer; rows that share a vec_id with different vectors are told apart, and
each has its own links; an empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.llm.common import components, cut, spread_join

THRESHOLD, MISS, BITS, WINDOW, BLOCK = 0.93, 0.005, 32, 2048, 2048
#: Vectors of a dense component that one task compares with each other, or with as many of another block.
PAIRED = 8192
#: Vectors of a label by which its passes are measured, with so many trial keys; passes that are many.
SAMPLE, TRIALS, MANY = 2048, 32, 64


def passes_for(n: Column, *, window: int = WINDOW, threshold: float = THRESHOLD, miss: float = MISS) -> Column:
    """Passes after which a pair at the threshold, in a label of n vectors, is missed with chance `miss` at most."""
    agree = 1 - math.acos(threshold) / math.pi
    met = F.pow(F.lit(agree), F.log2(n / (window / 2)))
    return F.when(n <= window + 1, 1).otherwise(F.ceil(math.log(miss) / F.log(1 - met))).cast("int")


def _measure(threshold: float, miss: float, bits: int, window: int, seed: int):
    """Passes that a label needs, by a sample of its vectors."""

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cid", kind="stable")
        x, n = np.stack(frame["vector"].to_list()).astype("float64"), int(frame["n"].iloc[0])
        x /= np.linalg.norm(x, axis=1)[:, None]
        rng, m = np.random.default_rng([seed, x.shape[1], len(x)]), len(x)
        aside = x[rng.permutation(m)] - x[rng.permutation(m)]
        aside -= (aside * x).sum(axis=1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        y = threshold * x + math.sqrt(1 - threshold**2) * aside
        met = 0
        for _ in range(TRIALS):
            directions = rng.standard_normal((x.shape[1], bits))
            a, b = x @ directions > 0, y @ directions > 0
            parted = (a != b).any(axis=1)
            agreed = np.where(parted, (a != b).argmax(axis=1), bits)
            # The share of the label that has a vector's first bits. Where the sample shows too few, each further bit is taken to halve it.
            share, key = np.ones(m), np.zeros(m, "int64")
            left = np.where(agreed == 0, share, 0)
            for k in range(bits):
                key = key * 2 + a[:, k]
                _, own, count = np.unique(key, return_inverse=True, return_counts=True)
                share = np.where(count[own] >= 8, count[own] / m, share / 2)
                left = np.where(agreed == k + 1, share, left)
            met += int((n * left <= window).sum())
        chance = min(max(met, 0.5) / (m * TRIALS), 1 - 1e-9)
        return pd.DataFrame({"group": [frame["group"].iloc[0]], "measured": [math.ceil(math.log(miss) / math.log1p(-chance))], "n": [n]})

    return measure


def _keys(bits: int, seed: int):
    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        places = 2 ** np.arange(bits, dtype="int64")[::-1]
        for frame in frames:
            passes = frame["passes"].to_numpy()
            keys = np.zeros((len(frame), passes.max(initial=0)), "int64")
            sizes = frame["vector"].map(len).to_numpy() if len(frame) else np.array([], int)
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                x = np.stack(frame["vector"].iloc[of].to_list()).astype("float64")
                for run in range(passes[of].max()):
                    if (d, run) not in directions:
                        directions[d, run] = np.random.default_rng([seed, d, run]).standard_normal((d, bits))
                    some = passes[of] > run
                    keys[of[some], run] = (x[some] @ directions[d, run] > 0) @ places
            yield pd.DataFrame({"cid": frame["cid"], "label": frame["label"], "dim": sizes.astype("int32"), "keys": [k[:p] for k, p in zip(keys, passes, strict=True)]})

    return keyed


def _compare(threshold: float, window: int, block: int):
    """One block of one pass: links counted for each class, edges that span what is linked, and whether links crowd its window."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        run, first = int(frame["run"].iloc[0]), int(frame["block"].iloc[0]) * block
        pos, cid, copies, label = (frame[c].to_numpy() for c in ("pos", "cid", "copies", "label"))
        places = np.stack(frame["places"].to_list())
        dims = frame["vector"].map(len).to_numpy()
        found_a, found_b, crowd = [], [], np.zeros(len(frame), np.int64)
        for d in np.unique(dims):
            of = np.flatnonzero(dims == d)
            x = np.stack(frame["vector"].iloc[of].to_list()).astype("float64")
            x /= np.linalg.norm(x, axis=1)[:, None]
            for k in range(0, len(of), 256):
                own, near = of[k : k + 256], of[k : k + 256 + window]
                i, j = np.nonzero(x[k : k + 256] @ x[k : k + 256 + window].T >= threshold)
                a, b = own[i], near[j]
                gap = pos[b] - pos[a]
                # This block answers for pairs whose first vector is its own, and that no earlier pass has compared.
                keep = (gap > 0) & (gap <= window) & (pos[a] < first + block) & (label[a] == label[b])
                a, b = a[keep], b[keep]
                crowd += np.bincount(a, minlength=len(frame)) + np.bincount(b, minlength=len(frame))
                if run:
                    new = (np.abs(places[a, :run] - places[b, :run]) > window).all(axis=1)
                    a, b = a[new], b[new]
                found_a.append(a)
                found_b.append(b)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        links = np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
        crowded = 4 * crowd >= window
        some = np.flatnonzero((links > 0) | crowded)
        root = _roots(len(frame), a, b)
        return pd.DataFrame({"a": cid[some], "b": cid[root[some]], "links": links[some].astype("int64"), "crowded": crowded[some]})

    return compare


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest that the pairs lead to."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _meet(threshold: float):
    """Two blocks of one component or label, or one with itself: links counted for each class, and edges that span what is linked."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame["p"].iloc[0], frame["q"].iloc[0]
        frame = frame.sort_values("mine", kind="stable", ignore_index=True)
        n, same = int((frame["mine"] == p).sum()), p == q
        x = np.stack(frame["vector"].to_list()).astype("float64")
        x /= np.linalg.norm(x, axis=1)[:, None]
        copies = frame["copies"].to_numpy().astype("float64")
        links, root = np.zeros(len(x)), np.arange(len(x))
        for k in range(0, n, 256):
            end, first = min(k + 256, n), k if same else n
            near = x[k:end] @ x[first:].T >= threshold
            if same:
                near = np.triu(near, 1)
            links[k:end] += near @ copies[first:]
            links[first:] += copies[k:end] @ near
            i, j = np.nonzero(near)
            root = _roots(len(x), np.concatenate((np.arange(len(x)), i + k)), np.concatenate((root, j + first)))
        some, cid = np.flatnonzero(links), frame["cid"].to_numpy()
        return pd.DataFrame({"a": cid[some], "b": cid[root[some]], "links": links[some].astype("int64")})

    return meet


def _all_pairs(members: DataFrame, threshold: float, paired: int) -> DataFrame:
    """a, b, links of members (cid, root, vector, copies), counted once for each pair of blocks of a root."""
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / paired).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = spread_join(members, blocks, "root").withColumn("mine", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cid", "root", "vector", "copies", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    return dealt.groupBy("root", "p", "q").applyInPandas(_meet(threshold), "a long, b long, links long")


def _with_passes(classes: DataFrame, threshold: float, miss: float, bits: int, window: int, seed: int) -> DataFrame:
    """classes with group (a label's vectors of one length), n (their number) and passes."""
    rows = classes.withColumn("group", F.xxhash64("label", F.size("vector")))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    sized = spread_join(rows, sizes, "group").withColumnRenamed("size", "n")
    large = sized.where(F.col("n") > window + 1)
    drawn = F.pmod(F.xxhash64("cid", F.lit("measure")), F.lit(1 << 40)) < F.lit(float(1 << 40)) * SAMPLE / F.col("n")
    measured = large.where(drawn).select("cid", "group", "n", "vector").groupBy("group").applyInPandas(_measure(threshold, miss, bits, window, seed), "group long, measured int, n long")
    large = spread_join(large.withColumnRenamed("n", "size"), measured, "group").withColumnRenamed("size", "n")
    large = large.withColumn("passes", F.greatest("measured", passes_for(F.col("n"), window=window, threshold=threshold, miss=miss))).drop("measured")
    return sized.where(F.col("n") <= window + 1).withColumn("passes", F.lit(1)).unionByName(large)


def _sorted_passes(classes: DataFrame, threshold: float, miss: float, bits: int, window: int, block: int, paired: int, seed: int) -> DataFrame:
    """What the windows of the sorted passes find, each pair counted once: a, b, links, crowded."""
    sized = cut(_with_passes(classes, threshold, miss, bits, window, seed).select("cid", "group", "n", "passes"))
    whole = (F.col("passes") > MANY) & (F.col("passes") * 2.0 * window >= F.col("n"))
    covered = sized.where(whole).select("cid", F.col("group").alias("root"))
    sized = classes.join(sized.where(~whole).select("cid", "passes"), "cid")
    keyed = sized.select("cid", "label", "vector", "passes").mapInPandas(_keys(bits, seed), "cid long, label long, dim int, keys array<long>")
    # Vectors with one key stand in another order in each pass, so that a dense group's members meet others each time.
    runs = keyed.select("cid", "label", "dim", F.posexplode("keys").alias("run", "key")).withColumn("tie", F.xxhash64("run", "cid"))
    order = ["run", "label", "dim", "key", "tie", "cid"]
    ordered = cut(runs.repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "run", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    # One row per partition of the sort: their number is the session's, not the data's.
    before = ordered.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    places = ordered.join(F.broadcast(before.select("part", "before")), "part").select("cid", "run", (F.col("before") + F.col("at")).alias("pos"))
    places = places.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "pos"))), lambda s: s["pos"]).alias("places"))
    carried = classes.join(places, "cid").select("cid", "label", "vector", "copies", F.explode(F.transform("places", lambda pos, run: F.struct(run.alias("run"), pos.alias("pos"), F.slice("places", 1, run + 1).alias("places")))).alias("p")).select("cid", "label", "vector", "copies", "p.*")
    own = (F.col("pos") / block).cast("long")
    carried = carried.withColumn("block", F.explode(F.when(F.col("pos") % block < window, F.array(own, own - 1)).otherwise(F.array(own)))).where("block >= 0")
    found = carried.groupBy("run", "block").applyInPandas(_compare(threshold, window, block), "a long, b long, links long, crowded boolean")
    if covered.limit(1).count():
        members = cut(classes.join(covered, "cid").select("cid", "root", "vector", "copies"))
        found = found.unionByName(_all_pairs(members, threshold, paired).withColumn("crowded", F.lit(False)))
    return found


def near_groups(vectors: DataFrame, *, threshold: float = THRESHOLD, miss: float = MISS, bits: int = BITS, window: int = WINDOW, block: int = BLOCK, paired: int = PAIRED, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id (the smallest id in reach), kept (it is that one)."""
    if window > block:
        raise ValueError("a block must be as long as the window, or longer")
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    fit = F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("cid", F.when(F.coalesce(fit, F.lit(False)), F.xxhash64("label", "vector")))
    # Labels of any type are ordered and compared by a hash.
    rows = cut(rows.withColumn("label", F.xxhash64("label")))
    usable = rows.where("cid is not null")
    # Copies of one vector are one class; its ids are counted once each, map-side.
    classes = cut(usable.groupBy("cid", "id").agg(F.first("label").alias("label"), F.first("vector").alias("vector")).groupBy("cid").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("low")))
    found = cut(_sorted_passes(classes, threshold, miss, bits, window, block, paired, seed))
    groups = cut(components(found.select("a", "b")))
    # Components in which links crowd a window, with all that belong to them.
    crowded = cut(found.where("crowded").select(F.col("a").alias("node")).distinct().join(groups, "node").select("root").distinct())
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    if crowded.limit(1).count():
        dense = groups.join(crowded, "root", "left_semi")
        members = cut(classes.join(dense.select(F.col("node").alias("cid"), "root"), "cid").select("cid", "root", "vector", "copies"))
        whole = _all_pairs(members, threshold, paired).groupBy("a").agg(F.sum("links").alias("links"))
        counts = counts.join(members.select(F.col("cid").alias("a")), "a", "left_anti").unionByName(whole)
    linked = cut(classes.select("cid", "low").join(groups.select(F.col("node").alias("cid"), "root"), "cid"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"), F.count("*").alias("n"))
    named = spread_join(linked.select("cid", "root"), lowest, "root").select("cid", F.struct("lowest.id").alias("c"))
    answers = classes.select("cid", "copies", "low").join(named, "cid", "left").join(counts.withColumnRenamed("a", "cid"), "cid", "left")
    answers = answers.select("cid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", F.struct("low.id")).alias("c"), F.col("copies").alias("n"))
    out = spread_join(usable.select("id", "cid"), answers, "cid").select("id", "n_links", F.col("c.id").alias("component"))
    out = out.unionByName(rows.where("cid is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept"))
