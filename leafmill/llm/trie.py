"""Prefix trie over conversations: which beginnings they share, and what sharing them saves.

A node is a distinct sequence of first turns. Each task takes conversations in runs and builds a z-fast trie over a run: a
compacted trie whose nodes are found in a hash table by their handle, the prefix whose length is the two-fattest number
(divisible by the largest power of two) of those on the node's edge. Where a conversation leaves the trie is found by fat
binary search, in steps logarithmic in its length. A batch of conversations is located before it is inserted, and goes on
from there. Then edges are expanded to one row for each depth, which Spark adds up over the runs: so a beginning that a
third of all conversations share is one row a run.

Prefixes are known by 128 bits, an exclusive or over hashes of each turn and its place. Texts never leave the first stage.
What a subtree adds up to is had without walking it: each node belongs to its smallest member, whose nodes are the end of its
own path, so a member hands one number to each prefix of its path.

Defined cases: null role or text counts as empty; rows stand by turn (nulls first), rows of one turn by role and then by a
hash of role and text; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left
out; an empty table has no nodes, not even a root; other columns are ignored. A conversation's hashes stand in one task's
memory (24 bytes a turn), its text doesn't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WORD, cut, spread_join

#: Turns of a run, conversations of a batch.
RUN, BATCH = 1 << 17, 1 << 12
#: Conversations that share a beginning, and the most turns of it.
GROUP, HEADS = 20, 3


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides; 0 where low is below it."""
    return high & (-1 << ((low ^ high).bit_length() - 1)) if low >= 0 else 0


class Path:
    """A conversation: keys of its prefixes (16 bytes each, from the empty one) and words of each prefix's last turn."""

    __slots__ = ("conv", "keys", "words", "length")

    def __init__(self, conv: int, keys: bytes, words: list[int]):
        self.conv, self.keys, self.words, self.length = conv, keys, words, len(words) - 1

    def key(self, depth: int) -> bytes:
        return self.keys[16 * depth : 16 * depth + 16]


class Node:
    """The prefixes of path with a length in (low, high]; ends and least: conversations that end at high, the smallest."""

    __slots__ = ("low", "high", "path", "parent", "ends", "least")

    def __init__(self, low: int, high: int, path: Path, parent: Node | None):
        self.low, self.high, self.path, self.parent, self.ends, self.least = low, high, path, parent, 0, None

    def end(self, conv: int) -> None:
        self.ends += 1
        self.least = conv if self.least is None else min(self.least, conv)


class Trie:
    """A z-fast trie: nodes by handle, and by the first prefix on their edge."""

    def __init__(self, root: bytes):
        self.root = Node(-1, 0, Path(0, root, [0]), None)
        self.handles, self.edges = {root: self.root}, {}

    def handle(self, node: Node) -> bytes:
        return node.path.key(fattest(node.low, node.high))

    def locate(self, path: Path, node: Node) -> Node:
        """The deepest node that path passes whole, from a node on that it does pass."""
        low, high = node.high, path.length
        while low < high:
            middle = fattest(low, high)
            met = self.handles.get(path.key(middle))
            if met is None:
                high = middle - 1
            elif met.high <= path.length and path.key(met.high) == met.path.key(met.high):
                node, low = met, met.high
            else:
                # The path leaves within met's edge; nothing below it can be passed.
                return met.parent
        return node

    def insert(self, path: Path, node: Node) -> None:
        node = self.locate(path, node)
        if path.length == node.high:
            node.end(path.conv)
            return
        below = self.edges.get(path.key(node.high + 1))
        if below is not None:
            node = self.split(below, path)
            if path.length == node.high:
                node.end(path.conv)
                return
        leaf = Node(node.high, path.length, path, node)
        leaf.end(path.conv)
        self.add(leaf)

    def add(self, node: Node) -> None:
        self.handles[self.handle(node)] = node
        self.edges[node.path.key(node.low + 1)] = node

    def split(self, below: Node, path: Path) -> Node:
        """A node where path leaves the edge of below, put above it."""
        low, high = below.low + 1, min(below.high, path.length)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if path.key(middle) == below.path.key(middle) else (low, middle - 1)
        del self.handles[self.handle(below)]
        upper = Node(below.low, low, below.path, below.parent)
        below.low, below.parent = low, upper
        self.add(upper)
        self.add(below)
        return upper

    def insert_batch(self, paths: list[Path]) -> None:
        places = [self.locate(p, self.root) for p in paths]
        for path, place in zip(paths, places, strict=True):
            self.insert(path, place)

    def expand(self) -> Iterator[tuple[bytes, int, bytes | None, int, int, int, int]]:
        """Of each prefix: key, depth, parent's key, smallest member, members, words of its last turn, words that members hold from there on."""
        below: dict[int, tuple[int, int | None, int]] = {}
        for node in sorted([self.root, *self.edges.values()], key=lambda n: -n.high):
            n, least, held = below.pop(id(node), (0, None, 0))
            n += node.ends
            least = node.least if least is None else least if node.least is None else min(least, node.least)
            path = node.path
            for depth in range(node.high, node.low, -1):
                held += n * path.words[depth]
                if n:
                    yield path.key(depth), depth, path.key(depth - 1) if depth else None, least, n, path.words[depth], held
            if node.parent is not None and n:
                m, other, more = below.get(id(node.parent), (0, None, 0))
                below[id(node.parent)] = m + n, least if other is None else min(other, least), more + held


def _mix(values: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def paths(convs: list[int], turns: list[list[tuple[int, int, int]]]) -> list[Path]:
    """Conversations as paths; a turn is two hashes of it and its words."""
    counts = np.asarray([len(t) + 1 for t in turns])
    starts = np.concatenate(([0], np.cumsum(counts)))
    # The empty prefix stands before each conversation's turns.
    flat = np.asarray([x for t in turns for x in [(0, 0, 0), *t]], np.int64).reshape(-1, 3)
    place = np.arange(len(flat)) - np.repeat(starts[:-1], counts)
    keys = np.empty((len(flat), 2), np.uint64)
    for k in range(2):
        salted = _mix(_mix(place.astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15)) ^ flat[:, k].astype(np.uint64))
        salted[starts[:-1]] = 0
        run = np.bitwise_xor.accumulate(salted)
        before = np.concatenate((np.zeros(1, np.uint64), run))[starts[:-1]]
        keys[:, k] = run ^ np.repeat(before, counts)
    data, words = keys.tobytes(), flat[:, 2].tolist()
    return [Path(c, data[16 * a : 16 * b], words[a:b]) for c, a, b in zip(convs, starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


_PARTS = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("held", pa.int64()), ("path", pa.binary()), ("path_words", pa.list_(pa.int64()))])
_PARTS_SQL = "key binary, depth long, parent binary, conv long, n long, words long, held long, path binary, path_words array<long>"


def parts(turns: DataFrame, *, run: int = RUN, batch: int = BATCH) -> DataFrame:
    """Tries of runs of conversations, as rows: nodes (n: members), and ends (n null): a conversation, its node's key and, if none of its run with this sequence is smaller, its path.

    turns: base, conv_id, turn, role, h1, h2, words, head (turns that conv_id takes from the conversation base).
    """

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        base, heads, conv, own, head = None, [], None, [], 0
        for b in batches:
            for at, c, h1, h2, words, h in zip(*(b.column(x).to_pylist() for x in ("base", "conv_id", "h1", "h2", "words", "head")), strict=True):
                if c != conv:
                    if conv is not None:
                        heads = own[:HEADS] if conv == base else heads
                        yield conv, heads[:head] + own[head:]
                    if at != base:
                        base, heads = at, []
                    conv, own, head = c, [], h
                own.append((h1, h2, words))
        if conv is not None:
            heads = own[:HEADS] if conv == base else heads
            yield conv, heads[:head] + own[head:]

    def trie_rows(convs: list[int], found: list[list]) -> Iterator[pa.RecordBatch]:
        every = paths(convs, found)
        trie = Trie(every[0].key(0))
        for k in range(0, len(every), batch):
            trie.insert_batch(every[k : k + batch])
        rows = [(*r, None, None) for r in trie.expand()]
        least: dict[bytes, int] = {}
        for p in every:
            least[p.key(p.length)] = min(p.conv, least.get(p.key(p.length), p.conv))
        for p in every:
            first = least[p.key(p.length)] == p.conv
            rows.append((p.key(p.length), p.length, None, p.conv, None, None, None, p.keys if first else None, p.words if first else None))
        for k in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + (1 << 14)], strict=True), _PARTS, strict=True)], schema=_PARTS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, found, held = [], [], 0
        for conv, seq in sequences(batches):
            convs.append(conv)
            found.append(seq)
            held += 1 + len(seq)
            if held >= run:
                yield from trie_rows(convs, found)
                convs, found, held = [], [], 0
        if convs:
            yield from trie_rows(convs, found)

    rows = turns.repartition("base").sortWithinPartitions("base", F.expr("conv_id <> base"), "conv_id", F.asc_nulls_first("turn"), "role", "h1", "h2")
    return rows.select("base", "conv_id", "h1", "h2", "words", "head").mapInArrow(build, _PARTS_SQL)


def ends_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: SHA-256 of the ids of all conversations that end there, ascending, joined by commas; ids stream past, sorted."""
    kind = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, None
        for b in batches:
            out = []
            for k, conv in zip(b.column("key").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if k == key:
                    made.update(b",%d" % conv)
                    continue
                if key is not None:
                    out.append((key, made.hexdigest()))
                key, made = k, hashlib.sha256(b"%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([made.hexdigest()])], schema=kind)

    return ends.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, run: int = RUN, batch: int = BATCH) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key. turns: as for `parts`."""
    made = cut(parts(turns, run=run, batch=batch))
    ends = made.where("n is null")
    nodes = cut(made.where("n is not null").groupBy("key").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("held").alias("held"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # A member's own nodes are the last of its path. From them it hands each prefix of the path the words of its own nodes
    # there and below, and a leaf if it ends in one.
    owners = nodes.groupBy("conv").agg(F.count("*").alias("own"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    walks = ends.where("path is not null").select("conv", "path", "path_words").join(owners, "conv")
    # The words of depth i count up to there, but not above the first own node.
    handed = walks.mapInArrow(_handed, "key binary, own_words long, leaves long")
    handed = handed.groupBy("key").agg(F.sum("own_words").alias("own_words"), F.sum("leaves").alias("n_leaves"))
    rows = nodes.join(handed, "key").join(ends_digests(ends.select("key", "conv")), "key", "left")

    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("n"))
    rows = rows.select(F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("held") - F.col("own_words")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "key", "parent")
    below = spread_join(rows.where("parent is not null"), parents, "parent")
    top = rows.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return top.select(*columns).unionByName(below.select(*columns))


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("own_words", pa.int64()), ("leaves", pa.int64())])
    for b in batches:
        keys, words, leaves = [], [], []
        for path, counts, own, leaf in zip(*(b.column(c).to_pylist() for c in ("path", "path_words", "own", "leaf")), strict=True):
            mine = np.asarray(counts)
            mine[: len(mine) - own] = 0
            words += np.cumsum(mine[::-1])[::-1].tolist()
            leaves += [leaf] * len(mine)
            keys += [path[16 * d : 16 * d + 16] for d in range(len(mine))]
            if len(keys) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, words, leaves), schema, strict=True)], schema=schema)
                keys, words, leaves = [], [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, words, leaves), schema, strict=True)], schema=schema)


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as `parts` takes them: each begins with up to three turns of the first conversation of its twenty, in place of its own."""
    conv = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), "conv_id", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), (F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).cast("int").alias("head"),
    )


def share_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie over rebuilt conversations, a row a node."""
    return prefix_trie(hashed_turns(conversations))
