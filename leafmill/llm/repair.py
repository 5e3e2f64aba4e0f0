"""Repair of conversations whose turns are out of order of roles, repeated, blank or cut off.

A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text stand earlier in the
conversation), truncated (its last such character is none of . ! ?). A repaired conversation has the role initials
(s?(ua)+)?: perhaps a system turn, then users and assistants in turn. Edits and what they cost: Keep 0, Rerole to user or
assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert of an empty user or assistant turn 5; a truncated
row that isn't deleted adds 5. Of the cheapest edits those whose initials, in order, are least in ASCII are taken.

`search` finds them by depth-first branch and bound over one conversation's faults and initials, on an explicit stack.
Lower bounds of every suffix, in which any end is allowed, cut off what can't beat the incumbent; a first incumbent comes
from going down greedily. Prefixes are met in ASCII order, so of two that reach one row and role, the later one is worse
unless it is cheaper: a table of least costs for each row and role eliminates it.

Texts are shuffled once: the search sees a few bytes a row, and its edits then meet the texts in a sorted stream, so no task
holds a conversation's texts; a conversation's faults do stand in one task's memory.

Defined cases: null role or text is one space; rows stand by turn (nulls first), rows of one turn by role and then by a hash
of role and text; an empty role has no initial and counts as illegal beside any; null conv_ids are one conversation; a
conversation without rows costs nothing; repeated rows are duplicates; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import cut

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STUMP = 1, 2, 5, 5
#: Where a repaired conversation may be: at its start, behind the system turn, behind a user's, behind an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_BLANK, _DUPLICATE, _TRUNCATED = "blank", "duplicate", "truncated"


def _bounds(initials: list[str], faults: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Least costs of the rows from each on, where a user must come next, where an assistant must, and at the start; any end goes."""
    n = len(initials)
    user, answer, start = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        u, a, s = DELETE + user[i + 1], DELETE + answer[i + 1], DELETE + start[i + 1]
        if faults[i] not in (_BLANK, _DUPLICATE):
            stump = STUMP if faults[i] == _TRUNCATED else 0
            u = min(u, stump + (initials[i] != "u") * REROLE + answer[i + 1])
            a = min(a, stump + (initials[i] != "a") * REROLE + user[i + 1])
            s = min(s, u, stump + user[i + 1]) if initials[i] == "s" else min(s, u)
        user[i], answer[i] = min(u, INSERT + a), min(a, INSERT + u)
        start[i] = min(s, INSERT + answer[i])
    return user, answer, start


def _children(i: int, q: int, cost: int, initials: list[str], faults: list[str]) -> list[tuple[int, int, int, str]]:
    """What may be done next, in ASCII order of the edits."""
    out = []
    rows = i < len(initials)
    if rows:
        out.append((i + 1, q, cost + DELETE, "D"))
    out.append((i, _NEXT[q], cost + INSERT, "I"))
    if rows and faults[i] not in (_BLANK, _DUPLICATE):
        stays = cost + (STUMP if faults[i] == _TRUNCATED else 0)
        kept = _KEPT.get((q, initials[i]))
        if kept is not None:
            out.append((i + 1, kept, stays, "K"))
        out.append((i + 1, _NEXT[q], stays + REROLE, "R"))
    return out


def search(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """The least cost of a repair and the ASCII-least edits of that cost."""
    n = len(initials)
    user, answer, start = _bounds(initials, faults)
    bounds = (start, user, answer, user)
    # The first incumbent: always the edit that promises the least.
    i, q, limit = 0, START, 0
    while i < n or q in (SYSTEM, USER):
        i, q, limit, _ = min(_children(i, q, limit, initials, faults), key=lambda c: c[2] + bounds[c[1]][c[0]])
    best = [limit + 1] * (4 * (n + 1))
    path: list[str] = []
    audit = ""
    stack = [(0, START, 0, "", 0)]
    while stack:
        i, q, cost, edit, depth = stack.pop()
        # What can't be cheaper than the incumbent goes (as cheap will do until edits are found in ASCII order), and so does
        # what comes to this row and role no cheaper than a prefix before it in ASCII order.
        if cost + bounds[q][i] > limit or cost >= best[4 * i + q]:
            continue
        best[4 * i + q] = cost
        if depth:
            del path[depth - 1 :]
            path.append(edit)
        if i == n and q in (START, ASSISTANT):
            audit, limit = "".join(path), cost - 1
            found = cost
            continue
        for j, r, c, e in reversed(_children(i, q, cost, initials, faults)):
            if c + bounds[r][j] <= limit:
                stack.append((j, r, c, e, depth + 1))
    return found, audit


def faulty(rows: DataFrame) -> DataFrame:
    """Turns with what the search needs: initial, blank, stump (its last word is cut off), mark (a hash of role and text)."""
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("stump"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("mark"),
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("mark")]


def audits(rows: DataFrame) -> DataFrame:
    """Of faulty turns, one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in ("gaps", _BLANK, _DUPLICATE, _TRUNCATED, "illegal", "cost")], T.StructField("audit", T.StringType())])

    def told(conv, turns: set[int], initials: list[str], faults: list[str]) -> tuple:
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:], strict=False))
        return conv, gaps, *(faults.count(f) for f in (_BLANK, _DUPLICATE, _TRUNCATED)), illegal, *search(initials, faults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, seen, initials, faults = (), set(), set(), [], []
        for batch in batches:
            out = []
            for c, turn, copies, initial, blank, stump, mark in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c,) != conv:
                    if conv:
                        out.append(told(conv[0], turns, initials, faults))
                    conv, turns, seen, initials, faults = (c,), set(), set(), [], []
                for _ in range(copies):
                    initials.append(initial)
                    faults.append(_BLANK if blank else _DUPLICATE if mark in seen else _TRUNCATED if stump else "")
                    seen.add(mark)
                if copies and turn is not None:
                    turns.add(turn)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        if conv:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told(conv[0], turns, initials, faults), types, strict=True)], names=schema.names)

    types = [*([pa.int64()] * 7), pa.string()]
    codes = rows.select("conv_id", "turn", "copies", "initial", "blank", "stump", "mark", "role")
    codes = codes.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).drop("role")
    return codes.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations of faulty turns and their `audits`: conv_id, place (from 0), edit (K, R or I), role, text.

    Its partitions hold whole conversations, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, q, place = (), "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal place
                out.append((conv[0], place, edit, role, text))
                place += 1

            def inserts() -> None:
                nonlocal at, q
                while audit[at : at + 1] == "I":
                    q, at = _NEXT[q], at + 1
                    put("I", ROLES[q], "")

            for c, edits, copies, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if edits is not None:
                    if conv:
                        inserts()
                    conv, audit, at, q, place = (c,), edits, 0, START, 0
                    continue
                for _ in range(copies):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        q = _KEPT[q, role[:1]]
                        put(edit, role, text)
                    elif edit == "R":
                        q = _NEXT[q]
                        put(edit, ROLES[q], text)
            if out:
                yield as_batch(out)
        out = []
        while audit[at : at + 1] == "I":
            q, at = _NEXT[q], at + 1
            out.append((conv[0], place, "I", ROLES[q], ""))
            place += 1
        if out:
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    texts = rows.where("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "copies", "role", "text", "turn", "mark")
    heads = found.select("conv_id", "audit", F.lit(0).alias("copies"), *[F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("turn", "long"), ("mark", "string"))])
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.expr("audit is null"), *_order())
    return both.select("conv_id", "audit", "copies", "role", "text").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, over `role:text` by lines, of conversations that stand whole and in order in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made = (), None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
                if (c,) != conv:
                    if conv:
                        out.append((conv[0], made.hexdigest()))
                    conv, made = (c,), hashlib.sha256()
                made.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if out:
                yield as_batch(out)
        if conv:
            yield as_batch([(conv[0], made.hexdigest())])

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of their conversation and turn: dropped (copies 0), emptied, without ends of sentences, repeated, given to the user."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    roll = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(roll == 1, "").when(roll == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(roll == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(roll == 0, 0).when(roll == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text and, if there, copies): what was found and done by conversation, and the repaired turns."""
    rows = faulty(rows)
    found = cut(audits(rows))
    return found, repaired_turns(rows, found)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged and repaired: the columns of `audits`, and repaired_sha256."""
    found, turns = repair(damage(conversations))
    made = digests(turns).withColumnRenamed("conv_id", "_id")
    rows = found.join(made, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return rows.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
