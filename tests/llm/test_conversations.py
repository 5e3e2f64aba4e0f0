"""Conversation operators against plain Python over all rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from leafmill.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


# ---- prefix trie


def plain_trie(rows):
    own = {}
    for r in by_turn([r for r in rows if r[0] is not None]):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, cs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(q != p and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == prefix)))
        out.append((min(cs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(cs), len(children), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def nodes(spark, rows, **sizes):
    made = trie.prefix_trie(trie.hashed_turns(spark.createDataFrame(rows, SCHEMA)), **sizes)
    return sorted((tuple(r) for r in made.collect()), key=str)


def talk(seed, n, alphabet=3, longest=6):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), draw.choice([None, "", "a b", "c.", "ä  ö"][:alphabet])) for c in range(n) for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("sizes", [{}, {"run": 1, "batch": 1}, {"run": 40, "batch": 3}])
def test_trie_equals_plain_groups(spark, sizes):
    rows = talk(1, 90)
    assert nodes(spark, rows, **sizes) == plain_trie(rows)


def test_trie_edges_negative_ids_gaps_and_nulls(spark):
    # No conversation 40 to take turns from; ids below 0; a null turn first; a row without a conversation.
    rows = [(41, None, "user", "x"), (41, 3, "assistant", "y"), (45, 1, "user", "x"), (-7, 0, "u", "q"), (-27, 0, "u", "q"), (0, 0, "system", "s"), (0, 1, "user", "t"), (19, 5, "user", "t"), (None, 0, "user", "z")]
    assert nodes(spark, rows) == plain_trie(rows)


def test_trie_empty_table(spark):
    assert nodes(spark, []) == []


def test_trie_long_conversations_and_copies(spark):
    # One conversation of 700 turns, its copies, and one that leaves it late; extra columns change nothing.
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(700)]
    rows = [(20 * c, t, *turn) for c in range(1, 6) for t, turn in enumerate(long)] + [(300, t, *turn) for t, turn in enumerate(long[:650])] + [(320, t, "user", "other" if t == 600 else long[t][1]) for t in range(601)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", key string")
    got = sorted((tuple(r) for r in trie.share_beginnings(frame).collect()), key=lambda r: (r[1], r[0]))
    assert len({(r[0], r[1]) for r in got}) == len(got)
    root = got[0]
    assert root[1] == 0 and root[3] == 7 and root[2] is None
    whole = [r for r in got if r[1] == 700]
    assert [(r[3], r[4], r[5], r[7]) for r in whole] == [(5, 0, 1, sha("20,40,60,80,100"))]
    assert [r[7] for r in got if r[1] == 650 and r[0] == 20] == [sha("300")]


def test_fattest():
    for low, high in itertools.combinations(range(70), 2):
        numbers = range(low + 1, high + 1)
        assert trie.fattest(low, high) == max(numbers, key=lambda k: k & -k)
    assert trie.fattest(-1, 5) == 0


# ---- repair


def plain_repair(initials, faults):
    """Every sequence of edits that costs no more than the best so far, breadth first by rows."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    front = {"": [(0, "")]}

    def best(states):
        return {q: [min(found)] for q, found in states.items()}

    def with_inserts(states):
        for _ in range(4):
            more = {q: list(f) for q, f in states.items()}
            for (q, _), (after) in grammar.items():
                if q in states and after != "s":
                    more.setdefault(after, []).extend((c + 5, a + "I") for c, a in states[q])
            states = best(more)
        return states

    front = with_inserts(front)
    for initial, fault in zip(initials, faults, strict=True):
        after = {}
        for q, found in front.items():
            for cost, audit in found:
                after.setdefault(q, []).append((cost + 2, audit + "D"))
                if fault in ("blank", "duplicate"):
                    continue
                stump = 5 if fault == "truncated" else 0
                for (p, letter), r in grammar.items():
                    if p == q and letter == initial:
                        after.setdefault(r, []).append((cost + stump, audit + "K"))
                    if p == q and r != "s":
                        after.setdefault(r, []).append((cost + stump + 1, audit + "R"))
        front = with_inserts(best(after))
    return min(f for q in ("", "a") for f in front.get(q, []))


def test_search_is_optimal():
    draw = random.Random(5)
    for _ in range(3000):
        n = draw.randint(0, 9)
        initials = [draw.choice("uuuaaasx") for _ in range(n)]
        faults = [draw.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        assert repair.search(initials, faults) == plain_repair(initials, faults)


def test_search_of_long_conversations():
    draw = random.Random(6)
    initials = [draw.choice("uas") for _ in range(20000)]
    faults = [draw.choice(["", "blank", "truncated", "duplicate"]) for _ in initials]
    assert repair.search(initials, faults) == plain_repair(initials, faults)
    assert repair.search(["s"] * 3000, [""] * 3000)[0] == plain_repair(["s"] * 3000, [""] * 3000)[0]


def plain_damaged(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ")):
        role, text = (" " if x is None else x for x in (role, text))
        roll = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        convs.setdefault(c, []).extend([(t, "user" if roll == 4 else role, text)] * {0: 0, 3: 2}.get(roll, 1))
    out = []
    for c, turns in convs.items():
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_repair(initials, faults)
        left, lines, last = list(turns), [], ""
        for edit in audit:
            follows = "assistant" if last[:1] == "u" else "user"
            if edit == "I":
                lines.append(f"{follows}:")
                last = follows
                continue
            _, role, text = left.pop(0)
            if edit != "D":
                last = role if edit == "K" else follows
                lines.append(f"{last}:{text}")
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def repaired(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in repair.repair_damaged(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_repair_equals_plain(spark):
    draw = random.Random(7)
    texts = ["Yes.", "No?", "cut off", "", " \n", None, "Well! ", "ü.", "a. b"]
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "user", "system", None, "tool"]), f"{draw.choice(texts) or ''}" if draw.random() < 0.8 else draw.choice(texts)) for c in range(150) for t in draw.sample(range(12), draw.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (900, None, "user", "Hi."), (900, None, "user", "Hi."), (900, 4, "assistant", "Ho.")]
    assert repaired(spark, rows) == plain_damaged(rows)


def test_repair_keeps_conversations_that_lose_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repaired(spark, []) == []


def test_repair_gives_turns_and_ignores_other_columns(spark):
    rows = [(1, 0, "assistant", "A.", "x"), (1, 1, "assistant", "B.", "x"), (1, 2, "user", "C.", "x"), (1, 3, "user", "C.", "x")]
    found, turns = repair.repair(spark.createDataFrame(rows, SCHEMA + ", audit string"))
    assert found.select("cost", "audit").collect() == [(5, "RKDD")]
    assert [tuple(r) for r in turns.orderBy("place").collect()] == [(1, 0, "R", "user", "A."), (1, 1, "K", "assistant", "B.")]


def test_repair_long_conversation(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"turn {t} " * (1 + t % 40) + "." * (t % 5 > 0)) for t in range(3000)]
    assert repaired(spark, rows) == plain_damaged(rows)
