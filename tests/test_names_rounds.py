"""Names of attachments in rounds, against naming them one after another."""

from __future__ import annotations

import random

import pytest

from leafmill.functions.names import attachment_name, fold, with_token
from leafmill.operators import attachments as A

ATTS = "page_id string, att_id string, title string, created_at string, ord bigint"


def one_after_another(rows):
    """rows (page, id, title, created, ord) to names by (page, id, ord)."""
    out, seen = {}, set()
    pages = {}
    for r in sorted(rows, key=lambda r: r[4]):
        if r[1] and (r[0], r[1]) in seen:
            continue
        seen.add((r[0], r[1]))
        pages.setdefault(r[0], []).append(r)
    for page, listed in pages.items():
        keyed = sorted((fold(attachment_name(r[2])), r[3], fold(r[2]), r[1], str(r[4]), r) for r in listed)
        taken, before = {k[0] for k in keyed}, None
        for key, *_, r in keyed:
            name, retry = attachment_name(r[2]), 0
            if key == before:
                name = with_token(attachment_name(r[2]), r[1] or r[2] or "attachment", retry)
                while fold(name) in taken:
                    retry += 1
                    name = with_token(attachment_name(r[2]), r[1] or r[2] or "attachment", retry)
                taken.add(fold(name))
            before = key
            out[page, r[1], r[4]] = name
    return out


def named(spark, rows, **options):
    return {(r.page_id, r.att_id, r.ord): r.local_name for r in A.plan_names(spark.createDataFrame(rows, ATTS), **options).collect()}


def listing(seed, n=600):
    draw = random.Random(seed)
    titles = ["a.png", "A.PNG", "a-1.png", "a-1-1.png", "a-a.png", "a-a.png-1.png", "b", "b-2", "ß.txt", "SS.txt", "a-2.png", ".x", ""]
    return [(f"p{draw.randint(0, 8)}", draw.choice(["", "1", "2", "a.png", str(draw.randint(3, 60))]), draw.choice(titles), draw.choice(["2024", "2025"]), k) for k in range(n)]


@pytest.mark.parametrize("rounds", [A.ROUNDS, 2])
def test_rounds_give_the_names_of_one_after_another(spark, rounds):
    rows = listing(3)
    assert named(spark, rows, rounds=rounds) == one_after_another(rows)


def test_without_clashes_and_empty(spark):
    rows = [("p", "1", "a.png", "2024", 1), ("p", "2", "b.png", "2024", 2), ("q", "1", "a.png", "2024", 3)]
    assert named(spark, rows) == one_after_another(rows)
    assert A.plan_names(spark.createDataFrame([], ATTS)).count() == 0


def test_one_page_with_very_many_clashes(spark):
    rows = [("p", str(k), "same.pdf", "2024", k) for k in range(20000)] + [("p", "", "same.pdf", "2023", 20000 + k) for k in range(300)]
    got = named(spark, rows)
    assert got == one_after_another(rows) and len({fold(n) for n in got.values()}) == len(rows)
