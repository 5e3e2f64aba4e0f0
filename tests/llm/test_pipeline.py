"""The pipeline: each stage's decisions on a small corpus, and the whole on the smallest tables."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
import test_operators as T  # noqa: E402
from leafmill.llm.common import cut  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = list(P.COLUMNS)


def made(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(120):
        letters = ("abcdefg", "rstuvwx")[i % 2]
        rows.append((i, "\n".join(" ".join(word(letters) for _ in range(rng.randint(8, 30))) for _ in range(3)), ("aa", "bb")[i % 2], f"s{i % 4}"))
    rows += [(200, rows[5][1], "bb", "s0"), (201, rows[6][1].replace("a", "b", 1), "aa", "s1"), (202, None, "aa", "s1"), (203, "12 34 !!", None, "s2"), (204, rows[7][1].split("\n")[0] + "\nanother short line of its own here", "bb", "s3")]
    return spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark):
    docs = made(spark)
    first = P.identify_languages(spark, docs, SF)
    assert first.columns == COLUMNS and {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {202, 203}
    assert all(r.lang in ("aa", "bb") for r in first.collect())
    second = P.drop_repeated_lines(spark, first, SF)
    kept = {r.doc_id: r for r in second.collect()}
    assert second.columns == COLUMNS and 200 not in kept and kept[204].text == "another short line of its own here" and kept[204].n_chars == len(kept[204].text)
    third = P.drop_near_copies(spark, first, SF)
    ids = {r.doc_id for r in third.collect()}
    assert third.columns == COLUMNS and 200 not in ids and 5 in ids and len(ids) >= 118
    fourth = P.mix_sources(spark, third, SF)
    assert fourth.columns == COLUMNS and max(r["count"] for r in fourth.groupBy("doc_id").count().collect()) <= 3
    last = P.pack_sequences(spark, fourth, SF)
    assert last.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert last.where("start = 0").count() == fourth.count()


def by_hand(rows):
    """What the first three stages leave of (doc_id, text, lang, source): plain Python over all pairs."""
    told = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    texts = T.brute_lines(told, 1, P.NEAR_LINES)
    # A document of which no line is left goes; an empty line counts as left.
    lines_ = [(i, texts[i, t], s) for i, t, _, s in told if texts[i, t] or t.split("\n") != [x for x in t.split("\n") if x]]
    prints = {i: T.brute_print(t) for i, t, _ in lines_}
    ids = list(prints)
    groups = T.union(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    return {i: t for i, t, _ in lines_}, {i: (t, s) for i, t, s in lines_ if groups[i] == i}


def test_stages_against_plain_versions(spark):
    docs = made(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    second, third = by_hand(rows)
    stage, kept = docs, None
    for name, f in P.STAGES[:3]:
        # Each stage on what the one before kept, written and read as in a run.
        stage = cut(f(spark, stage, SF))
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in stage.collect()} == second
    kept = {r.doc_id: (r.text, r.source) for r in stage.collect()}
    assert kept == third and all(r.n_chars == len(r.text) for r in stage.collect())
    mixed = cut(P.mix_sources(spark, stage, SF))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for t, s in kept.values():
        sizes[s] = sizes.get(s, 0) + size(t)
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        taken[kept[i][1]] = taken.get(kept[i][1], 0) + n * size(kept[i][0])
    want = T.brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(size(t) for t, q in kept.values() if q == s) for s in sizes) and max(copies.values()) <= 3
    tokenizer = Tokenizer.from_file(T.TOKENIZER)
    pieces = Counter()
    for i, n in copies.items():
        pieces[i] += n * (len(tokenizer.encode(kept[i][0], add_special_tokens=False).ids) + 1)
    packed = P.pack_sequences(spark, mixed, SF).collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == pieces
    spots = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all((b[0] != a[0] and b[1] == 0) or (b[0] == a[0] and b[1] == a[1] + a[2]) for a, b in zip(spots, spots[1:], strict=False))


def test_stages_with_nulls_and_repeated_rows(spark):
    docs = made(spark).unionByName(made(spark).limit(3))
    docs = docs.withColumns({"doc_id": F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("doc_id")), "source": F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source"))})
    for _, f in P.STAGES:
        docs = cut(f(spark, docs, SF))
    assert docs.where("start = 0").count() > 80 and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


@pytest.mark.parametrize("label", [None, "und"])
def test_unlabelled_documents_stay(spark, label):
    docs = made(spark)
    kept = P.identify_languages(spark, docs.withColumn("lang", F.lit(label).cast("string")), SF)
    assert kept.columns == COLUMNS and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {202, 203}


@pytest.mark.parametrize("name", ["language", "near_dedup", "packing"])
def test_texts_go_to_python_in_small_batches(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(P.STAGES)[name](spark, made(spark), SF)
    texts = spark.range(0, 32, 1, 1).select(F.repeat(F.lit("ab "), 200_000).alias("text"))
    sizes = texts.mapInPandas(lambda frames: (f.assign(n=f["text"].str.len().sum())[["n"]].head(1) for f in frames), "n long").collect()
    assert sum(r.n for r in sizes) == 32 * 600_000 and max(r.n for r in sizes) < 5 << 20


def test_training_starts_no_workers_of_its_own(spark, monkeypatch):
    docs = cut(made(spark))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows made of a list go through Python workers"))
    assert P.language.train(docs) is not None


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "packing"] and P.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    assert P.run(spark, SF).count() > 50


def test_empty(spark):
    docs = made(spark).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
