"""Each operator against a brute-force version, and its defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, more columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import extraction, language, licenses, lines, merkle, mixing, packing, simhash, tokens, vectors
from leafmill.llm.common import components

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bits int, size string, bucket int, id string, key int, line string, t string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", 1, "x", 1, "x", "x") for i, t, lang, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "\n".join(words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, rng.choice(("aa", "bb")), f"s{rng.randint(0, 3)}"))
    for i in range(60, 80):
        # Copies with a character or a word changed.
        t = rows[i - 60][1]
        at = rng.randrange(len(t))
        rows.append((i, t[:at] + rng.choice("xyz") + t[at + rng.randint(0, 1) :], "aa", "s0"))
    rows += [(80, None, None, None), (81, "", "aa", None), (82, "   \n\t ", "bb", "s1"), (83, "one", "aa", "s1"), (84, "!!! ???", "aa", "s2"), (85, "Long " * 30_000, "bb", "s0"), (None, "a null id", "aa", "s9"), (3, rows[3][1], rows[3][2], rows[3][3])]
    return rows


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


EMPTY_RUNS = {
    "lines": lambda d: lines.dedup_lines(d),
    "tokens": lambda d: tokens.count_tokens(d, TOKENIZER, 49407),
    "merkle": lambda d: merkle.compare_edits(d),
    "language": lambda d: language.identify(d),
    "simhash": lambda d: simhash.fingerprint_groups(d),
    "packing": lambda d: packing.pack_documents(d, TOKENIZER),
    "mixing": lambda d: mixing.mix(d),
    "licenses": lambda d: licenses.scan_documents(d),
}


@pytest.mark.parametrize("name", EMPTY_RUNS)
def test_empty_table(spark, name):
    assert EMPTY_RUNS[name](docs_of(spark, [])).count() == 0


def test_empty_vectors_and_pages(spark):
    assert vectors.near_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 1


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows, exact_from=1, near_from=1):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, t, *_ in rows:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            s = line.strip(lines.SPACE)
            if len(s) >= exact_from:
                first.setdefault(s, (i is not None, i or 0, no))
    for i, t, *_ in rows:
        kept = []
        for no, line in enumerate((t or "").split("\n")):
            s, at = line.strip(lines.SPACE), (i is not None, i or 0, no)
            earlier = len(s) >= exact_from and first[s] < at
            if len(s) >= near_from:
                earlier = earlier or any(p < at and len(o) >= near_from and one_edit(s, o) for o, p in first.items())
            if not earlier:
                kept.append(line)
        out[i, t] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize(("broadcast", "limits"), [(lines.BROADCAST, (1, 1)), (0, (1, 1)), (lines.BROADCAST, (3, 20))])
def test_lines(spark, corpus, monkeypatch, broadcast, limits):
    monkeypatch.setattr(lines, "BROADCAST", broadcast)
    rng = random.Random(1)
    base = "".join(rng.choice("abcd ") for _ in range(90)).replace(" ", "e")
    more = [(100, base, "aa", "s0"), (101, base + "\n" + base[:40] + base[41:], "aa", "s0"), (102, base[:89] + "z\nshort\nshort", "aa", "s0"), (103, "q" + base, "aa", "s0"), (104, base[:20] + "zz" + base[20:], "aa", "s0"), (105, "  " + base + "  ", "aa", "s0"), (106, "b" * 50 + "\n" + "b" * 51 + "\n" + "b" * 53, "aa", "s0")]
    more += [(107, "a\nb\nab\nabc\n\n\n7.\n8.\nab \r\n\tab", "aa", "s0"), (108, base + "\r\n \x0b" + base[1:], "aa", "s0"), (109, "été\nete\nét\nétés", "aa", "s0"), (110, "word " * 12_000 + "x\n" + "word " * 12_001 + "y", "aa", "s0"), (111, "word " * 12_000 + "y", "aa", "s0")]
    rows = corpus + more
    got = {(r.doc_id, r.n_chars): (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs_of(spark, rows), exact_from=limits[0], near_from=limits[1]).collect()}
    want = brute_lines(rows, *limits)
    for i, t, *_ in rows:
        assert got[i, len(t or "")][0] == want[i, t], i
    assert got[104, 92][2] == 0 and got[101, len(more[1][1])][2] == 2 and got[80, 0] == (None, 0, 0)
    assert got[106, 156][0] == "b" * 50 + "\n" + "b" * 53


def test_lines_of_one_text_with_very_many(spark):
    text = "\n".join(f"line {k} of a text with very many lines" for k in range(60_000)) + "\nline 7 of a text with very many lines"
    r = lines.dedup_lines(docs_of(spark, [(1, text, "aa", "s")]), near_from=1000).first()
    assert (r.n_lines, r.n_dropped) == (60_001, 1) and r.text == text[: text.rindex("\n")]


# 2


def test_tokens(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rows = [*corpus, (200, "a <|endoftext|> b", "aa", "s0")]
    for block, run in ((7, 2), (1 << 16, 1024)):
        got = by_id(tokens.count_tokens(docs_of(spark, rows), TOKENIZER, 49407, block=block, run=run), "n_tokens")
        want = sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))
        assert got == want


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("span", [1 << 26, 100])
def test_token_files(spark, tmp_path, width, span):
    rng = np.random.default_rng(3)
    want = []
    for k in range(3):
        ids = rng.integers(0, 20, 1000)
        if k == 1:
            ids[-1] = 7
        ids.astype(f"<u{width}").tofile(tmp_path / f"{k}.bin")
        ends = np.flatnonzero(ids == 7)
        bounds = [-1, *ends] + ([len(ids)] if len(ends) == 0 or ends[-1] + 1 < len(ids) else [])
        want += [(f"{k}.bin", n, a + 1, b - a - 1, b < len(ids)) for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    (tmp_path / "3.bin").write_bytes(b"")
    found = tokens.search(tokens.blocks_of_files(spark, str(tmp_path), width=width, block=13, span=span), 7, width=width)
    got = [(os.path.basename(r.file), r.doc_in_file, r.start, r.n_tokens, r.closed) for r in tokens.count_documents(found, run=3).collect()]
    assert sorted(got) == sorted(want)


def test_a_block_of_empty_documents(spark, tmp_path):
    np.full(1 << 17, 7, "<u2").tofile(tmp_path / "0.bin")
    found = tokens.search(tokens.blocks_of_files(spark, str(tmp_path)), 7)
    assert tuple(tokens.count_documents(found).agg(F.count("*"), F.max("n_tokens"), F.max("start")).first()) == (1 << 17, 0, (1 << 17) - 1)


def test_wide_ids_are_not_wrapped(spark):
    docs = docs_of(spark, [(1, "a b", "aa", "s"), (2, None, "aa", "s")])
    found = tokens.search(tokens.blocks_of_texts(docs, TOKENIZER, 70_000, width=4), 70_000, width=4)
    assert sorted(r.n_tokens for r in tokens.count_documents(found).collect()) == [0, 2]
    with pytest.raises(Exception, match="out of bounds|four bytes"):
        tokens.search(tokens.blocks_of_texts(docs, TOKENIZER, 70_000, width=2), 70_000).collect()


# 3


def test_merkle(spark, corpus):
    rows = corpus[:-1]
    got = {r.doc_id: r for r in merkle.compare_edits(docs_of(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 4] + nxt[: n // 4]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)
        assert 0 <= got[i].near_next <= got[i].near_edited or n < 40 or got[i].near_edited >= 0.5
    assert len({r.fingerprint for r in got.values()}) == len({r[1] or "" for r in rows})


def test_merkle_buckets_agree(spark, monkeypatch):
    rows = docs_of(spark, [(i * 7 % 101, f"text {i} " * 9, "aa", "s") for i in range(101)])
    one = by_id(merkle.compare_edits(rows), "edited_sha256", "near_next")
    monkeypatch.setattr(merkle, "BUCKET_DOCS", 3)
    assert by_id(merkle.compare_edits(rows), "edited_sha256", "near_next") == one


def test_merkle_names_the_branch(spark):
    a, b = "p one\np two\n\nsecond section\nlast", "p one\np 2\n\nsecond section\nlast\nmore"
    df = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
    trees = df.select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    assert [tuple(x) for x in trees.select(merkle.differing(F.col("a"), F.col("b"))).first()[0]] == [(0, 1), (1, 2)]
    assert trees.select(merkle.differing(F.col("a"), F.col("a"))).first()[0] == []


def brute_runs(text):
    return [[[xxhash.xxh64_intdigest(r.encode(), 42) for r in re.findall(r"(?:\S++\s*+){1,4}+|\s++", p, re.A)] for p in s.split("\n")] for s in text.split("\n\n")]


def brute_likeness(a, b):
    a, b = ({r & 0x7FFFFFFF for s in brute_runs(t) for p in s for r in p} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute_differing(a, b):
    a, b = brute_runs(a), brute_runs(b)
    at = lambda t, i: t[i] if i < len(t) else None
    return [(i, j) for i in range(max(len(a), len(b))) for j in range(max(len(at(a, i) or []), len(at(b, i) or []))) if at(at(a, i) or [], j) != at(at(b, i) or [], j)]


def test_merkle_likeness_by_brute_force(spark, corpus):
    # Texts of one id, and rows that stand twice, follow each other in some order: here ids are made unique.
    rows = [(k, r[1], r[2], r[3]) for k, r in enumerate(corpus)]
    got = {r.doc_id: r for r in merkle.compare_edits(docs_of(spark, rows)).collect()}
    for k, t, *_ in rows:
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[k].near_edited == pytest.approx(brute_likeness(t, edited)) and got[k].near_next == pytest.approx(brute_likeness(t, nxt))
        assert [tuple(d) for d in got[k].differing] == brute_differing(t, edited)


def test_merkle_of_repeated_rows(spark):
    rows = [(1, "a b c d", "aa", "s")] * 3 + [(2, "x y z w", "aa", "s"), (None, "n", "aa", "s"), (None, "n", "aa", "s")]
    got = by_id(merkle.compare_edits(docs_of(spark, rows)), "near_next")
    # A row's copy is its next one; only the last of them goes on.
    assert got == [(None, 0.0), (None, 1.0), (1, 0.0), (1, 1.0), (1, 1.0), (2, 0.0)]


# 4


def test_language(spark):
    rng = random.Random(2)
    make = {"aa": "abcde", "bb": "vwxyz", "cc": "éàèùô"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(make))
        rows.append((i, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(rng.randint(1, 60))), lang, "s"))
    rows += [(1000, None, "aa", "s"), (1001, "123 !!", "aa", "s"), (1002, "", None, "s"), (None, "abcde abcde", "aa", "s"), (1003, "vwxyz " * 50_000, None, "s")]
    got = {r.doc_id: r for r in language.identify(docs_of(spark, rows)).collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held) and not got[None].held_out
    right = [got[i].lang_pred == lang for i, t, lang, _ in held if i < 1000]
    assert sum(right) / len(right) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "bb" and 0 < got[1003].score <= 1


def test_language_without_labels(spark):
    got = language.identify(docs_of(spark, [(1, "abc", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_language_ties_and_clashing_names(spark):
    # As many labels as the sample has room for, one text under two labels, and columns named as the answers are.
    rows = [(i, "abcde fghij " * 3, f"l{i % 40}", "s") for i in range(400)]
    docs = docs_of(spark, rows).withColumns({"_told": F.lit(1), "told": F.lit(2), "row": F.lit(3), "lang_pred": F.lit("x"), "score": F.lit("y")})
    network = language.train(docs)
    assert network.languages == sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2})
    got = language.predict(docs, network)
    assert {"_told", "told", "row"} < set(got.columns) and got.columns.count("score") == 1
    assert len({(r.lang_pred, round(r.score, 4)) for r in got.collect()}) == 1


def test_language_learns_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_DOCS", 10)
    docs = docs_of(spark, [(i, f"word{i % 30} " * 5, f"l{i % 30}", "s") for i in range(3000)])
    assert len(language.train(docs).languages) == 30


def test_language_sees_every_label(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_DOCS", 10)
    seen = []
    monkeypatch.setattr(language.Network, "fit", lambda self, windows, targets: seen.append(targets.tolist()))
    rows = [(i, f"word{i % 30} " * 5, f"l{i % 30}", "s") for i in range(3000)] + [(1, "word1 " * 5, "l1", "s")] * 500
    network = language.train(docs_of(spark, rows))
    # One document a label, two windows each.
    assert sorted(seen[0]) == sorted(2 * list(range(len(network.languages)))) and len(network.languages) == 30


# 5


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (center + rng.standard_normal(16) * rng.choice([0.05, 0.25])).tolist(), int(c % 3)))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[5][1], None), (2005, [1.0, 2.0], 1), (2006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cid", F.lit(3)).withColumn("links", F.lit("x"))
    got = {r.vec_id: r for r in vectors.near_groups(df).collect()}
    good = [r for r in rows if r[0] < 2000]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(near, False)
    assert [got[r[0]].n_links for r in good] == near.sum(axis=1).tolist()
    root = np.array([r[0] for r in good])
    for _ in range(50):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(good))])
    assert [got[r[0]].component_id for r in good] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2000, 2007))


def brute_vectors(x, labels, threshold=0.93):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = [(i, j) for i, j in np.argwhere(x @ x.T >= threshold).tolist() if i != j and labels[i] == labels[j]]
    root = {i: i for i in range(len(x))} | union(range(len(x)), pairs)
    return np.bincount([i for i, _ in pairs], minlength=len(x)).tolist(), [root[i] for i in range(len(x))]


@pytest.mark.parametrize(("window", "block"), [(2048, 2048), (32, 64)])
def test_vectors_of_many_blocks(spark, window, block):
    # Small windows: several passes, crowded windows, and components in blocks of 37.
    rng = np.random.default_rng(10)
    x = np.repeat(rng.standard_normal((60, 12)), 8, axis=0) + rng.standard_normal((480, 12)) * 0.2
    x = np.concatenate([x, np.ones((150, 12)) + rng.standard_normal((150, 12)) * 0.1])
    # Labels of unequal sizes get unequal numbers of passes.
    labels = [0 if i % 2 else 1 if i % 16 else 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, v, labels[i]) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_groups(df, window=window, block=block, miss=0.0001, paired=37).collect()}
    links, roots = brute_vectors(x, labels)
    assert [got[i].component_id for i in range(len(x))] == roots
    assert [got[i].n_links for i in range(480, len(x))] == links[480:]
    assert sum(got[i].n_links for i in range(480)) >= 0.99 * sum(links[:480])
    if window > len(x):
        assert [got[i].n_links for i in range(len(x))] == links


def test_vectors_of_one_dense_group(spark):
    # More near copies than windows hold, at the settings in use.
    rng = np.random.default_rng(9)
    x = np.ones((10_000, 8)) + rng.standard_normal((10_000, 8)) * 0.02
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = vectors.near_groups(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (9999, 9999, 0, 1)


def test_vectors_of_one_large_label(spark, tmp_path):
    # 1,500 pairs just above the threshold among 200,000 vectors of one label, at the settings in use.
    rng = np.random.default_rng(12)
    n, pairs, d = 200_000, 1500, 32
    x = rng.standard_normal((n, d))
    y = rng.standard_normal((pairs, d))
    at = x[:pairs] / np.linalg.norm(x[:pairs], axis=1)[:, None]
    y -= (y * at).sum(axis=1)[:, None] * at
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = 0.9305 * at + np.sqrt(1 - 0.9305**2) * y
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(n + pairs), "embedding": list(np.concatenate([x, near])), "label": np.ones(n + pairs, "int32")}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(16)
    got = vectors.near_groups(df).where(f"vec_id >= {n}").where(f"component_id = vec_id - {n} and n_links >= 1").count()
    assert got >= 0.99 * pairs


@pytest.mark.parametrize(("shared", "n"), [(0.5, 60_000), (0.88, 60_000), (0.925, 8_000)])
def test_vectors_that_share_a_direction(spark, tmp_path, shared, n):
    # Pairs just above the threshold in one label, whose vectors have `shared` as their cosine on average.
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(13)
    pairs, d = 600, 64
    x = rng.standard_normal((n, d))
    x[:, 0] = 0
    x = np.sqrt(1 - shared) * x / np.linalg.norm(x, axis=1)[:, None]
    x[:, 0] = np.sqrt(shared)
    aside = x[1000 : 1000 + pairs] - x[2000 : 2000 + pairs]
    aside -= (aside * x[:pairs]).sum(axis=1)[:, None] * x[:pairs]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    near = 0.932 * x[:pairs] + np.sqrt(1 - 0.932**2) * aside
    pq.write_table(pa.table({"vec_id": np.arange(n + pairs), "embedding": list(np.concatenate([x, near])), "label": np.ones(n + pairs, "int32")}), tmp_path / "v.parquet")
    got = {r.vec_id: r.n_links for r in vectors.near_groups(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)).where(f"vec_id >= {n}").collect()}
    unit = np.concatenate([x, near])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit[n:] @ unit.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum()
    assert all(got[n + k] <= want[k] for k in range(pairs))


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    got = vectors.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got))) == sorted(map(str, [(1, 1, 1), (1, 1, None), (2, 1, 1), (2, 1, 1), (None, 1, None)]))


# 6


def brute_print(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = {r.doc_id: r for r in simhash.fingerprint_groups(docs_of(spark, rows)).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = list(prints)
    groups = union(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {i: r.component_id for i, r in got.items()} == groups


@pytest.mark.parametrize("block", [4096, 16])
def test_simhash_links_lose_nothing(spark, block):
    rng = random.Random(7)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    dense = rng.getrandbits(64)
    values |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits bigint")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, block=block).collect()]
    assert all((a ^ b).bit_count() <= 4 or True for a, b in edges)
    want = union(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4])
    assert union(values, edges) == want


def test_one_of_each(spark):
    text = "a quick brown fox jumps over the lazy dog again and again today"
    kept = simhash.one_of_each(docs_of(spark, [(5, text, "aa", "s"), (2, text, "aa", "s"), (2, text, "aa", "s"), (9, "something else entirely written here by hand", "aa", "s")])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9]


def test_one_of_each_with_null_and_shared_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    # A group with a null id, other texts with null ids, one id with two texts, and a row that stands twice.
    rows = [(None, a), (7, a), (8, a), (None, b), (None, c), (5, d), (5, "one more text by hand"), (5, d), (6, "of its own")]
    kept = simhash.one_of_each(docs_of(spark, [(i, t, "aa", "s") for i, t in rows])).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(None, a), (None, b), (None, c), (5, d), (5, "one more text by hand"), (6, "of its own")]))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == union(ids, pairs)


# 7

PARAGRAPH = "The house of the man in the town is one of the best and it was built by a friend of his."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (f"<nav><ul><li><a href=a>Home</a></ul></nav><article><h1>Head &amp; line</h1><p>{PARAGRAPH}<br>on</p><p>Short.</article><footer>&copy; x</footer>", f"Head & line\n\n{PARAGRAPH} on\n\nShort."),
        (f"<div class='site-header'>Site</div><div id=main><p>{PARAGRAPH}</p><p>tail</p></div><div class='cookie-notice'>We use cookies</div>", f"{PARAGRAPH}\n\ntail"),
        (f"<article><p>a &lt; b</p><aside>{PARAGRAPH}</aside><form><p>Name</form><section class='comments'><p>{PARAGRAPH}</section><p>end</p></article>", "a < b\n\nend"),
        (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no --><p>{PARAGRAPH}", PARAGRAPH),
        ("<ul><li><a href=a>one</a><li><a href=b>two</a></ul>", ""),
        (f"<article><p>x\n  y&nbsp;z</p><div class=ad>{PARAGRAPH}</div></article>", "x y z"),
        ("<article>" + "<p>word " * 20_000 + "</article>", "\n\n".join(["word"] * 20_000)),
    ],
)
def test_extraction(html, text):
    assert extraction.main_text(html) == text


POLISH = "Stary dom nad rzeką stoi pusty od wielu lat, choć jego okna wciąż odbijają każde zachodzące słońce."
CHINESE = "这座老房子多年来一直空着，但它的窗户每天傍晚仍然映照着落日的余晖和远处的河流。"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<html><head><title>T</title><meta charset=utf-8><body><article><p>{PARAGRAPH}</article>", PARAGRAPH),
        (f"<html><head class=menu><title>T</title><link href=a><article><p>{PARAGRAPH}</article>", PARAGRAPH),
        (f"<article><svg/><p>{PARAGRAPH}</p><iframe src='a' /><p>on</p></article>", f"{PARAGRAPH}\n\non"),
        (f"<article><svg viewBox='0'><p>{PARAGRAPH}</p><select><option>x<p>on</p></article>", f"{PARAGRAPH}\n\nx\n\non"),
        (f"<article><script>var a = 1;<p>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<article><iframe src=http://a/>no</iframe><p>{PARAGRAPH}</p><svg><text>no</text></svg></article>", PARAGRAPH),
        (f"<nav><a href=a>Start</a></nav><div><h1>Dom</h1><p>{POLISH}</p><p>{POLISH}</p></div><footer>{POLISH}</footer>", f"Dom\n\n{POLISH}\n\n{POLISH}"),
        (f"<div><p>{CHINESE}</p></div><div><a href=a>{CHINESE}</a></div>", CHINESE),
    ],
)
def test_extraction_loses_no_page(html, text):
    assert extraction.main_text(html) == text


GREEK = "Το παλιό σπίτι δίπλα στο ποτάμι μένει άδειο εδώ και πολλά χρόνια, αλλά τα παράθυρά του ακόμη καθρεφτίζουν τον ήλιο που δύει κάθε βράδυ."
GEORGIAN = "ძველი სახლი მდინარის პირას მრავალი წელია ცარიელი დგას, მაგრამ მისი ფანჯრები ყოველ საღამოს ისევ ირეკლავს ჩამავალ მზეს და შორეულ მთებს."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # An attribute's value isn't an attribute.
        (f'<article><p title="a hidden thing">{PARAGRAPH}</p><p hidden>no</p><p hidden="">no</p></article>', PARAGRAPH),
        # Subjects of an article that are named as parts of pages are elsewhere.
        (f'<article><div class="social-history"><p>{PARAGRAPH}</p></div><section id="legal"><p>{PARAGRAPH}</p></section></article><div id="legal"><p>{PARAGRAPH}</p></div>', f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f'<article><p>{PARAGRAPH} <span class="advert">Buy <span>now</span> this</span>and more.</p></article>', f"{PARAGRAPH} and more."),
        (f'<article><h2><a href="x">A linked heading</a></h2><p>{PARAGRAPH}</p></article>', f"A linked heading\n\n{PARAGRAPH}"),
        (f'<div class="ad-free-reading"><p>{PARAGRAPH}</p></div><div class="ad-slot"><p>{PARAGRAPH}</p></div><div id="postComments"><p>{PARAGRAPH}</p></div>', PARAGRAPH),
        (f'<div class="entry-header"><h1>Title</h1></div><div><p>{PARAGRAPH}</p></div>', f"Title\n\n{PARAGRAPH}"),
        (f"<div><p>{GREEK}</p></div><div>{PARAGRAPH}</div>", f"{GREEK}\n\n{PARAGRAPH}"),
        (f"<div><p>{GEORGIAN}</p></div><div>{PARAGRAPH}</div>", f"{GEORGIAN}\n\n{PARAGRAPH}"),
        ("<article>" + "<div>" * 5000 + PARAGRAPH + "</div>" * 5000 + "</article>", PARAGRAPH),
        (f'<article><p data-x="{"y" * 1_000_000}">{PARAGRAPH}</p><p {"z " * 10_000}>end</p></article>', f"{PARAGRAPH}\n\nend"),
    ],
)
def test_extraction_by_density_first(html, text):
    assert extraction.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # Forms, and names of a layout, that go around a whole page.
        (f"<form id=aspnetForm><nav><a href=a>Home</a></nav><div><h1>Head</h1><p>{PARAGRAPH}</p></div><div class=sidebar><p>{PARAGRAPH}</p></div></form>", f"Head\n\n{PARAGRAPH}"),
        (f"<fieldset><article><p>{PARAGRAPH}</p></article></fieldset>", PARAGRAPH),
        (f'<div class="content left-sidebar"><p>{PARAGRAPH}</p></div><footer>{PARAGRAPH}</footer>', PARAGRAPH),
        (f"<div><p>{PARAGRAPH}</p></div><form><p>{PARAGRAPH}</p><input name=a></form>", PARAGRAPH),
        # Readers' comments, whatever they are called.
        *((f'<article><p>{PARAGRAPH}</p><div class="{name}"><p>{PARAGRAPH}</p></div></article>', PARAGRAPH) for name in ("user-comments", "reader-comments", "replies", "related", "related-posts")),
        (f'<div class="post comments-open"><h2 id="comments">Comments of the king</h2><p>{PARAGRAPH}</p></div>', f"Comments of the king\n\n{PARAGRAPH}"),
        # Notices and rails without a name, outside of the article.
        (f"<div><p>We use cookies. {PARAGRAPH}</p></div><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><div><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p><p><a href=x>{PARAGRAPH}</a></p></article>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        # A quote that is never closed, a tag that never ends.
        (f"<article><p title='x>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><a href=", PARAGRAPH),
    ],
)
def test_extraction_of_parts_around_a_page(html, text):
    assert extraction.main_text(html) == text


@pytest.mark.parametrize("piece", ["<a ", '<p title="', "<!", "</", "<a y='>' ", '<a x=">" ', "<script>", "<!--", "&amp;<b>", "<div class='"])
@pytest.mark.parametrize("end", ["", "'", '"', ">"])
def test_extraction_in_linear_time(piece, end):
    page = piece * (1_000_000 // len(piece)) + end
    began = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - began < 5


def test_extraction_of_unmatched_ends():
    began = time.process_time()
    assert extraction.main_text("<div>" * 100_000 + "</p>" * 100_000 + PARAGRAPH) == PARAGRAPH
    assert time.process_time() - began < 5


class PlainReader(HTMLParser):
    """Blocks and the first pass of the plainest pages, by the standard library's parser and the rules' own words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.rows, self.text, self.linked = [], [], "", 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            if self.open[-1:] == ["p"] and "article" in self.open and plain_length(text) >= 60:
                # A paragraph of an article may be one link.
                self.linked = 0
            self.rows.append((text, self.linked, any(t in ("nav", "aside", "footer") for t in self.open), "article" in self.open, self.open[-1:] in (["h1"], ["h2"])))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.flush()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if "a" in self.open else 0


def plain_length(text):
    return len(text) + sum(2 for c in text[:60] if "\u2e80" <= c <= "\ud7ff")


def plain_first(text, linked, bad, heading):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    known = [w for w in words if w in extraction.STOP]
    length = plain_length(text)
    marks = [c for c in text if c in ".!?;,:。！？、，．؟،।"]
    rules = (
        (bad, False),
        (heading, None),
        (2 * linked > len(text), False),
        (length < 60, None),
        (known and len(known) / len(words) >= 0.12, True),
        (known, None),
        (len(text) >= 120 and len(marks) / len(text) >= 0.005, True),
    )
    return next((label for holds, label in rules if holds), None)


def test_first_pass_against_a_plain_version():
    rng = random.Random(23)
    texts = (PARAGRAPH, "short", "Home page", POLISH, CHINESE, GREEK, GEORGIAN, "one two three " * 12, "a &amp; b &lt; c")
    for _ in range(300):
        page, inside = "", False
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.2:
                page += "</article>" if inside else "<article>"
                inside = not inside
            tag, around, text = rng.choice(("p", "div", "h2", "li")), rng.choice(("", "", "", "nav", "aside", "footer")), rng.choice(texts)
            text = rng.choice((text, text, f"<a>{text}</a>", f"<b>{text[:9]}</b> <a>{text[9:]}</a>" if "&" not in text else text))
            block = f"<{tag}>{text}</{tag}>"
            page += f"<{around}>{block}</{around}>" if around else block
        page += "</article>" * inside
        reader = PlainReader()
        reader.feed(page)
        reader.close()
        reader.flush()
        rows = reader.rows
        first = [plain_first(t, k, bad, heading) for t, k, bad, _, heading in rows]
        size = [sum(len(b[0]) for b, x in zip(rows, first, strict=True) if x and b[3] == where) for where in (True, False)]
        outside = 2 * size[0] > size[1]
        rows = [(t, k, bad or outside and not article, article, heading) for t, k, bad, article, heading in rows]
        got = extraction.blocks(page)
        assert [(b[0], *b[2:]) for b in got] == [(b[0], *b[2:]) for b in rows], page
        assert [extraction._decided(b[0], b[1], b[2], b[4]) for b in got] == [plain_first(b[0], b[1], b[2], b[4]) for b in got], page


def plain_labels(found):
    """The second pass, looking at every pair of blocks."""
    first = [extraction._decided(t, k, bad, h) for t, k, bad, _, h in found]
    if True not in first:
        first = [True if x is None and not b[4] and extraction._long(b[0]) else x for x, b in zip(first, found, strict=True)]
    out = []
    for k, b in enumerate(found):
        if first[k] is not None:
            out.append(first[k])
            continue
        near = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(found) and found[j][3] == b[3] and (first[j] is None or found[j][2]):
                j += step
            if 0 <= j < len(found) and found[j][3] == b[3]:
                near.append((abs(k - j), first[j] != b[3], first[j]))
            elif b[3] or 0 <= j < len(found):
                # The article's edge.
                near.append((abs(k - j), False, b[3]))
        out.append(bool(near and min(near)[2]))
    return out


def test_extraction_against_a_plain_version():
    rng = random.Random(21)
    for _ in range(400):
        found = []
        inside = False
        for _ in range(rng.randint(0, 14)):
            inside = inside if rng.random() < 0.7 else not inside
            t = rng.choice((PARAGRAPH, "short", "Home page", POLISH, CHINESE, GREEK, "one two three " * 12))
            found.append((t, rng.choice((0, 0, 0, len(t))), rng.random() < 0.2, inside, rng.random() < 0.15))
        assert extraction.labels(found) == plain_labels(found)


def test_extraction_of_labelled_pages():
    rng = random.Random(22)
    bodies = [PARAGRAPH, POLISH, CHINESE, GREEK, GEORGIAN, "Das alte Haus an dem Fluss steht seit vielen Jahren leer, und doch ist es nicht vergessen.", "La vieille maison est vide depuis des années, mais les gens du village ne sont pas partis."]
    links = lambda n: "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(n))
    for k in range(200):
        body = rng.choice(bodies)
        parts = [f"Part {j}" if rng.random() < 0.2 else body for j in range(rng.randint(2, 6))]
        parts[rng.randrange(len(parts))] = body
        shown = "".join(f"<h2>{p}</h2>" if p.startswith("Part") else f"<p>{p}</p>" for p in parts)
        noise = f"<aside><p>{PARAGRAPH}</p></aside>" if rng.random() < 0.5 else f'<div class="cookie-banner"><p>{PARAGRAPH}</p></div>'
        comments = f'<section class="comments"><p>{rng.choice(bodies)}</p></section>'
        page = (
            f"<html><head><title>t</title></head><body><header><p>{PARAGRAPH}</p></header><nav><ul>{links(5)}</ul></nav><article>{shown}{comments}</article>{noise}<footer>{PARAGRAPH}</footer></body></html>",
            f'<body><div class="navbar"><ul>{links(4)}</ul></div><main>{noise}{shown}</main>{comments}<div id="footer">{PARAGRAPH}</div>',
            f'<body><ul class="menu">{links(3)}</ul><div id="content">{shown}</div>{noise}{comments}<form><p>{PARAGRAPH}</p></form>',
        )[k % 3]
        assert extraction.main_text(page) == "\n\n".join(parts), page


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "x"), (1, "u", "<article><p>é</p></article>", "x"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect()]
    assert sorted(got) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]


# 8


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs_of(spark, corpus), TOKENIZER, capacity=256).collect()
    want = sorted(((i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in corpus), key=str)
    pieces = sorted((i, k, len(ids[k : k + 256]), zlib.crc32(np.asarray(ids[k : k + 256], "<u4").tobytes()), len(ids)) for i, ids in ((str(i), ids) for i, ids in want) for k in range(0, len(ids), 256))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) / (256 * len(sequences)) > 0.97


def test_packing_of_very_many_copies(spark, monkeypatch):
    # Rows that agree in all columns don't all go to one group.
    monkeypatch.setattr(packing, "GROUP", 500)
    packed = packing.pack_documents(docs_of(spark, [(None, "one two three", "aa", "s")] * 4000), TOKENIZER, capacity=64)
    groups = packed.groupBy(F.shiftright("sequence_id", 32).alias("group")).count().collect()
    assert sum(r["count"] for r in groups) == 4000 and len(groups) == 8 and max(r["count"] for r in groups) < 800


def test_chunk_encoder_is_exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    encoder = packing.ChunkEncoder(TOKENIZER)
    texts = ["", "  a  b\t\tc\xa0d\x1ce \x85 f", "<|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ\nΣ", "é ́ a ́b", "İstanbul K z\r\nq 'S 'LL I'm 12345 한글", "Hello, HELLO!! hello..; (hello)", "x’s It's they're,. <|ENDOFTEXT|> ﬁ ǅ ß."]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.stream(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_chunks_are_not_kept(spark):
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(TOKENIZER), packing.ChunkEncoder(TOKENIZER)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef漢字仮名") for _ in range(3000)) for _ in range(20)] + ["x" * 50_000, "B" * 60 + "!!!", "q" * 41]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.stream(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert max(map(len, encoder.known)) <= packing.KEPT_LENGTH


def test_each_word_and_run_of_marks_is_encoded_once():
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(TOKENIZER), packing.ChunkEncoder(TOKENIZER)
    rng = random.Random(6)
    own = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    texts = [" ".join(f"{a}{mark}{b}, {a.title()}. {b.upper()}" for b in own for mark in "-/(") for a in own]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.stream(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    # Not every pair of words: a word with and without a space before it, and the marks.
    assert len(encoder.known) <= 2 * len(own) + 10


def test_encoder_keeps_little():
    encoder = packing.ChunkEncoder(TOKENIZER)
    letters = "abcdefghijklmnop"
    texts = [" ".join("".join(letters[n >> 4 * j & 15] for j in range(5)) for n in range(k, k + 20_000)) for k in range(0, 400_000, 20_000)]
    first = list(encoder.stream(texts[:1]))
    for text in texts[1:]:
        list(encoder.stream([text]))
        assert sys.getsizeof(encoder.known) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.known.items()) < 32e6
    # What went is encoded again.
    assert list(encoder.stream(texts[:1])) == first and list(encoder.stream(texts[-1:])) == list(packing.ChunkEncoder(TOKENIZER).stream(texts[-1:]))


@pytest.mark.parametrize("special", [True, False])
def test_parts_of_odd_texts_are_exact(special, monkeypatch):
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(TOKENIZER), packing.ChunkEncoder(TOKENIZER, special)
    t.encode_special_tokens = not special
    rng = random.Random(7)
    atoms = [*"aBcxYZésÉßÀÞ×÷ÿŸĳñ'\"’.,-!|<>_ \t\n\r  09٣½\x0b\x1c\x85\xa0\u0331\u0301ﬁΣςİKǅ漢字한🙂\x00", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " the", " Über", "H\u0331", "e\u0301"]
    for at_once in (10, 300, 100_000):
        # Texts are cut at spaces, too.
        monkeypatch.setattr(packing, "AT_ONCE", at_once)
        texts = ["".join(rng.choice(atoms) for _ in range(rng.choice((0, 1, 2, 5, 20, 80)))) for _ in range(500)]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.stream(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_first_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    bins, offsets = packing.first_fit(sizes, 64)
    room = []
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((j for j, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(64)
        assert (b, o) == (k, 64 - room[k])
        room[k] -= s
    assert packing.first_fit([], 64) == ([], [])


# 9


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, corpus):
    rng = random.Random(9)
    rows = corpus + [(300 + k, words(rng, rng.randint(1, 30)), "aa", f"s{k % 6}") for k in range(400)] + [(900, "lone words", "aa", "tiny")]
    df = mixing.mix(docs_of(spark, rows))
    got = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.copies >= int(r.target / r.source_size + 1e-9) if r.source_size else True
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs_of(spark, rows[::-1]).repartition(3)).collect()))


@pytest.mark.parametrize("copies", [False, True])
def test_mixing_of_null_and_repeated_ids(spark, copies):
    text = lambda k: "one two three" if copies else f"one two {k}"
    rows = [(None, text(k), "aa", "a") for k in range(50)] + [(7, text(k), "aa", "b") for k in range(50)] + [(1000 + k, "w " * 7, "aa", "c") for k in range(30)]
    for keep in ((), ("doc_id", "text", "source")):
        got = mixing.mix(docs_of(spark, rows).repartition(5), keep=keep).collect()
        taken = {s: sum((r.copies if keep else r.taken // 3 if s != "c" else r.taken // 7) for r in got if r.source == s) for s in "abc"}
        want = brute_targets({"a": 150, "b": 150, "c": 210})
        assert len(got) == len(rows) and abs(3 * taken["a"] - want["a"]) <= 1.5 and abs(3 * taken["b"] - want["b"]) <= 1.5 and abs(7 * taken["c"] - want["c"]) <= 3.5


def test_mixing_takes_the_smallest_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 4)
    monkeypatch.setattr(mixing, "SORTED", 10)
    rows = docs_of(spark, [(k, "w " * (1 + k % 5), "aa", "ab"[k % 2]) for k in range(300)])
    got = {r.doc_id: r.copies for r in mixing.mix(rows).collect()}
    keys = {r.id: (r.source, r.x, r.size) for r in mixing._keyed(rows, "mix", "doc_id", "source", "text").collect()}
    for s in "ab":
        order = sorted((x, i) for i, (q, x, _) in keys.items() if q == s)
        copies = [got[i] for _, i in order]
        assert copies == sorted(copies, reverse=True) and len(set(copies)) == 2


# 10


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0"),
        (2, "Released under the MIT License. See the MIT-license and the mit.license", "mit", "mit"),
        (3, "GNU General Public License, version 3 or any later version", "gpl", "gpl,gpl-3.0-or-later"),
        (4, "GNU Lesser General Public License v2.1", "gpl", "gpl,lgpl-2.1"),
        (5, "SPDX-License-Identifier: BSD-3-Clause", "", "bsd-3-clause"),
        (6, "Licensed under CC BY-NC 4.0.", "", "cc-by-nc-4.0"),
        (7, "mit licenses mitlicense permit license", "", "mit"),
        (8, None, "", ""),
        (9, "", "", ""),
        (10, "no words of that kind", "", ""),
        (11, "released under the terms of the Foo Bar License", "", "unknown"),
        (12, "MIT LICENSE " * 3000, "mit", "mit"),
        (13, "É mit license", "mit", "mit"),
        (1, "Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0"),
    ]
    got = licenses.scan_documents(docs_of(spark, [(i, t, None, None) for i, t, *_ in rows])).collect()
    assert sorted((r.doc_id, r.base_labels, r.labels) for r in got) == sorted((i, b, m) for i, _, b, m in rows)
    told = {r.doc_id: r for r in got}
    assert (told[2].n_base, told[2].first_word, told[2].last_word, told[2].n_words) == (3, 3, 11, 13)
    assert (told[12].n_base, told[12].last_word, told[12].n_words) == (3000, 5998, 6000)
    assert (told[8].n_words, told[8].n_base, told[8].first_word, told[8].score) == (0, 0, None, 0.0)
    assert all(0 <= r.score <= 1 for r in got)


def test_license_rules_compile():
    table = licenses.rules()
    assert len(table) > 250 and len({r[3] for r in table}) == len(table)
    for tier, label, keyword, pattern, confidence in table:
        re.compile(pattern)
        assert 1 <= tier <= len(licenses.TIERS) and label and keyword and 0 < confidence <= 1


def brute_detections(text):
    """(start, end, rank) of all matches, and of those that stay."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    table = licenses.rules()
    found = [(*m.span(), k) for k, r in enumerate(table) for m in re.finditer(r[3], low, re.A)]
    better = lambda e, d: (table[e[2]][0], -(e[1] - e[0]), e[2]) < (table[d[2]][0], -(d[1] - d[0]), d[2])
    return found, [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and better(e, d) for e in found)]


def brute_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens_ = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(tokens_)) if tokens_[i : i + len(phrase.split())] == phrase.split()]
    table = licenses.rules()
    kept = [(table[d[2]][1], table[d[2]][4]) for d in brute_detections(text)[1]]
    kept = [k for k in kept if k[0] != "unknown"] or kept
    base = {label for _, label in places}
    score = max([c for _, c in kept] + [0.7] * bool(base) + [0.0])
    return (len(tokens_), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {k for k, _ in kept})), score)


def test_licenses_by_brute_force(spark):
    rng = random.Random(11)
    full = [sample(r[3], " ", True) for r in licenses.rules()]
    bits = full + [sample(r[3], "\n", False) for r in licenses.rules()] + ["GNU", "lesser", "General Public License", "version 3", "MIT", "license", "the", "É", ",", "2.0", "or later", "under", "Apache", "é.x"]
    rows = [(k, rng.choice((" ", ", ", "\n")).join(rng.choice(bits) for _ in range(rng.randint(1, 14))), "aa", "s") for k in range(300)]
    # Chains in which intervals overlap and hold each other.
    rows += [(1000, "GNU Lesser General Public License version 2.1 or later under the MIT license, copyright (c) 2020", "aa", "s"), (1001, "licensed under the new BSD license and the BSD 3-clause BSD license", "aa", "s"), (1002, None, "aa", "s"), (1003, "", "aa", "s"), (1003, "", "aa", "s")]
    docs = docs_of(spark, rows)
    found = {}
    for r in licenses.detect(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.rank, r.kept))
    for i, t, *_ in rows:
        every, kept = brute_detections(t)
        assert sorted(found.get(i, [])) == sorted((*d, d in kept) for d in every), t
    got = sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in licenses.scan_documents(docs).collect()), key=str)
    assert got == sorted(((i, brute_scan(t)) for i, t, *_ in rows), key=str)


def test_licenses_of_one_text_with_very_many(spark):
    import time

    text = "mit license, gpl v2 or later. " * 50_000
    began = time.time()
    r = licenses.scan_documents(docs_of(spark, [(1, text, "aa", "s")])).first()
    assert (r.n_base, r.last_word, r.labels, r.n_detections) == (50_000, 299_994, "gpl-2.0-or-later,mit", 100_000)
    assert time.time() - began < 60


def sample(pattern, blank, full):
    """A text that a rule's pattern matches: the least one, or with all that is optional."""

    def made(parts):
        out = ""
        for op, arg in parts:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "BRANCH":
                out += made(arg[1][-1 if full else 0])
            elif op == "SUBPATTERN":
                out += made(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                least, most, inner = arg
                out += made(inner) * max(least, int(full and most > 0))
            elif op == "IN":
                kind, value = arg[0]
                out += {"CATEGORY_SPACE": blank, "CATEGORY_NOT_SPACE": "x", "CATEGORY_DIGIT": "7"}[str(value)] if str(kind) == "CATEGORY" else chr(value)
            elif op in ("CATEGORY", "ANY", "NOT_LITERAL"):
                out += "x"
            else:
                assert op in ("AT", "ASSERT_NOT"), op
        return out

    return made(re._parser.parse(pattern))


def test_license_gates_lose_nothing(spark):
    table = licenses.rules()
    texts = [sample(r[3], blank, full) for r in table for blank in (" ", "\n", "\t") for full in (False, True)]
    assert all(re.search(r[3], t) for r, t in zip((r for r in table for _ in range(6)), texts, strict=True))
    texts += ["Apache 2.0", "BSD-3-Clause", "3-clause BSD", "MIT No Attribution", "CC\nBY-SA 4.0", "No rules here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    with_gates, without = (sorted(map(tuple, licenses.detect(docs, gated=g).collect())) for g in (True, False))
    assert with_gates == without
    assert {r[0] for r in without} == set(range(len(texts) - 1))
