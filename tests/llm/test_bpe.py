"""Byte-level BPE against the public library and a plain encoder."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from leafmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string"
ALPHABET = [*"abcst'relmvdxéß 1²9!.,-\n\t　\x1c\x85中😀", "'s", "'re", "'ll", " 's", "  ", "\n\n", "the", "ing", " the", "aaaa", "́"]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def ids(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


def plain(word, known):
    """Always the leftmost pair of the lowest rank."""
    parts = [bytes([b]) for b in word]
    while word not in known and len(parts) > 1:
        best = min((known.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 40:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [known[word]] if word in known else [known[p] for p in parts]


def test_ids_are_the_library_s(library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(8000)]
    texts += ["".join(chr(draw.choice([draw.randint(97, 122), draw.randint(192, 383)])) for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 4000, " " * 3000, "", "<|endoftext|>", "\x00"]
    assert ids(bpe.Encoder(PATH), texts) == [library.encode_ordinary(t) for t in texts]
    # Small blocks, and words forgotten all the time, change nothing.
    assert ids(bpe.Encoder(PATH, block=50, kept=1000), texts[:2000]) == [library.encode_ordinary(t) for t in texts[:2000]]


def test_kinds_of_characters_are_the_library_s():
    tiktoken = pytest.importorskip("tiktoken")
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    for before, kind in (("a", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)):
        own = {bytes([b]): b for b in range(256)} | {(before + chr(c)).encode(): 256 + k for k, c in enumerate(points)}
        one = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
        assert [c for c in points if (len(one.encode_ordinary(before + chr(c))) == 1) != (bpe._kinds()[c] == kind)] == []


def test_a_lower_rank_made_by_a_merge_goes_first():
    # "ab" (rank 300) makes "abc" (rank 290) possible, which must not wait for the second "ab".
    known = {bytes([b]): b for b in range(256)} | {b"abc": 290, b"ab": 300, b"bab": 310, b"cab": 280, b"aba": 295}
    pairs = {known[t[:k]] << bpe.WIDTH | known[t[k:]]: r for t, r in known.items() for k in range(1, len(t)) if t[:k] in known and t[k:] in known}
    draw = random.Random(4)
    words = [bytes(draw.choices(b"abc", k=draw.randint(1, 14))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in bpe.replay(words, known, pairs)]
    assert got == [[i for i in plain(w, known)] if w not in known else got[k] for k, w in enumerate(words)]


def test_parts_end_where_words_do():
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(draw.choices(ALPHABET, k=200))
        assert "".join(bpe.parts(text, 7)) == text
        assert [w for p in bpe.parts(text, 7) for w in bpe.words(p)] == bpe.words(text)


def test_round_trip(spark, library):
    texts = [None, "", "Hello there, it's  me\n", "ß" * 1000, "word " * 300_000, "same", "same"]
    frame = spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)], SCHEMA).selectExpr("*", "1 as ids", "'x' as n_tokens")
    got = bpe.round_trip(frame, PATH).collect()

    def row(k, t):
        made = library.encode_ordinary(t or "")
        return k if k != 3 else None, len(made), hashlib.sha256(np.asarray(made, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((row(k, t) for k, t in enumerate(texts)), key=str)
    assert bpe.round_trip(frame.limit(0), PATH).collect() == []


def test_ids_as_a_column(spark, library):
    rows = bpe.encode_documents(spark.createDataFrame([(1, "some text"), (2, None)], SCHEMA), PATH)
    rows = rows.withColumn("back", bpe.decode("ids", PATH)).orderBy("doc_id").collect()
    assert [(np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, bytes(r.back)) for r in rows] == [(library.encode_ordinary("some text"), 2, b"some text"), ([], 0, b"")]
