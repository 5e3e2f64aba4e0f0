"""Byte-level BPE: texts to ids and back, by replaying the merges over the words of the corpus.

A text is cut into words as the pattern of the rank files cuts it. Words repeat, so merges aren't made text by text: each
task takes its rows in runs, gathers the words that it has no ids for yet and replays the merges over all of them at once.
An inverted index holds the places of every pair of neighbouring tokens, named by the token that they merge into; merges
are applied in the order of their rank, and each touches only the pairs left and right of it, which go into the index. A
worker keeps the ids of the words it has met, up to KEPT bytes, so a frequent word is merged once in a worker and not once
in a text. Nothing is shuffled, no task holds more than a run, and a lost executor's rows are simply encoded again.

Ids are those of a plain encoder that always merges the leftmost pair of the lowest rank: should a merge make a pair of a
lower rank than its own, the rest of that word waits until that pair is merged.

Defined cases: a null text counts as empty and has no ids; rows are encoded one by one, so repeated rows, ties and null ids
change nothing; a text of any length is cut into parts before white space, where no word goes on. Other columns are kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a part of a text, bytes of the words merged at once, bytes of the words a worker keeps.
PART, BLOCK, KEPT = 1 << 20, 1 << 19, 3 << 21
#: Bits of an id in a pair of ids.
WIDTH = 32

LETTER, NUMBER, SPACE, OTHER = range(4)
#: What may follow an apostrophe at a word's beginning and is then a word with it, in the order of trial.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


# White space, and the ranges of letters and of numbers that Unicode 16.0 has and 15.1 hasn't.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, group, new in ((LETTER, "L", NEW_LETTERS), (NUMBER, "N", NEW_NUMBERS)):
        kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == group]] = kind
        for low, high in new:
            kinds[low : high + 1] = kind
    kinds[list(map(ord, WHITE))] = SPACE
    return kinds


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def _tokens(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return out


@functools.cache
def merges(path: str) -> dict[int, int]:
    """The token that two neighbours merge into, by both their ids: every way to cut a token into two."""
    known, out = ranks(path), {}
    for token, rank in known.items():
        for cut in range(1, len(token)):
            a, b = known.get(token[:cut]), known.get(token[cut:])
            if a is not None and b is not None:
                out[a << WIDTH | b] = rank
    return out


def word_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, in bytes of its UTF-8, and the number of those bytes behind each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = _kinds()[points]
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    # Of white space before something else, the last character stands alone or, being a blank, with what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # An apostrophe that begins a word may take an ending with it.
    marks = np.flatnonzero((points == 0x27) & start)
    for at in marks.tolist():
        ending = next((e for e in ENDINGS if text.startswith(e, at + 1)), None)
        if ending:
            start[at + 1 : at + 1 + len(ending)] = False
            if at + 1 + len(ending) < n:
                start[at + 1 + len(ending)] |= kind[at + 1 + len(ending)] == LETTER
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    return np.concatenate(([0], ends))[np.flatnonzero(start)], ends


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about size characters, cut only before a blank behind something else."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not (text[end] == " " and text[end - 1] not in WHITE):
            end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def words(text: str) -> list[bytes]:
    """The words of a text, in order, as UTF-8."""
    out: list[bytes] = []
    for part in parts(text):
        data = part.encode()
        at = word_starts(part)[0].tolist()
        out += [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
    return out


def replay(found: list[bytes], known: dict[bytes, int], pairs: dict[int, int]) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit integers. pairs: what neighbours merge into, as `merges` gives it."""
    data = np.frombuffer(b"".join(found), np.uint8)
    size = len(data)
    if not size:
        return [b""] * len(found)
    edge = np.concatenate(([0], np.cumsum([len(w) for w in found])))
    first = np.asarray([known[bytes([b])] for b in range(256)])[data]
    lengths = {rank: len(text) for text, rank in known.items()}
    # Places are those of the bytes. A token stands at its first one; stop is where it ends, back where the one before begins.
    token, stop, back = first.tolist(), [*range(1, size + 1), 0], list(range(-1, size))
    opens = np.zeros(size + 1, bool)
    opens[edge] = True
    inside = ~opens[1:]
    opens = bytearray(opens.tobytes())

    # The index: places of all pairs that merge, by the token they merge into.
    at = np.flatnonzero(inside)
    codes, which = np.unique((first[at] << WIDTH) | first[at + 1], return_inverse=True)
    order = np.argsort(which, kind="stable")
    index: dict[int, list[int]] = {}
    for code, places in zip(codes.tolist(), np.split(at[order], np.cumsum(np.bincount(which, minlength=len(codes)))[:-1]), strict=True):
        if code in pairs:
            index.setdefault(pairs[code], []).extend(places.tolist())
    queue = list(index)
    heapq.heapify(queue)
    look, push = pairs.get, heapq.heappush
    while queue:
        rank = heapq.heappop(queue)
        length, waits = lengths[rank], -1
        for p in sorted(index.pop(rank)):
            if token[p] < 0:
                continue
            q = stop[p]
            r = stop[q]
            # Other merges since then have taken one of the two, unless they still end where the merged token would.
            if r - p != length or q == p + length:
                continue
            if p < waits:
                # A pair of lower rank came up in this word: it goes first.
                if rank not in index:
                    index[rank] = []
                    push(queue, rank)
                index[rank].append(p)
                continue
            token[p], token[q], stop[p] = rank, -1, r
            least = rank
            if not opens[r]:
                back[r] = p
                new = look(rank << WIDTH | token[r])
                if new is not None:
                    places = index.get(new)
                    if places is None:
                        index[new] = [p]
                        push(queue, new)
                    else:
                        places.append(p)
                    least = min(least, new)
            if not opens[p]:
                left = back[p]
                new = look(token[left] << WIDTH | rank)
                if new is not None:
                    places = index.get(new)
                    if places is None:
                        index[new] = [left]
                        push(queue, new)
                    else:
                        places.append(left)
                    least = min(least, new)
            if least < rank:
                waits = int(edge[np.searchsorted(edge, p, "right")])
    ids = np.asarray(token)
    left = np.concatenate(([0], np.cumsum(ids >= 0)))[edge].tolist()
    flat = ids[ids >= 0].astype("<u4").tobytes()
    return [flat[4 * a : 4 * b] for a, b in zip(left, left[1:], strict=False)]


class Encoder:
    """Ids of texts; keeps those of the words it has met."""

    def __init__(self, path: str, *, block: int = BLOCK, kept: int = KEPT):
        self.known, self.pairs, self.block, self.kept = ranks(path), merges(path), block, kept
        self.ids: dict[bytes, bytes] = {}
        self.held = 0

    def learn(self, new: set[bytes]) -> None:
        """Merges words, a block of them at a time."""
        # A word that is a token needs no merge.
        self.ids |= {w: self.known[w].to_bytes(4, "little") for w in new if w in self.known}
        group, size = [], 0
        for word in sorted(w for w in new if w not in self.known):
            group.append(word)
            size += len(word)
            if size >= self.block:
                self.ids |= zip(group, replay(group, self.known, self.pairs), strict=True)
                group, size = [], 0
        self.ids |= zip(group, replay(group, self.known, self.pairs), strict=True)
        self.held += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, the words of all of them merged together."""
        if self.held > self.kept:
            self.ids, self.held = {}, 0
        found = [words(t) for t in texts]
        made = [list(map(self.ids.get, w)) for w in found]
        open_at = [k for k, ids in enumerate(made) if None in ids]
        self.learn({w for k in open_at for w, ids in zip(found[k], made[k], strict=True) if ids is None})
        for k in open_at:
            made[k] = list(map(self.ids.__getitem__, found[k]))
        return list(map(b"".join, made))


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def runs(texts: list[str], size: int = 2 * PART) -> Iterator[list[str]]:
    """Texts in runs of about size characters; a longer one is a run of its own."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(text: Column | str, path: str) -> Column:
    """Ids of a text by the rank file at path, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made: list[bytes] = []
            for texts in runs(batch.fillna("").tolist()):
                made += _encoder(path).encode(texts)
            yield pd.Series(made, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(text)


def decoded(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(ids: Column | str, path: str) -> Column:
    """The bytes that ids stand for."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _tokens(path)
        for batch in batches:
            yield pd.Series([None if b is None else decoded(b, table) for b in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(ids)


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each row's whole text; n_tokens is their number."""
    return docs.withColumn(ids_col, encode(F.coalesce(F.col(text_col), F.lit("")), path)).withColumn("n_tokens", (F.octet_length(ids_col) / 4).cast("long"))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) of each row; ids don't leave the worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = _tokens(path)
        for batch in batches:
            rows = []
            for texts in runs(batch.fillna("").tolist()):
                for ids in _encoder(path).encode(texts):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded(ids, table)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), made.alias("_made")).select(id_col, "_made.*")
