"""Packing documents into training sequences: first-fit decreasing with a tournament tree over bin capacities.

Documents become token ids, are cut at the sequence length, and every piece is put into the first open sequence that still
has room, longest pieces first. This runs independently in groups to which pieces are dealt by a hash, so a group's size is
bounded whatever the table's size, and groups are large enough that little room is lost.

Sequences are padded to the capacity when they are made into tensors, but for those whose length is a power of two.

Defined cases: a null or empty text is the end-of-document id alone; repeated rows are packed as often as they stand there;
an empty table gives no pieces. Only the named columns are used.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, small_batches

#: Pieces of one group, on average; parts of texts that a Python worker keeps the ids of, and the longest of these in bytes (300 bytes each at most).
GROUP, KEPT_CHUNKS, KEPT_LENGTH = 8192, 150_000, 40
#: Bytes of texts that are encoded at once.
AT_ONCE = 4_000_000

# A plain word in small letters, as bytes: a-z and Latin-1's letters.
_WORD = re.compile(rb" ?((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)")
# Bytes of UTF-8 that a byte-level alphabet shows by other characters than Latin-1 does.
_BYTES = {b: chr(289 + b - 127) for b in range(127, 161)} | {173: chr(323)}
# Kinds of bytes: of plain letters, space, apostrophe, other plain marks and digits, all else.
_LETTER, _SPACE, _QUOTE, _MARK, _ELSE = range(5)

#: This worker's encoders by file; they stay for its next tasks.
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


class ChunkEncoder:
    """Token ids of texts by a tokenizers file, each word and each run of marks encoded once.

    Exact for tokenizers whose pre-tokenizer drops white space and parts letters from other characters (but for an
    apostrophe and the letters behind it), and whose normalizer doesn't reach across white space and ignores case: there a
    text's ids are those of its parts, one after another. Texts are parted as arrays of bytes. Plain words, in small
    letters, are parts of their own, with the space before them; what stands between them is the other parts. A chunk
    between spaces that holds other letters, marks beyond ASCII or a character of a special token stays whole. A plain word
    goes to the model as the bytes that the pre-tokenizer would make of it, if the file is of that kind, which is tried out
    at first; else, as all other parts do, through the whole tokenizer.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.long = Tokenizer.from_file(path), {}, set()
        # Where special tokens aren't wanted, their strings in a text are ordinary text.
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        probe = ["hello", "été", "straße", "ñandú", "zzyzxqj", "íàü"]
        self.direct = self._direct(probe) == self._whole(probe)
        self.kinds = np.full(256, _ELSE, "uint8")
        self.kinds[33:127] = _MARK
        # Letters of special tokens needn't count, as long as each has some other character.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds[[c for t in added for c in t.encode() if c < 128]] = _ELSE
        self.kinds[[c for c in range(128) if chr(c).isalpha()]] = _ELSE if any(t.isalnum() for t in added) else _LETTER
        self.kinds[list(b"\t\n\r ")], self.kinds[ord("'")] = _SPACE, _QUOTE
        self.small = np.arange(256, dtype="uint8")
        self.small[list(b"\t\n\r")] = 32
        self.small[65:91] += 32

    def _direct(self, words: list[str]) -> list[bytes]:
        read = self.model.tokenize
        return [array("I", [t.id for t in read(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]).tobytes() for w in words]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        docs: list[bytes] = []
        size = 0
        for text in texts:
            docs.append(text.encode())
            size += len(docs[-1])
            if size > AT_ONCE:
                last = docs.pop()
                yield from self._encode(docs)
                # A long text is encoded in pieces.
                yield b"".join(ids for piece in _at_spaces(last) for ids in self._encode([piece]))
                docs, size = [], 0
        yield from self._encode(docs)

    def _encode(self, docs: list[bytes]) -> Iterator[bytes]:
        # Each text has a space before it, at which its first part begins.
        data = np.frombuffer(b" " + b" ".join(docs), "uint8")
        first = np.cumsum([0, *[len(d) + 1 for d in docs]])
        cuts, small = self._parts(data, first)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(small)]).dictionary_encode()
        own = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([c for c in own if c not in self.known])
        ids = pa.array([self.known[c] for c in own], pa.large_binary()).take(parts.indices)
        # Long parts, as of texts without spaces, rarely come again.
        for c in self.long:
            self.known.pop(c, None)
        self.long.clear()
        if len(self.known) > KEPT_CHUNKS:
            # The first ones are the frequent ones.
            self.known = dict(islice(self.known.items(), KEPT_CHUNKS // 2))
        _, offsets, made = ids.buffers()
        at = np.frombuffer(offsets, "int64")[np.searchsorted(cuts, first)].tolist()
        raw = memoryview(made) if made is not None else b""
        return (bytes(raw[a:b]) for a, b in pairwise(at))

    def _parts(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts begin (with the end), and the bytes with plain words in small letters; first: where texts begin, and the end."""
        kinds, small = self.kinds[data], self.small[data]
        # À to ÿ but for × and ÷ are C3 and a byte from 80 on.
        lead = np.flatnonzero(data == 0xC3)
        if len(lead) and self.kinds[ord("a")] == _LETTER:
            second = data[lead + 1]
            good = (second != 0x97) & (second != 0xB7)
            lead, second = lead[good], second[good]
            kinds[lead] = kinds[lead + 1] = _LETTER
            small[lead + 1] = second + np.where(second < 0x9F, 32, 0).astype("uint8")
        letter, space = kinds == _LETTER, kinds == _SPACE
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = letter[:-1] > letter[1:]
        begin = np.flatnonzero((letter[1:] > letter[:-1]) & (kinds[:-1] != _QUOTE)) + 1
        cut[begin - space[begin - 1]] = True
        odd = kinds == _ELSE
        if odd.any():
            # Chunks that hold these are parts as they stand.
            spaces = np.flatnonzero(space)
            held = np.logical_or.reduceat(odd, spaces)
            start, end = spaces[held] + 1, np.append(spaces[1:], len(data))[held]
            edge = np.zeros(len(data) + 1, "int8")
            edge[start] = 1
            edge[end] -= 1
            inside = np.cumsum(edge[:-1], dtype="int8").view(bool)
            small = np.where(inside, data, small)
            cut[:-1] &= ~inside
            cut[start] = cut[end] = True
        cut[first] = cut[-1] = True
        return np.flatnonzero(cut), small

    def _learn(self, parts: list[bytes]) -> None:
        """Adds parts to what is known."""
        words, others = [], []
        for c in parts:
            if len(c) > KEPT_LENGTH:
                self.long.add(c)
            word = _WORD.fullmatch(c) if self.direct else None
            (words if word else others).append((c, (word[1] if word else c).decode()))
        self.known.update(zip([c for c, _ in words], self._direct([w for _, w in words]), strict=True))
        self.known.update(zip([c for c, _ in others], self._whole([w for _, w in others]), strict=True))


def _at_spaces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about AT_ONCE bytes that begin with a space, as far as it has spaces."""
    at = 0
    while len(text) - at > AT_ONCE:
        to = text.rfind(b" ", at + 1, at + AT_ONCE)
        to = to if to >= 0 else text.find(b" ", at + AT_ONCE)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def encoder(path: str, special: bool = True) -> ChunkEncoder:
    if (path, special) not in _encoders:
        _encoders[path, special] = ChunkEncoder(path, special)
    return _encoders[path, special]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut every capacity ids: id_col, start, length, ids_crc32, doc_tokens; with_ids: ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for frame in frames:
            at, rows = [], []
            for i, raw in enumerate(enc.stream(frame["t"])):
                ids = raw + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").astype("int32")] if with_ids else [])))
            made = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            made.insert(0, "id", frame["id"].iloc[at].to_numpy())
            yield made

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    # Ids travel as text, as pandas would turn integers with nulls into floats.
    rows = rows.withColumn("id", F.col("id").cast("string"))
    made = rows.mapInPandas(cut_up, "id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return made.select(F.col("id").cast(kind).alias(id_col), *made.columns[1:])


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and offset of each size, in the given order: the first bin with room takes it.

    A complete binary tree holds the largest room below each node; the way down to the first bin that fits is its depth.
    """
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * width)
    bins, offsets = [], []
    for size in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < size:
                at += 1
        bins.append(at - width)
        offsets.append(capacity - room[at])
        room[at] -= size
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left > right else right
            at //= 2
    return bins, offsets


def pack(rows: DataFrame, *, capacity: int = 4096, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """rows with sequence_id and offset. Every length is from 1 to capacity. Rows that agree in order_by are dealt to groups by their places in what is written, too."""
    rows = cut(rows)
    groups = max(1, round(rows.count() / GROUP))
    kept = rows.columns

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length_col, *order_by], ascending=[False, *[True] * len(order_by)], kind="stable")
        bins, offsets = first_fit(frame[length_col].tolist(), capacity)
        return frame.assign(sequence_id=frame["group"].astype("int64") * 2**32 + np.asarray(bins, "int64"), offset=np.asarray(offsets, "int64"))[[*kept, "sequence_id", "offset"]]

    dealt = rows.withColumn("group", F.pmod(F.xxhash64(*order_by, F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(fit, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut_up = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    packed = pack(cut_up.withColumn(id_col, F.col(id_col).cast("string")), capacity=capacity, order_by=(id_col, "start", "ids_crc32"))
    return packed.withColumn(id_col, F.col(id_col).cast(kind))
