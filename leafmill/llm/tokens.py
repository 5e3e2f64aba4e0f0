"""Token counts of documents in flat token files.

A flat token file is a run of token ids in which an end-of-document id closes each document; there is no index. It is read
in blocks of a fixed number of ids, wherever those cut. Each block is searched for the end id in one vectorised comparison.
A block's place, how many documents close before it and where the last of them closes come from prefix scans over the
blocks of a file: first within runs of RUN blocks, then over the runs, so that no task holds the blocks of a large file.
With these, a document that crosses blocks gets its length from the two blocks in which it begins and ends.

Defined cases: an empty document counts 0; ids after the last end id are a document that isn't closed; an empty file has no
documents. For tables of texts: a null text is an empty document; repeated rows are documents of their own; only the named
columns are used. Ids take two bytes where the vocabulary allows, else four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.llm.common import cut
from leafmill.llm.packing import encoder

#: Ids of a block, blocks of a run.
BLOCK, RUN = 1 << 16, 1024
#: Bytes of a file that one task reads.
SPAN = 1 << 26

_BLOCKS = "file string, block long, ids binary, first long, names array<string>"


def blocks_of_texts(docs: DataFrame, tokenizer: str, end_id: int, *, width: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as flat files of unsigned ids of width 2 or 4 bytes, one for each partition, in blocks: file, block, ids.

    Rows without ids are a file's side list: the documents' ids (names) from its document `first` on.
    """

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, enc, rest, at, n = str(TaskContext.get().partitionId()), encoder(tokenizer, special=False), b"", 0, 0
        end = np.asarray([end_id], f"<u{width}").tobytes()
        for frame in frames:
            rows = [(file, None, None, n, frame["name"].tolist())] if len(frame) else []
            n += len(frame)
            parts = [rest]
            held = len(rest)
            for ids in enc.stream(frame["text"]):
                made = np.frombuffer(ids, "<u4")
                if width == 2 and made.max(initial=0) > 0xFFFF:
                    raise ValueError("this vocabulary needs ids of four bytes")
                for more in (made.astype(f"<u{width}").tobytes(), end):
                    parts.append(more)
                    held += len(more)
                if held >= width * block:
                    run = b"".join(parts)
                    for k in range(0, held - width * block + 1, width * block):
                        rows.append((file, at, run[k : k + width * block], None, None))
                        at += 1
                    parts = [run[held - held % (width * block) :]]
                    held = len(parts[0])
            rest = b"".join(parts)
            yield pd.DataFrame(rows, columns=["file", "block", "ids", "first", "names"]).astype({"block": "Int64", "first": "Int64"})
        if rest:
            yield pd.DataFrame([(file, at, rest, None, None)], columns=["file", "block", "ids", "first", "names"]).astype({"block": "Int64", "first": "Int64"})

    rows = docs.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(stream, _BLOCKS)


def blocks_of_files(spark: SparkSession, path: str, *, width: int = 2, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Flat files below path (ids of width 2 or 4 bytes, little-endian), in blocks: file, block, ids.

    Spark lists the files; their ranges of about span bytes are dealt to tasks, which read them through Arrow's file
    systems (local, HDFS, S3, Google), so a file of any size is read by many tasks and none of them holds more than a block.
    """
    size = width * block
    step = max(1, span // size) * size

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for file, at, end in zip(frame["path"], frame["at"], frame["end"], strict=True):
                system, name = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:/", "file:///", 1))
                with system.open_input_file(name) as source:
                    for k in range(int(at), int(end), size):
                        ids = source.read_at(min(size, int(end) - k), k)
                        yield pd.DataFrame({"file": [file], "block": [k // size], "ids": [ids], "first": pd.Series([None], dtype="Int64"), "names": [None]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    ranges = ranges.select("path", "at", F.least("length", F.col("at") + step).alias("end"))
    return ranges.repartition("path", "at").mapInPandas(read, _BLOCKS)


def search(blocks: DataFrame, end_id: int, *, width: int = 2) -> DataFrame:
    """Of each block, its number of ids and the places of the end id in it; side lists stay."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [np.frombuffer(b, f"<u{width}") if b is not None else None for b in frame["ids"]]
            yield pd.DataFrame({"file": frame["file"], "block": frame["block"].astype("Int64"), "n": pd.Series([None if x is None else len(x) for x in ids], dtype="Int64"), "ends": [None if x is None else np.flatnonzero(x == end_id) for x in ids], "first": frame["first"].astype("Int64"), "names": frame["names"]})

    return blocks.mapInPandas(find, "file string, block long, n long, ends array<long>, first long, names array<string>")


def count_documents(found: DataFrame, *, run: int = RUN) -> DataFrame:
    """From what `search` found: file, doc_in_file (from 0), start (in ids), n_tokens (without the end id), closed."""
    parts = found.where("block is not null").withColumn("run", F.floor(F.col("block") / run)).withColumns({"closes": F.size("ends").cast("long"), "last": F.get("ends", F.size("ends") - 1)})
    # A scan in each run, then one over the runs; together they are the scan over the file.
    inside = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = parts.withColumn("at", F.coalesce(F.sum("n").over(inside), zero))
    local = local.withColumns({"docs": F.coalesce(F.sum("closes").over(inside), zero), "before": F.max(F.col("at") + F.col("last")).over(inside)})
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("closes").alias("closes"), F.max(F.col("at") + F.col("last")).alias("last"))
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(over), zero))
    runs = runs.withColumns({"run_docs": F.coalesce(F.sum("closes").over(over), zero), "run_before": F.max(F.col("run_at") + F.col("last")).over(over), "final": F.col("run") == F.max("run").over(W.partitionBy("file"))})
    placed = local.join(runs.select("file", "run", "run_at", "run_docs", "run_before", "final"), ["file", "run"])
    at, before = F.col("run_at") + F.col("at"), F.coalesce(F.greatest(F.col("run_at") + F.col("before"), F.col("run_before")), F.lit(-1).cast("long"))
    rows = placed.select("file", "block", "n", "ends", "run", "final", at.alias("at"), before.alias("before"), (F.col("run_docs") + F.col("docs")).alias("docs"))
    # Each end with the one before it, so that no row carries its block's.
    pairs = F.transform("ends", lambda e, k: F.struct(k.alias("k"), e.alias("end"), F.when(k == 0, F.col("before")).otherwise(F.col("at") + F.get("ends", k - 1)).alias("last")))
    closed = rows.select("file", "at", "docs", F.explode(pairs).alias("e"))
    closed = closed.select("file", (F.col("docs") + F.col("e.k")).alias("doc_in_file"), (F.col("e.last") + 1).alias("start"), (F.col("at") + F.col("e.end") - F.col("e.last") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    # What stands after a file's last end id.
    tail = rows.groupBy("file").agg(F.max(F.col("at") + F.col("n")).alias("size"), F.max(F.greatest("before", F.col("at") + F.get("ends", F.size("ends") - 1))).alias("before"), F.max(F.col("docs") + F.size("ends")).alias("docs"))
    unclosed = tail.where("before + 1 < size").select("file", F.col("docs").alias("doc_in_file"), (F.col("before") + 1).alias("start"), (F.col("size") - F.col("before") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(unclosed)


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, *, block: int = BLOCK, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, file, doc_in_file, start, n_tokens of each row, counted in flat files made from the texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    width = 2 if max(end_id, encoder(tokenizer, special=False).tokenizer.get_vocab_size() - 1) <= 0xFFFF else 4
    found = cut(search(blocks_of_texts(docs, tokenizer, end_id, width=width, block=block, id_col=id_col, text_col=text_col), end_id, width=width))
    names = found.where("block is null").select("file", "first", F.posexplode("names").alias("k", "name")).select("file", (F.col("first") + F.col("k")).alias("doc_in_file"), F.col("name").cast(kind).alias(id_col))
    return names.join(count_documents(found, run=run), ["file", "doc_in_file"]).select(id_col, F.col("file").cast("long").alias("file"), "doc_in_file", "start", "n_tokens")
