"""A tree of files in packs: archives of many files each, for trees of millions of small files.

File systems give each file and each folder a block and an inode, so that a tree of loose small files (`trees`) takes many
times what it holds. Here tasks write compressed tar archives of many files; `tar --zstd -xf` gives the loose files, as
`trees.write_tree` of `read_tree` does.

A pack is never changed. `update_tree` writes new files into new packs, and those packs again that hold a path that goes or
comes anew, without it. The pointer names the packs in force, so readers see the tree before or the tree after; packs that a
task left behind when it was killed or ran twice are named by nobody. A path is in one pack only; of rows of one path, one stays.

    <path>/PACKS                      the packs in force, as JSON
    <path>/write-<id>/<id>.tar.zst    files
    <path>/write-<id>/<id>.json.gz    their paths
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from leafmill.lineage import shuffles_removed
from leafmill.sources.trees import _Files, _read, _remove, _safe, open_path

POINTER, LIST = "PACKS", "LIST"
NAME = "leafmill_packs"
#: A pack ends with so many files or bytes.
FILES, BYTES = 1 << 16, 1 << 26
_KIND = "rel_path string, content binary"
#: Entries are gathered to so many bytes.
CHUNK = 1 << 20
BLOCK, ZEROS = tarfile.BLOCKSIZE, bytes(tarfile.RECORDSIZE)
#: What headers of files with short plain names have in common: parts behind the name, the size and the sum, and what they add to the sum.
_HEAD = tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT)
_MODE, _TIME, _REST = _HEAD[100:124], _HEAD[136:148], _HEAD[156:]
_SUM = sum(_MODE) + sum(_TIME) + sum(_REST) + 8 * ord(" ")


def _head(rel_path: str, size: int) -> bytes:
    """A file's header, as tarfile makes it."""
    name = rel_path.encode()
    if len(name) <= tarfile.LENGTH_NAME and name.isascii() and size < 8**11:
        length = b"%011o\0" % size
        return b"".join((name.ljust(tarfile.LENGTH_NAME, b"\0"), _MODE, length, _TIME, b"%06o\0 " % (_SUM + sum(name) + sum(length)), _REST))
    entry = tarfile.TarInfo(rel_path)
    entry.size = size
    return entry.tobuf(tarfile.PAX_FORMAT, "utf-8", "strict")


def _id() -> str:
    return uuid.uuid4().hex[:16]


class _Packs:
    """Writes files into packs of a folder, one pack after another."""

    def __init__(self, path: str, folder: str):
        self.files, self.folder = _Files(f"{path}/{folder}"), folder
        self.done: list[str] = []
        self.held: set[str] = set()

    def _open(self) -> None:
        self.id, self.size, self.at = _id(), 0, 0
        self.out = self.files.system.open_output_stream(self.files.within(f"{self.id}.tar.zst"), compression="zstd")
        self.waiting, self.written = [], 0

    def _write(self, *parts: bytes) -> None:
        self.waiting += parts
        self.at += sum(map(len, parts))
        if self.at - self.written >= CHUNK:
            self._flush()

    def _flush(self) -> None:
        # What is large is written as it is.
        for part in [b"".join(self.waiting)] if len(self.waiting) > 3 else self.waiting:
            self.out.write(part)
        self.waiting, self.written = [], self.at

    def add(self, rel_path: str, data: bytes) -> None:
        if "\0" in _safe(rel_path):
            raise ValueError(f"not a path below the tree: {rel_path!r}")
        if rel_path in self.held:
            return
        if len(self.held) >= FILES or self.held and self.size >= BYTES:
            self.close()
        if not self.held:
            self._open()
        if len(data) >= CHUNK:
            self._flush()
        self._write(_head(rel_path, len(data)), data, ZEROS[: -len(data) % BLOCK])
        self.held.add(rel_path)
        self.size += len(data)

    def close(self) -> list[str]:
        """Ends the pack that is open; all packs written."""
        if self.held:
            # An archive ends with two empty blocks and fills its last record.
            self._write(bytes(2 * BLOCK), ZEROS[: -(self.at + 2 * BLOCK) % tarfile.RECORDSIZE])
            self._flush()
            self.out.close()
            pack = f"{self.folder}/{self.id}"
            with self.files.system.open_output_stream(self.files.within(f"{self.id}.json.gz"), compression="gzip") as names:
                for rel in self.held:
                    names.write((json.dumps({"rel_path": rel, "pack": pack}) + "\n").encode())
            self.done.append(pack)
            self.held = set()
        return self.done


def _plain(head: bytes) -> bool:
    """Whether a header says all of a file that comes next, as most do."""
    return head[156] in b"0\0" and not head[345] and not head[124] & 128


def _entries(path: str, pack: str) -> Iterator[tuple[str, bytes]]:
    """rel_path and content of a pack's files, in its order."""
    system, base = open_path(path)
    given = 0
    with system.open_input_stream(f"{base}/{pack}.tar.zst", compression="zstd") as opened:
        source = io.BufferedReader(opened, CHUNK)
        while (head := source.read(BLOCK)) != ZEROS[:BLOCK]:
            # tarfile takes a broken header for the end.
            if len(head) < BLOCK or int(head[148:156].rstrip(b" \0") or b"0", 8) != sum(head) - sum(head[148:156]) + 8 * ord(" "):
                raise tarfile.ReadError(f"{pack} is damaged")
            if not _plain(head):
                break
            size = int(head[124:136].rstrip(b" \0"), 8)
            data = source.read(size + -size % BLOCK)
            if len(data) < size:
                raise tarfile.ReadError(f"{pack} ends in a file")
            yield head[: tarfile.LENGTH_NAME].rstrip(b"\0").decode(), data[:size]
            given += 1
        else:
            return
    # From the first header of another kind on, tarfile reads.
    with system.open_input_stream(f"{base}/{pack}.tar.zst", compression="zstd") as source, tarfile.open(fileobj=source, mode="r|", encoding="utf-8") as tar:
        while (entry := tar.next()) is not None:
            if given:
                given -= 1
            else:
                yield entry.name, tar.extractfile(entry).read()
            # The archive would keep account of all its entries.
            tar.members = []


@dataclass
class Packed(WriterCommitMessage):
    packs: list[str]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, folder: str):
        self.path, self.folder = path, folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        packs = _Packs(self.path, self.folder)
        for batch in iterator:
            for rel, data in zip(batch.column("rel_path").to_pylist(), batch.column("content").cast(pa.binary()).to_pylist(), strict=True):
                packs.add(rel, data or b"")
        return Packed(packs.close())

    def commit(self, messages: list[Packed | None]) -> None:
        _Files(f"{self.path}/{self.folder}").put(LIST, json.dumps([p for m in messages if m is not None for p in m.packs]).encode())

    def abort(self, messages: list[Packed | None]) -> None:
        _remove(*open_path(f"{self.path}/{self.folder}"))


class PackSource(DataSource):
    """Sink of rows with rel_path and content (text or bytes). Options: path, folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PackWriter(self.options["path"], self.options["folder"])


def _current(path: str) -> list[str]:
    """The packs in force."""
    system, base = open_path(path)
    return (_read(system, f"{base}/{POINTER}") or {"packs": []})["packs"]


def _named(spark: SparkSession, path: str, packs: list[str]) -> DataFrame:
    """rel_path, pack of the files in packs."""
    kind = "rel_path string, pack string"
    return spark.read.schema(kind).json([f"{path}/{p}.json.gz" for p in packs]) if packs else spark.createDataFrame([], kind)


def _without(gone: DataFrame, path: str, folder: str, packs: list[str]) -> list[str]:
    """packs without the files of gone (rel_path, pack): those that hold any are written again."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        pack, drop, out = frame["pack"].iloc[0], set(frame["rel_path"]), _Packs(path, folder)
        for rel, data in _entries(path, pack):
            if rel not in drop:
                out.add(rel, data)
        return pd.DataFrame([(pack, next(iter(out.close()), None))], columns=["pack", "again"])

    if not packs:
        return []
    # As many tasks as packs: the paths are few bytes to Spark, which would put them all into one task.
    spread = gone.select("rel_path", "pack").repartition(min(len(packs), 10_000), "pack")
    again = {r.pack: r.again for r in spread.groupBy("pack").applyInPandas(write, "pack string, again string").collect()}
    return [p for p in (again.get(p, p) for p in packs) if p is not None]


@contextmanager
def _folder(path: str) -> Iterator[str]:
    """A folder for the packs of a write; it goes if the write fails."""
    folder = f"write-{_id()}"
    try:
        yield folder
    except Exception:
        _remove(*open_path(f"{path}/{folder}"))
        raise


def _pack(rows: DataFrame, path: str, folder: str) -> list[str]:
    """Rows (rel_path, content) in packs of a folder, each path in one of them."""
    spark = rows.sparkSession
    spark.dataSource.register(PackSource)
    with shuffles_removed(spark):
        rows.select("rel_path", "content").write.format(NAME).mode("append").option("path", path).option("folder", folder).save()
    system, base = open_path(path)
    packs = _read(system, f"{base}/{folder}/{LIST}")
    named = _named(spark, path, packs)
    # No hash twice, no path twice. Else paths are compared themselves.
    if named.groupBy(F.xxhash64("rel_path")).count().where("count > 1").isEmpty():
        return packs
    twice = named.groupBy("rel_path").agg(F.max("pack").alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = _without(named.join(twice, "rel_path").where("pack <> kept"), path, folder, packs)
    _discard(path, set(packs) - set(kept))
    return kept


def _discard(path: str, packs: set[str]) -> None:
    system, base = open_path(path)
    for pack in packs:
        for end in (".tar.zst", ".json.gz"):
            system.delete_file(f"{base}/{pack}{end}")


def _publish(path: str, packs: list[str], before: list[str]) -> None:
    """Puts packs in force and removes those before that no longer are."""
    files = _Files(path)
    files.put(POINTER, json.dumps({"packs": packs}).encode())
    _discard(path, set(before) - set(packs))
    for folder in {p.split("/")[0] for p in before} - {p.split("/")[0] for p in packs}:
        _remove(files.system, f"{files.folder}/{folder}")


def write_tree(rows: DataFrame, path: str) -> None:
    """Writes a whole tree (rel_path, content) and puts it in force. The tree before is removed."""
    with _folder(path) as folder:
        packs = _pack(rows, path, folder)
    _publish(path, packs, _current(path))


def update_tree(rows: DataFrame, gone: DataFrame, path: str) -> None:
    """Puts rows (rel_path, content) into the tree in force and removes the paths of gone (rel_path). Of a path in both, the row stays."""
    spark, before = rows.sparkSession, _current(path)
    with _folder(path) as folder:
        new = _pack(rows, path, folder)
        out = gone.select("rel_path").unionByName(_named(spark, path, new).select("rel_path")).distinct()
        kept = _without(_named(spark, path, before).join(out, "rel_path"), path, folder, before)
    _publish(path, kept + new, before)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, content (bytes) of the tree in force."""
    packs = _current(path)
    if not packs:
        return spark.createDataFrame([], _KIND)

    def batch(names: list[str], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["rel_path", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for n in given.column("id").to_pylist():
                names, contents, held = [], [], 0
                for rel, data in _entries(path, packs[n]):
                    names.append(rel)
                    contents.append(data)
                    held += len(data)
                    if held >= 1 << 24 or len(names) >= 10_000:
                        yield batch(names, contents)
                        names, contents, held = [], [], 0
                yield batch(names, contents)

    return spark.range(0, len(packs), 1, min(len(packs), 10_000)).mapInArrow(read, _KIND)
