"""Documents, html and media as a tree of files: a Spark sink with a commit protocol, and changes to a tree that is there.

`write_tree` writes a whole tree: tasks write files into a folder of this write, each under a passing name first and then
renamed, and the commit points at the folder. Until then readers see the tree before; an abort removes the folder. A task
that is killed or runs twice leaves whole files only, equal ones, and no tree.

`update_tree` changes some files of a tree in place, as a run of the export does: the new files are written as above, beside
the tree; once they all are, a journal names them, and tasks move them in and remove what goes. A run that dies in between
is finished by `recover`, which does the moves of the journal again: moving what is there already is no error.

Any file system that Arrow knows will do (local, HDFS, S3, Google). Paths that are absolute or hold a `..` step are refused.

    <path>/CURRENT                 the folder in force and where its files are named, as JSON
    <path>/tree-<id>/<rel_path>    files
    <path>/tree-<id>-names/        their paths (Spark lists no folders such as .media)
    <path>/JOURNAL                 changes that are being put in place
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER, JOURNAL, PASSING = "CURRENT", "JOURNAL", ".passing"
NAME = "leafmill_tree"


def open_path(path: str):
    """Arrow's file system for a path, and the path in it."""
    from pyarrow import fs

    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = path.replace(old, new, 1) if path.startswith(old) else path
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _there(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def _remove(system, path: str) -> None:
    if _there(system, path):
        system.delete_dir(path)


def _safe(rel_path: str) -> str:
    if not rel_path or rel_path.startswith("/") or "\\" in rel_path or any(p in ("", ".", "..") for p in rel_path.split("/")):
        raise ValueError(f"not a path below the tree: {rel_path!r}")
    return rel_path


def _read(system, path: str) -> dict | None:
    if not _there(system, path):
        return None
    with system.open_input_stream(path) as source:
        return json.loads(source.read())


class _Files:
    """Writes files below a folder."""

    def __init__(self, folder: str):
        self.system, self.folder = open_path(folder)
        self.made: set[str] = set()

    def within(self, rel_path: str) -> str:
        path = f"{self.folder}/{rel_path}"
        parent = path.rsplit("/", 1)[0]
        if parent not in self.made:
            self.system.create_dir(parent, recursive=True)
            self.made.add(parent)
        return path

    def put(self, rel_path: str, data: bytes) -> None:
        """A file, there as a whole or not at all."""
        path, passing = self.within(rel_path), self.within(f"{PASSING}/{uuid.uuid4().hex}")
        with self.system.open_output_stream(passing) as out:
            out.write(data)
        self.system.move(passing, path)


class _Names:
    """Paths of a task's files, as lines of JSON, some at a time."""

    def __init__(self, folder: str):
        self.files, self.held = _Files(folder), []

    def add(self, rel_path: str) -> None:
        self.held.append(json.dumps({"rel_path": rel_path}))
        if len(self.held) >= 100_000:
            self.close()

    def close(self) -> None:
        if self.held:
            self.files.put(f"{uuid.uuid4().hex}.json", "\n".join(self.held).encode())
            self.held = []


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class TreeWriter(DataSourceWriter):
    def __init__(self, path: str, folder: str, pointer: str):
        self.path, self.folder, self.pointer = path, folder, pointer

    def write(self, iterator: Iterator[Row]) -> Written:
        files, names, count, size = _Files(f"{self.path}/{self.folder}"), _Names(f"{self.path}/{self.folder}-names"), 0, 0
        for row in iterator:
            data = row.content.encode() if isinstance(row.content, str) else bytes(row.content or b"")
            files.put(_safe(row.rel_path), data)
            names.add(row.rel_path)
            count, size = count + 1, size + len(data)
        names.close()
        return Written(count, size)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        files = _Files(self.path)
        for folder in (self.folder, f"{self.folder}-names"):
            files.system.create_dir(f"{files.folder}/{folder}", recursive=True)
            _remove(files.system, f"{files.folder}/{folder}/{PASSING}")
        files.put(self.pointer, json.dumps({"folder": self.folder, "names": f"{self.folder}-names", "files": sum(m.files for m in done), "size": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for folder in (self.folder, f"{self.folder}-names"):
            _remove(*open_path(f"{self.path}/{folder}"))


class TreeSource(DataSource):
    """Sink of rows with rel_path and content (text or bytes). Options: path, folder, pointer."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"], self.options["folder"], self.options.get("pointer", POINTER))


def _write(rows: DataFrame, path: str, folder: str, pointer: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(TreeSource)
    rows.select("rel_path", "content").write.format(NAME).mode("append").option("path", path).option("folder", folder).option("pointer", pointer).save()


def _current(path: str) -> dict | None:
    system, base = open_path(path)
    return _read(system, f"{base}/{POINTER}")


def current_tree(path: str) -> str | None:
    """The folder of the tree in force."""
    found = _current(path)
    return f"{path}/{found['folder']}" if found else None


def _named(spark: SparkSession, path: str, found: dict) -> DataFrame:
    return spark.read.schema("rel_path string").json(f"{path}/{found['names']}").distinct()


def write_tree(rows: DataFrame, path: str) -> str:
    """Writes a whole tree (rel_path, content) and puts it in force; its folder. The tree before is removed."""
    before, folder = _current(path), f"tree-{uuid.uuid4().hex}"
    _write(rows, path, folder, POINTER)
    for old in (before["folder"], before["names"]) if before else ():
        _remove(*open_path(f"{path}/{old}"))
    return f"{path}/{folder}"


def update_tree(rows: DataFrame, gone: DataFrame, path: str) -> str:
    """Puts rows (rel_path, content) into the tree in force and removes the paths of gone (rel_path); the tree's folder.

    Of a path in both, the row stays. A journal that an earlier run left is finished first.
    """
    spark = rows.sparkSession
    recover(spark, path)
    tree = current_tree(path)
    if tree is None:
        return write_tree(rows, path)
    folder = f"change-{uuid.uuid4().hex}"
    # What goes is named by a table beside the files, so that it can be done again.
    gone.select("rel_path").join(rows.select("rel_path"), "rel_path", "left_anti").distinct().write.parquet(f"{path}/{folder}-gone")
    _write(rows, path, folder, JOURNAL)
    recover(spark, path)
    return tree


def recover(spark: SparkSession, path: str) -> bool:
    """Puts in place what a journal names; whether there was one."""
    system, base = open_path(path)
    journal, found = _read(system, f"{base}/{JOURNAL}"), _current(path)
    if journal is None or found is None:
        return False
    change, tree = f"{path}/{journal['folder']}", f"{path}/{found['folder']}"

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, live = _Files(change), _Files(tree)
        for frame in frames:
            for rel in frame["rel_path"]:
                source = f"{new.folder}/{rel}"
                # An attempt before this one may have moved it.
                if _there(new.system, source):
                    new.system.move(source, live.within(_safe(rel)))
            yield frame

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = _Files(tree)
        for frame in frames:
            for rel in frame["rel_path"]:
                if _there(live.system, f"{live.folder}/{_safe(rel)}"):
                    live.system.delete_file(f"{live.folder}/{rel}")
            yield frame

    gone, new = spark.read.schema("rel_path string").parquet(f"{change}-gone"), _named(spark, path, journal)
    gone.mapInPandas(remove, "rel_path string").write.format("noop").mode("overwrite").save()
    new.mapInPandas(move, "rel_path string").write.format("noop").mode("overwrite").save()
    # The names of what is there now, for the next reader.
    names = f"{journal['folder']}-all"
    if found["names"] != names:
        _named(spark, path, found).join(gone, "rel_path", "left_anti").unionByName(new).distinct().write.mode("overwrite").json(f"{path}/{names}")
        _Files(path).put(POINTER, json.dumps({**found, "names": names}).encode())
        _remove(*open_path(f"{path}/{found['names']}"))
    system.delete_file(f"{base}/{JOURNAL}")
    for folder in (change, f"{change}-names", f"{change}-gone"):
        _remove(*open_path(folder))
    return True


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, content (bytes) of the tree in force."""
    found = _current(path)
    kind = "rel_path string, content binary"
    if found is None:
        return spark.createDataFrame([], kind)
    tree = f"{path}/{found['folder']}"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = open_path(tree)
        for frame in frames:
            out, held = [], 0
            for rel in frame["rel_path"]:
                with system.open_input_file(f"{folder}/{rel}") as source:
                    out.append((rel, source.read()))
                held += len(out[-1][1])
                if held >= 1 << 24:
                    yield pd.DataFrame(out, columns=["rel_path", "content"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["rel_path", "content"])

    return _named(spark, path, found).mapInPandas(read, kind)


def tree_rows(documents: DataFrame, media: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """Rows for the sink: documents (rel_path, content) and, with media (path, digest) and blobs (digest, content), the media beside them."""
    rows = documents.select("rel_path", F.encode("content", "UTF-8").alias("content"))
    if media is None or blobs is None:
        return rows
    files = media.select(F.col("path").alias("rel_path"), "digest").distinct().join(blobs.select("digest", "content"), "digest")
    return rows.unionByName(files.select("rel_path", "content"))
