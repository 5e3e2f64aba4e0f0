"""Files of any size as rows: a Spark source that reads them in pieces and returns their digests, never their whole content.

Small files share a partition, up to SHARE bytes, a larger one is a partition of its own, so a lost task reads its files
again and no others. Hidden files and folders count like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from leafmill.sources.trees import open_path

#: Bytes that small files of a partition have together, bytes read at once.
SHARE, PIECE = 1 << 27, 1 << 22
NAME = "leafmill_files"


@dataclass
class Share(InputPartition):
    files: list[tuple[str, int]]


class DigestReader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        system, base = open_path(self.path)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File)
        out, held = [], 0
        for name, size in found:
            if not out or held + size > self.share:
                out.append(Share([]))
                held = 0
            out[-1].files.append((name, size))
            held += size
        # A source without files still has a task.
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, base = open_path(self.path)
        for name, _ in partition.files:
            made, size = hashlib.sha256(), 0
            with system.open_input_stream(name, buffer_size=PIECE) as source:
                while piece := source.read(PIECE):
                    made.update(piece)
                    size += len(piece)
            yield name[len(base.rstrip("/")) + 1 :], made.hexdigest(), size


class DigestSource(DataSource):
    """rel_path, digest, size of the files below the option path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "rel_path string, digest string, size bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader(self.options["path"], int(self.options.get("share", SHARE)))


def digest_files(spark: SparkSession, path: str, *, share: int = SHARE) -> DataFrame:
    """rel_path, digest (SHA-256), size of every file below path."""
    spark.dataSource.register(DigestSource)
    return spark.read.format(NAME).option("path", path).option("share", str(share)).load()
