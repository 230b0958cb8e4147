"""A folder of text files as a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.corpus import is_hidden, matches_glob

SKIPPED = ".git"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the full path in it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


class _Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Listing(DataSourceReader):
    """One partition per folder; a task lists the files of its folder."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        system, base = _opened(self.root)
        found, waiting = [], [base]
        while waiting:
            folder = waiting.pop()
            found.append(_Folder(folder))
            inside = system.get_file_info(fs.FileSelector(folder or "/"))
            waiting += [f.path for f in inside if f.type == fs.FileType.Directory and f.base_name != SKIPPED]
        return found

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, base = _opened(self.root)
        inside = system.get_file_info(fs.FileSelector(partition.path or "/"))
        files = [f for f in inside if f.type == fs.FileType.File]
        columns = [
            pa.array([f.path[len(base) + 1 :] for f in files], pa.string()),
            pa.array([f.mtime_ns // 1_000_000 if f.mtime_ns else None for f in files], pa.int64()),
            pa.array([f.size for f in files], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "mtime", "size"])


class FolderListing(DataSource):
    """``path`` below the root, ``mtime`` in milliseconds and ``size`` of every file, hidden ones included."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, mtime long, size long"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of the files below ``root``; ``.git`` is never entered.

    Spark's own listing leaves out names that start with ``.`` or ``_``; this one does
    not. The driver only holds the folders.
    """
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(root.rstrip("/"))


def scan_corpus(
    spark: SparkSession, root: str, globs: tuple[str, ...] = (), max_depth: int | None = None, hidden: bool = True
) -> DataFrame:
    """(path, mtime, text) of the files below ``root``; globs starting with ``!`` exclude.

    Path conditions are applied to the listing, before a file is opened. Files are
    dealt out by their number, whatever folder they are in.
    """
    files = list_files(spark, root)
    keep = F.lit(True)
    included = [g for g in globs if not g.startswith("!")]
    if included:
        keep = F.lit(False)
        for g in included:
            keep = keep | matches_glob(F.col("path"), g)
    for g in globs:
        if g.startswith("!"):
            keep = keep & ~matches_glob(F.col("path"), g[1:])
    if max_depth is not None:
        keep = keep & (F.size(F.split("path", "/")) <= max_depth)
    if not hidden:
        keep = keep & ~is_hidden(F.col("path"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                with system.open_input_stream(f"{base}/{path}") as stream:
                    content = pa.array([stream.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), content], names=["path", "mtime", "content"])

    kept = files.where(keep).repartition("path").select("path", "mtime")
    found = kept.mapInArrow(contents, "path string, mtime long, content binary")
    return found.select("path", "mtime", F.decode("content", "UTF-8").alias("text"))
