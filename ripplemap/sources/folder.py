"""Names and contents of a folder tree, hidden names included.

Spark's own file sources leave out names that begin with a dot or an underscore. Here the
names come from a data source of our own, whose tasks walk one part of the tree each, and
the contents are read after names are dealt evenly: one folder with most of the files is
one task's walk, but every task's reading.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "folder_names"
#: Not part of a checked-out tree.
NOT_WALKED = (".git",)
#: Names or content bytes in one Arrow batch.
BATCH_NAMES, BATCH_BYTES = 10_000, 8 << 20

_NAMES = pa.schema([("path", pa.string()), ("size", pa.int64())])
_CONTENTS = pa.schema([("path", pa.string()), ("content", pa.binary())])


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, or the local one of a plain path, and the path in it."""
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root)
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def _listed(system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders and files right below a folder, by name. Links to folders are not followed."""
    found = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name)
    local = isinstance(system, fs.LocalFileSystem)
    folders = [
        f.path for f in found
        if f.type == fs.FileType.Directory and f.base_name not in NOT_WALKED
        and not (local and os.path.islink(f.path))
    ]
    return folders, [f for f in found if f.type == fs.FileType.File]


class _Part(InputPartition):
    """Folders of one task: those whose own files it lists, and those it walks to the end."""

    def __init__(self, flat: list[str], deep: list[str]):
        self.flat, self.deep = flat, deep


class _Names(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[_Part]:
        """Breadth first until a level has folders for all tasks; those are dealt in turn.

        Only names of the upper folders are held here, of files none.
        """
        system, base = opened(self.root)
        flat, level = [], [base]
        while level and len(level) < self.tasks:
            flat += level
            level = [child for folder in level for child in _listed(system, folder)[0]]
        dealt = [_Part(flat[i::self.tasks], level[i::self.tasks]) for i in range(self.tasks)]
        return [part for part in dealt if part.flat or part.deep]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        system, base = opened(self.root)
        paths, sizes = [], []
        waiting = [(folder, False) for folder in part.flat] + [(folder, True) for folder in part.deep]
        while waiting:
            folder, walk = waiting.pop()
            folders, files = _listed(system, folder)
            if walk:
                waiting += [(child, True) for child in folders]
            for file in files:
                paths.append(file.path[len(base) + 1:])
                sizes.append(file.size)
                if len(paths) == BATCH_NAMES:
                    yield pa.record_batch([paths, sizes], schema=_NAMES)
                    paths, sizes = [], []
        yield pa.record_batch([paths, sizes], schema=_NAMES)


class FolderNames(DataSource):
    """(path, size) of all files below a folder; option ``tasks``: how many walk it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> DataSourceReader:
        return _Names(self.options["path"], int(self.options.get("tasks", "1")))


def names(spark: SparkSession, root: str) -> DataFrame:
    """(path, size): every file below ``root``, its path from there."""
    spark.dataSource.register(FolderNames)
    tasks = spark.sparkContext.defaultParallelism
    return spark.read.format(FORMAT).option("tasks", tasks).load(root)


def contents(listed: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files, read by as many tasks as Spark deals the names to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        paths, held, size = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{base}/{path}") as file:
                    content = file.read()
                paths.append(path)
                held.append(content)
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.record_batch([paths, held], schema=_CONTENTS)
                    paths, held, size = [], [], 0
        yield pa.record_batch([paths, held], schema=_CONTENTS)

    tasks = listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("path").repartition(tasks, F.col("path")).mapInArrow(
        read, "path string, content binary")


def write_tree(files: DataFrame, root: str) -> int:
    """Write (path, content) as a folder tree and return how many; a task run again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            made = set()
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                full = f"{base}/{path}"
                if (folder := full.rsplit("/", 1)[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(full) as file:
                    file.write((content or "").encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["written"])

    done = files.select("path", "content").mapInArrow(write, "written long")
    return done.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
