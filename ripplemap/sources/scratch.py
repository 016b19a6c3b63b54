"""Tables that a job writes for its own later steps, in the folder that all executors see.

All tables of one application lie under one folder, so a user whose results are stored can
let go of the rest with ``clear_scratch``. Steps drop what they no longer need with ``discard``.
"""

from __future__ import annotations

import threading
from collections import Counter
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ripplemap.session import shared_folder

#: Spark's setting that shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writers: Counter[int] = Counter()
_before: dict[int, str | None] = {}


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ripplemap-{spark.conf.get('spark.app.id')}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid4().hex}"


class _cleanup:
    """Shuffle files go after each query while any thread of a session is in here."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        key = id(self.spark)
        with _lock:
            if not _writers[key]:
                _before[key] = self.spark.conf.get(CLEANUP, None)
                self.spark.conf.set(CLEANUP, "true")
            _writers[key] += 1

    def __exit__(self, *_) -> None:
        key = id(self.spark)
        with _lock:
            _writers[key] -= 1
            if _writers[key]:
                return
            if (value := _before.pop(key)) is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, value)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files.

    Spark removes the shuffle files of the write when it is done; nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Put a table without rows where a folder of tables is."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the rows of tables that ``cut`` wrote, once nothing reads them any more.

    An empty table takes their place, since Spark's writers remove files only that way.
    """
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            emptied(table.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application: results that still read them must be stored."""
    emptied(spark, scratch_root(spark))
