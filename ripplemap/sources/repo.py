"""Repository files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemap.functions.names import base_name
from ripplemap.sources import folder


def from_table(snapshot: DataFrame) -> DataFrame:
    """A snapshot table with (ordinal, path, url, content) as repository files.

    The preferred source: a table splits evenly over tasks without a walk. Binary content
    becomes valid UTF-8 text.
    """
    content = F.col("content")
    if snapshot.schema["content"].dataType == T.BinaryType():
        content = F.make_valid_utf8(content.cast("string"))
    return snapshot.select(
        "ordinal", "path", base_name(F.col("path")).alias("name"), "url",
        content.alias("content"),
    )


def read_repo(
    spark: SparkSession, root: str, url_prefix: str = "", suffixes: Sequence[str] = (".sql", ".yml")
) -> DataFrame:
    """A checked-out folder tree as repository files: those with one of the suffixes, or all.

    Directories are not emitted; names that start with ``.`` or ``_`` are, but for the version
    control's own folder. ``ordinal`` is (depth, path pieces), the order of a breadth-first
    walk, so no task has to number the files. ``root`` is a path or an address that every
    executor can open.
    """
    listed = folder.names(spark, root)
    if suffixes:
        listed = listed.filter(reduce(or_, (F.col("path").endswith(s) for s in suffixes)))
    pieces = F.split("path", "/")
    return from_table(
        folder.contents(listed, root).select(
            F.struct(F.size(pieces).alias("depth"), pieces.alias("pieces")).alias("ordinal"),
            "path",
            F.concat(F.lit(url_prefix), F.col("path")).alias("url"),
            "content",
        )
    )
