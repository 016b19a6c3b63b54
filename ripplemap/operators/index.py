"""The reference index: rows (source, pk, label, url).

A key's record is the set of its rows. Two attributes never share a row, so writing
one leaves the other alone, and a table that a third of the corpus uses is many rows
that Spark can split, not one record with a huge map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.operators.skew import join_back, key_rows, with_salt
from ripplemap.schemas import BI_SOURCE, CODE_SOURCE, check_source

MERGE_MODES = ("upsert", "replace")
MISSING_KEY = "MissingKey"


def as_attribute(entries: DataFrame, source: str) -> DataFrame:
    """Entries (pk, label, url) as index rows of one source."""
    return entries.select(F.lit(check_source(source)).alias("source"), "pk", "label", "url")


def reference_index(code: DataFrame, bi: DataFrame) -> DataFrame:
    """Both attributes side by side; keys of either one are keys of the index."""
    return as_attribute(code, CODE_SOURCE).unionByName(as_attribute(bi, BI_SOURCE))


def valid_key(df: DataFrame) -> DataFrame:
    return df.filter(F.col("pk").isNotNull() & (F.col("pk") != ""))


def rejected_keys(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("pk").isNull() | (F.col("pk") == "")).withColumn(
        "reason", F.lit(MISSING_KEY)
    )


def merge_entries(old: DataFrame, new: DataFrame, mode: str = "upsert") -> DataFrame:
    """One source's entries after a run: a key of the new run replaces its old entries.

    upsert: keys the new run lacks keep their old entries. replace: they go.
    """
    if mode not in MERGE_MODES:
        raise ValueError(f"mode must be one of {MERGE_MODES}, not {mode!r}")
    columns = ["pk", "label", "url"]
    fresh = valid_key(new).select(*columns)
    if mode == "replace":
        return fresh
    salted = with_salt(old.select(*columns), ["label"])
    stale = key_rows(salted, ["pk"]).join(fresh.select("pk").distinct(), "pk", "left_anti")
    return join_back(salted, stale, ["pk"]).select(*columns).unionByName(fresh)


def merge_index(old: DataFrame, new: DataFrame, source: str, mode: str = "upsert") -> DataFrame:
    """Index after writing one source's new entries; the other source's rows pass through."""
    check_source(source)
    others = old.filter(F.col("source") != source)
    merged = merge_entries(old.filter(F.col("source") == source), new, mode)
    return others.unionByName(as_attribute(merged, source))


def index_keys(index: DataFrame, *aggregates) -> DataFrame:
    """(pk, has_dashboards, has_files, n_dashboards, n_files): one row per key.

    An attribute that lists nothing is there (``has_…``) but counts no entries.
    """
    of = lambda source: F.col("source") == source
    listed = F.col("label").isNotNull()
    count_of = lambda source: F.count(F.when(of(source) & listed, 1))
    return index.groupBy("pk").agg(
        F.max(of(BI_SOURCE)).alias("has_dashboards"),
        F.max(of(CODE_SOURCE)).alias("has_files"),
        count_of(BI_SOURCE).alias("n_dashboards"),
        count_of(CODE_SOURCE).alias("n_files"),
        *aggregates,
    )


def to_records(index: DataFrame, entries_per_part: int = 10_000) -> DataFrame:
    """Records (pk, part, github.files, tableau.dashboards) for a key-value reader.

    A key with up to ``entries_per_part`` entries is one record, part 0. A larger key
    is split by a hash of the label into parts of about that size, so no map grows
    without bound. A missing attribute is a null struct in each part, an empty one
    an empty map.
    """
    salted = with_salt(index, ["label"])
    size = F.ceil(F.count("*") / F.lit(entries_per_part)).cast("int").alias("parts")
    keyed = key_rows(
        salted, ["pk"], size,
        F.max(F.col("source") == BI_SOURCE).alias("has_dashboards"),
        F.max(F.col("source") == CODE_SOURCE).alias("has_files"),
    )
    # Salted by another seed than the part, or a part would sit in few tasks.
    part = F.pmod(F.hash("label"), F.col("parts")).alias("part")
    rows = join_back(salted, keyed, ["pk"]).withColumn("part", part)

    def attribute(source: str, field: str):
        entry = F.when(
            (F.col("source") == source) & F.col("label").isNotNull(), F.struct("label", "url")
        )
        entries = F.map_from_entries(F.array_sort(F.collect_list(entry)))
        return F.struct(entries.alias(field))

    flags = ["has_dashboards", "has_files"]
    grouped = rows.groupBy("pk", "part", *flags).agg(
        attribute(CODE_SOURCE, "files").alias("github"),
        attribute(BI_SOURCE, "dashboards").alias("tableau"),
    )
    return grouped.select(
        "pk", F.col("part").cast("long").alias("part"),
        F.when(F.col("has_files"), F.col("github")).alias("github"),
        F.when(F.col("has_dashboards"), F.col("tableau")).alias("tableau"),
    )

