"""The stored index: buckets of keys, rewritten one by one, and a manifest for each version.

Layout under a base folder::

    <source>/incoming/version=<n>/…           entries of a run while it is merged
    <source>/data/version=<n>/bucket=<b>/…    the buckets (pk, label, url) that run n wrote
    <source>/rejected/version=<n>/…           entries of the run without a key, with the reason
    <source>/manifests/version=<n>/…          (bucket, written): the version each bucket is read from
    <source>/versions/…                       one row per finished version

A key's bucket is a hash of it. A run reads and writes only the buckets that hold a key of
its own; all others stay where an earlier version wrote them. A version becomes visible when
its row is written, after its data and its manifest; a run that dies before that leaves unlisted
folders which the next run overwrites. The two sources are written independently, so both
ingests can run at once. A manifest has at most one row for each bucket, so it is read on the
driver. Bucket files are sorted by key and have Bloom filters on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.operators.index import as_attribute, merge_entries, rejected_keys, valid_key
from ripplemap.operators.issues import get_references, requested_fields
from ripplemap.operators.skew import salt_of
from ripplemap.schemas import ENTRIES, INDEX, SOURCES, check_source
from ripplemap.sources.scratch import emptied

#: Buckets of a source; fixed for a store, since a key must be found again.
BUCKETS = 256
#: Files that the entries of one bucket, and so of one key, may be spread over.
FILES_PER_BUCKET = 16
_MANIFEST = "bucket int, written long"
_REJECTED = "pk string, label string, url string, reason string"


def bucket_of(pk: Column | str) -> Column:
    return F.pmod(F.xxhash64(pk), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, base: str, source: str) -> list[int]:
    try:
        listed = spark.read.schema("version long").parquet(f"{base}/{source}/versions")
        return sorted(r[0] for r in listed.distinct().collect())
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current_version(spark: SparkSession, base: str, source: str) -> int | None:
    return max(_versions(spark, base, source), default=None)


def _at(base: str, source: str, what: str, version: int) -> str:
    return f"{base}/{source}/{what}/version={version}"


def _bucket_path(base: str, source: str, written: int, bucket: int) -> str:
    return f"{_at(base, source, 'data', written)}/bucket={bucket}"


def manifest(spark: SparkSession, base: str, source: str, version: int | None = None) -> dict[int, int]:
    """The version that wrote each bucket, as of a version (the current one); empty without any."""
    version = current_version(spark, base, check_source(source)) if version is None else version
    if version is None:
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(_at(base, source, "manifests", version)).collect()
    return {r["bucket"]: r["written"] for r in rows}


def _entries(spark: SparkSession, base: str, source: str, buckets: dict[int, int]) -> DataFrame:
    if not buckets:
        return spark.createDataFrame([], ENTRIES)
    paths = [_bucket_path(base, source, written, b) for b, written in sorted(buckets.items())]
    return spark.read.schema(ENTRIES).parquet(*paths)


def read_entries(spark: SparkSession, base: str, source: str) -> DataFrame:
    return _entries(spark, base, check_source(source), manifest(spark, base, source))


def read_index(spark: SparkSession, base: str) -> DataFrame:
    index = spark.createDataFrame([], INDEX)
    for source in SOURCES:
        index = index.unionByName(as_attribute(read_entries(spark, base, source), source))
    return index


def read_keys(spark: SparkSession, base: str, keys: Sequence[str]) -> DataFrame:
    """Index rows of some keys: only their buckets are opened, and of those what holds a key."""
    wanted = sorted(set(keys))
    index = spark.createDataFrame([], INDEX)
    if not wanted:
        return index
    asked = spark.createDataFrame([(k,) for k in wanted], "pk string")
    buckets = {r[0] for r in asked.select(bucket_of("pk")).distinct().collect()}
    for source in SOURCES:
        there = {b: v for b, v in manifest(spark, base, source).items() if b in buckets}
        found = _entries(spark, base, source, there).filter(F.col("pk").isin(*wanted))
        index = index.unionByName(as_attribute(found, source))
    return index


def stored_references(spark: SparkSession, base: str, fields: Sequence[str] | str) -> DataFrame:
    """``get_references`` from a store: only the buckets of the fields are read."""
    wanted = requested_fields(spark, fields)
    return get_references(read_keys(spark, base, wanted), wanted)


def read_rejected(spark: SparkSession, base: str, source: str) -> DataFrame:
    """(pk, label, url, reason) of the current version's run."""
    version = current_version(spark, base, check_source(source))
    if version is None:
        return spark.createDataFrame([], _REJECTED)
    return spark.read.schema(_REJECTED).parquet(_at(base, source, "rejected", version))


def upsert_index(
    spark: SparkSession, base: str, new: DataFrame, source: str, mode: str = "upsert"
) -> int:
    """Write one source's entries of a run and return the version that holds them.

    The run's entries are written before they are merged: the merge needs them more than once,
    and the corpus is not to be read again for that. upsert rewrites the buckets with a key of
    the run; replace drops all others.

    Rows are dealt by (bucket, salt of the label) and sorted: nothing is sampled first, and a
    key with very many entries is in several files.
    """
    version = current_version(spark, base, check_source(source))
    following = 1 if version is None else version + 1
    incoming = _at(base, source, "incoming", following)
    new.select(*ENTRIES.names).write.mode("overwrite").parquet(incoming)
    arrived = spark.read.schema(ENTRIES).parquet(incoming)
    rejected_keys(arrived).write.mode("overwrite").parquet(_at(base, source, "rejected", following))
    touched = {r[0] for r in valid_key(arrived).select(bucket_of("pk")).distinct().collect()}
    before = manifest(spark, base, source, version) if version is not None else {}
    old = _entries(spark, base, source, {b: v for b, v in before.items() if b in touched})
    merged = merge_entries(old, arrived, mode).withColumn("bucket", bucket_of("pk"))
    (
        merged.repartition("bucket", salt_of("label", salts=FILES_PER_BUCKET))
        .sortWithinPartitions("bucket", "pk", "label")
        .write.mode("overwrite").option("parquet.bloom.filter.enabled#pk", "true")
        .partitionBy("bucket").parquet(_at(base, source, "data", following))
    )
    stays = {} if mode == "replace" else {b: v for b, v in before.items() if b not in touched}
    after = sorted((stays | dict.fromkeys(touched, following)).items())
    spark.createDataFrame(after, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        _at(base, source, "manifests", following))
    (
        spark.range(following, following + 1).toDF("version").coalesce(1)
        .write.mode("append").parquet(f"{base}/{source}/versions")
    )
    emptied(spark, incoming)
    return following


def expire_versions(spark: SparkSession, base: str, source: str, keep: int = 1) -> int:
    """Empty the buckets that none of the last ``keep`` versions reads; how many there were.

    Call it when no reader of an older version is left. The rejects of those versions go too.
    """
    if keep < 1:
        raise ValueError("the current version cannot expire")
    versions = _versions(spark, base, check_source(source))
    kept, gone = versions[-keep:], versions[:-keep]
    manifests = {v: set(manifest(spark, base, source, v).items()) for v in versions}
    read = {x for v in kept for x in manifests[v]}
    stale = sorted({x for v in gone for x in manifests[v]} - read)
    for bucket, written in stale:
        emptied(spark, _bucket_path(base, source, written, bucket))
    for version in gone:
        emptied(spark, _at(base, source, "rejected", version))
    # older versions are no longer listed; their manifests would name emptied buckets
    spark.createDataFrame([(v,) for v in kept], "version long").coalesce(1).write.mode("overwrite").parquet(
        f"{base}/{source}/versions")
    return len(stale)
