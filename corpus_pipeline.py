"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept, written as Parquet and read again,
and gives documents with the same columns; the last gives token ids. Stages work on a row
packed into a struct beside its id and text, so other columns pass unseen, whatever their
names. Null ids and texts, repeated rows and empty tables are as the operators define them.
"""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.llm import bpe, decontaminate, language, line_dedup, simhash_bk
from ripplemap.llm.common import cut, text_digest

ROW = "__row"
RANKS = "byte_bpe_50k.tiktoken"
#: Rows of an Arrow batch. All stages share their Python workers, which keep the memory of the
#: largest batch they saw; whole documents make the default of 10,000 rows large.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    # Read when the stage's result is written, after its function ends; ``run`` sets it back.
    docs.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return docs.select(F.struct(*docs.columns).alias(ROW), "doc_id", "text", *columns)


def _unpacked(rows: DataFrame, columns: Sequence[str], text: Column | None = None) -> DataFrame:
    """The documents' own columns, with a new text if there is one."""
    return rows.select(*(
        text.alias(c) if c == "text" and text is not None else F.col(f"{ROW}.{c}").alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    rows = _packed(docs, "lang").withColumn("__held_out", language.held_out())
    dictionaries = language.train(rows.filter("NOT __held_out"))
    marked = language.identify(rows, dictionaries)
    return _unpacked(marked.filter("NOT rejected"), docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, frequent lines kept in one document only."""
    rows = line_dedup.drop_lines(_packed(docs))
    return _unpacked(rows, docs.columns, F.col("text"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: three-word shingles, three bits.

    The one of the least id stays, and of its texts the one of the least digest; of rows with
    the same id and text the one whose columns have the least hash; of equal rows one.
    """
    facts = [x for c in docs.columns for x in (F.col(f"{ROW}.{c}"), F.col(f"{ROW}.{c}").isNull())]
    rows = _packed(docs).withColumns({
        "high": F.xxhash64(F.lit(3), *facts), "low": F.xxhash64(F.lit(4), *facts)})
    found = cut(simhash_bk.near_duplicates(rows.withColumn("digest", text_digest()).drop(ROW)), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "high", "low")
    stays = found.groupBy("component").agg(F.min(place).alias("s")).select("s.high", "s.low")
    return _unpacked(rows.join(stays, ["high", "low"]).dropDuplicates(["high", "low"]), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontaminate.decontaminate(_packed(docs), items), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it again."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    tokens = bpe.decode(bpe.encode(_packed(docs), path, pattern), path, pattern)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return tokens.select("doc_id", "n_tokens", "token_bytes", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Compression, fingerprints and merges are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
