"""Impact report for a stream of tickets.

The lookup needs no state: each ticket is answered on its own from the index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplemap.operators.issues import (
    UNUSED, UNUSED_NOTE, USED, impact_report, issue_refs,
)
from ripplemap.operators.skew import SALT, default_salts
from ripplemap.schemas import BI_SOURCE, CODE_SOURCE, SOURCES


#: A field is hot with more than one ``HOT_PARTS``-th of all references; so at most
#: ``HOT_PARTS`` fields are, and a table of them may be broadcast.
HOT_PARTS = 1_000


def hot_fields(refs: DataFrame) -> DataFrame:
    """(field, shares): fields that many references of a batch name, into how many shares they go.

    One with all of them has four shares a shuffle partition, as hashes of fewer would meet in
    some partitions and miss others; one with less has so many less, but two.
    """
    salts = 4 * default_salts(refs)
    counts = refs.groupBy("field").agg(F.count("*").alias("n"))
    total = refs.agg(F.count("*")).first()[0]
    shares = F.least(F.ceil(F.col("n") * salts / F.lit(max(total, 1))).cast("int") + 1, F.lit(salts))
    return counts.filter(F.col("n") * HOT_PARTS > total).select("field", shares.alias("shares"))


def stream_report(issues: DataFrame, index: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Report rows as a stateless stream-static left join; no watermark is needed.

    ``hot`` (``hot_fields`` of an earlier batch, at most ``HOT_PARTS`` rows) says which fields
    are split: their tickets are dealt to shares, and only their index rows are repeated, once
    a share. It changes how rows are spread, never which there are.
    """
    refs = issue_refs(issues)
    keys = ["field"]
    index = index.withColumn("field", F.col("pk"))
    if hot is not None:
        few = F.broadcast(hot.select("field", "shares"))
        shares = F.coalesce(F.col("shares"), F.lit(1))
        refs = refs.join(few, "field", "left").withColumn(
            SALT, F.pmod(F.xxhash64("issue_key", "pos"), shares).cast("int")).drop("shares")
        index = index.join(few, "field", "left").withColumn(
            SALT, F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
        keys = ["field", SALT]
    used = F.col("pk").isNotNull()
    section = F.when(F.col("source") == BI_SOURCE, SOURCES[BI_SOURCE]).when(
        F.col("source") == CODE_SOURCE, SOURCES[CODE_SOURCE]
    )
    joined = refs.join(index, keys, "left")
    return joined.select(
        "issue_key", "pos", "field", F.when(used, USED).otherwise(UNUSED).alias("status"),
        F.when(F.col("label").isNotNull(), section).alias("section"), "label", "url",
        F.when(~used, UNUSED_NOTE).alias("note"),
    )


def write_report(
    issues: DataFrame, load_index: Callable[[], DataFrame], sink: str, checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Write each micro-batch's report under ``sink``, one folder per batch.

    Every batch reads the index anew, so a fresh version is used as soon as it is
    listed, and runs the salted batch plan. A batch that is run again after a failure
    overwrites its own folder, so no row is doubled or lost.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        report = impact_report(batch, load_index())
        report.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        issues.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
