"""Tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only what is used of a ticket export is read.
TICKET_EXPORT = "key string, fields struct<summary:string>"


def from_export(tickets: DataFrame) -> DataFrame:
    """Ticket documents (key, fields.summary) as (issue_key, summary)."""
    return tickets.select(F.col("key").alias("issue_key"), F.col("fields.summary").alias("summary"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Ticket documents, one JSON object per line."""
    return from_export(spark.read.schema(TICKET_EXPORT).json(path))


def from_text(df: DataFrame, column: str) -> DataFrame:
    return from_export(
        df.select(F.from_json(column, TICKET_EXPORT).alias("t")).select("t.*")
    )
