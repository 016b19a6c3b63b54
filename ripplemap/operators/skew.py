"""Equi-joins that stay balanced when one key holds a large part of the rows.

The many-rows side of a join (the *facts*) gets a salt from a column that varies
within a key. Its keys, grouped with partial aggregation, carry the set of salts that
occur, at most ``salts`` small integers each. Whatever is known per key is joined to
these key rows first, unique against unique; each key row is then repeated once per
salt it has and joined back on (key, salt). A hot key is so spread over ``salts``
tasks, a key with one row is repeated once, and there are never more key rows than
fact rows. Nothing is broadcast by hint and nothing is dropped. The salt's column is
``SALT``, the set's ``SALTS``: names that data should not have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SALT, SALTS = "__salt", "__salts"


def default_salts(df: DataFrame) -> int:
    """As many salts as shuffle partitions: a hot key can use every one of them."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salt_of(*columns: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def with_salt(facts: DataFrame, by: Sequence[str], salts: int | None = None) -> DataFrame:
    return facts.withColumn(SALT, salt_of(*by, salts=salts or default_salts(facts)))


def key_rows(salted: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key with its set of salts and the given aggregates."""
    return salted.groupBy(*keys).agg(F.collect_set(SALT).alias(SALTS), *aggregates)


def spread(keyed: DataFrame) -> DataFrame:
    """Repeat each key row for each of its salts."""
    return keyed.withColumn(SALT, F.explode(SALTS)).drop(SALTS)


def join_back(
    salted: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Give the facts what is known of their key. ``keyed`` has the salts of ``key_rows``."""
    return salted.join(spread(keyed), [*keys, SALT], how).drop(SALT)
