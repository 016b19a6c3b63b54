"""BI metadata: from table nodes to (table, dashboard) entries.

The working form is flat: ``tables`` (ordinal, table_id, …) with one row per table and
``dashboards`` (table_id, pos, name, path) with one row per listed dashboard. A table
with very many dashboards is many rows, never one long array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemap.functions import names
from ripplemap.operators.skew import SALTS, join_back, key_rows, with_salt
from ripplemap.schemas import check_mode

# Connection types of text files and extracts, which are left out.
FILE_CONNECTIONS = ("hyper", "webdata-direct", "textscan", "excel-direct", "google-sheets")
MISSING_NAME = "MissingSchemaOrFullName"


def connection_filter(tables: DataFrame) -> DataFrame:
    """Tables of real databases. An unknown (null) connection type counts as one."""
    kind = F.col("connectionType")
    return tables.filter(kind.isNull() | ~kind.isin(*FILE_CONNECTIONS))


def bi_clean(tables: DataFrame) -> DataFrame:
    """Connection filter, lower-cased bracket-free names, corrected schema, column names."""
    full = F.lower(names.strip_brackets(F.col("fullName")))
    cleaned = (
        connection_filter(tables)
        .filter(F.col("fullName").isNotNull() & F.col("schema").isNotNull())
        .withColumn("fullName", full)
        .withColumn(
            "schema",
            F.when(F.col("fullName").contains(F.col("schema")), F.col("schema")).otherwise(
                F.split("fullName", r"\.")[0]
            ),
        )
    )
    if "columns" in tables.columns:
        cleaned = cleaned.withColumn(
            "columns", F.transform("columns", lambda c: F.lower(c["name"]))
        )
    return cleaned.withColumnsRenamed({"name": "table_name", "schema": "schema_name"})


def bi_quarantine(tables: DataFrame) -> DataFrame:
    """Tables that pass the connection filter but lack a schema or a full name."""
    return (
        connection_filter(tables)
        .filter(F.col("fullName").isNull() | F.col("schema").isNull())
        .withColumn("reason", F.lit(MISSING_NAME))
    )


def datasource_clean(datasources: DataFrame) -> DataFrame:
    """Datasources with a dashboard list: ``fields`` and ``tables`` as bracket-free names."""
    lowered = lambda x: F.lower(names.strip_brackets(x))
    return datasources.filter(F.col("downstreamDashboards").isNotNull()).select(
        F.transform("fields", lambda f: lowered(f["fullyQualifiedName"])).alias("fields"),
        F.transform("upstreamTables", lambda t: lowered(t["fullName"])).alias("tables"),
    )


def flatten_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split nested table nodes into (tables, dashboards); ``ordinal`` identifies a node."""
    tables = nodes.drop("downstreamDashboards").withColumn("table_id", F.col("ordinal"))
    listed = nodes.select(
        F.col("ordinal").alias("table_id"), F.posexplode("downstreamDashboards")
    )
    return tables, listed.select("table_id", "pos", "col.name", "col.path")


def _ranked(dashboards: DataFrame) -> DataFrame:
    """Of each (table, name) the first dashboard, which may be kept, and the second, which ends
    the list of its table. Spark cuts each group to two rows before the shuffle. The salt is
    of no grouping column, or what Spark infers about it would set the uses' shuffles apart."""
    by_name = Window.partitionBy("table_id", "name").orderBy("pos")
    ranked = dashboards.withColumn("nth", F.row_number().over(by_name)).filter(F.col("nth") <= 2)
    return with_salt(ranked, ["pos"])


def _per_table(ranked: DataFrame) -> DataFrame:
    """(table_id, cutoff, salts): one row per table that lists a dashboard.

    Whole rows are aggregated, so that this use of ``ranked`` reads the shuffle of the other one.
    """
    second = F.when(F.col("nth") % 2 == 0, F.struct("pos", "name", "path"))
    return key_rows(ranked, ["table_id"], F.min(second)["pos"].alias("cutoff"))


def _kept(ranked: DataFrame, tables: DataFrame) -> DataFrame:
    """Dashboards before the first repeated name of their table, for (table_id, cutoff, salts).

    The kept ones are the first of their name. A hot table's rows are joined by salt.
    """
    first = ranked.filter(F.col("nth") % 2 == 1).drop("nth")
    kept = join_back(first, tables, ["table_id"])
    return kept.filter(F.col("cutoff").isNull() | (F.col("pos") < F.col("cutoff"))).drop("cutoff")


def dashboards_by_table(dashboards: DataFrame, mode: str = "parity") -> DataFrame:
    """(table_id, name, path): the dashboards a table ends up with.

    parity: names in order up to the first repeat, later ones are lost.
    intended: each name once, with its first path.
    A null ``table_id`` is no table; a null name is a name of its own.
    """
    check_mode(mode)
    if mode == "intended":
        return dashboards.groupBy("table_id", "name").agg(F.min_by("path", "pos").alias("path"))
    ranked = _ranked(dashboards.select("table_id", "pos", "name", "path"))
    return _kept(ranked, _per_table(ranked)).select("table_id", "name", "path")


def bi_entries(
    tables: DataFrame, dashboards: DataFrame, server_url: str, mode: str = "parity"
) -> DataFrame:
    """(pk, label, url): the BI attribute of the index, one row per dashboard.

    parity: the last table (highest ordinal) of a full name that has a dashboard wins.
    intended: all tables of a full name, without work-table suffixes as in code, count,
    each name with its first address.
    A dashboard without a name is listed under an empty label: a null one would say that the
    table lists nothing.
    """
    check_mode(mode)
    clean = bi_clean(tables).select("table_id", "ordinal", F.col("fullName").alias("pk"))
    listed = dashboards.select("table_id", "pos", F.coalesce("name", F.lit("")).alias("name"), "path")
    url = names.dashboard_url(server_url, F.col("path")).alias("url")
    label = F.col("name").alias("label")

    if mode == "intended":
        salted = with_salt(listed, ["pos"])
        # Only tables that list a dashboard are key rows here; both sides are unique per table.
        named = key_rows(salted, ["table_id"]).join(clean, "table_id")
        named = named.withColumn("pk", names.normalise_table(F.col("pk"), mode))
        of_table = join_back(salted, named, ["table_id"])
        first = F.min_by("path", F.struct("ordinal", "pos")).alias("path")
        return of_table.groupBy("pk", "name").agg(first).select("pk", label, url)

    # One scan and one shuffle of the listing serve both the choice of tables and their lists.
    ranked = _ranked(listed)
    row = F.struct("ordinal", "table_id", "cutoff", SALTS)
    winners = _per_table(ranked).join(clean, "table_id").groupBy("pk").agg(F.max(row).alias("w"))
    won = winners.select("pk", "w.table_id", "w.cutoff", f"w.{SALTS}")
    return _kept(ranked, won).select("pk", label, url)
