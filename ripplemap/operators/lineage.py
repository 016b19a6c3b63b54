"""BI lineage: what each metadata node lists, as flat rows.

A node's lists are laid end to end and exploded once: one scan, one row per list
item, and no pairing of one list with another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.operators.numbering import numbered

_ITEM = ("kind", "id", "schema", "name", "path")


def _items(array: str, kind: str, **fields: str) -> Column:
    """A list as array<struct(kind, id, schema, name, path)>, empty for a null list."""
    text = lambda x, f: x[fields[f]] if f in fields else F.lit(None).cast("string")
    made = F.transform(
        array,
        lambda x: F.struct(F.lit(kind).alias("kind"),
                           *[text(x, f).alias(f) for f in _ITEM[1:]]),
    )
    return F.coalesce(made, F.array().cast(
        "array<struct<kind:string,id:string,schema:string,name:string,path:string>>"))


def _listed(nodes: DataFrame, head: Sequence, items: Sequence[Column]) -> DataFrame:
    return nodes.select(*head, F.explode_outer(F.concat(*items)).alias("item"))


def _with_database(nodes: DataFrame) -> DataFrame:
    return nodes.select("ordinal", F.col("database.name").alias("database"),
                        F.col("database.connectionType").alias("connection_type"),
                        "tables", "columns", "downstreamDashboards")


def page_numbers(nodes: DataFrame, size: int) -> DataFrame:
    """(ordinal, page_number): pages of ``size`` nodes by database, from 0.

    Nodes are dealt by ranges of (database, ordinal), so one database may hold all of them.
    """
    placed = nodes.select("ordinal", F.struct("database.name", "database.connectionType").alias("database"))
    in_order = numbered(placed, ["database", "ordinal"])
    return in_order.select("ordinal", F.floor(F.col("number") / size).cast("long").alias("page_number"))


def custom_sql_pages(nodes: DataFrame, size: int = 50) -> DataFrame:
    """``custom_sql_lists`` of all nodes with the page each node is on."""
    return custom_sql_lists(nodes).join(page_numbers(nodes, size), "ordinal")


def custom_sql_lists(nodes: DataFrame) -> DataFrame:
    """Tables, columns and dashboards of custom SQL nodes."""
    return _listed(_with_database(nodes), ["ordinal", "database", "connection_type"], [
        _items("tables", "table", schema="schema", name="name"),
        _items("columns", "column", name="name"),
        _items("downstreamDashboards", "dashboard", name="name", path="path"),
    ]).select("ordinal", "database", "connection_type",
              "item.kind", "item.schema", "item.name", "item.path")


def table_catalogue(nodes: DataFrame) -> DataFrame:
    return nodes.select("luid", "id", "name", "schema", F.col("fullName").alias("full_name"),
                        F.col("connectionType").alias("connection_type"))


def database_catalogue(nodes: DataFrame) -> DataFrame:
    return nodes.select("luid", "id", "name", F.col("connectionType").alias("connection_type"))


def workbook_fields(nodes: DataFrame, projects: Sequence[str]) -> DataFrame:
    """workbook → sheet → field → datasource → upstream datasource, for some projects."""
    return (
        nodes.filter(F.col("projectName").isin(*projects))
        .select(F.col("name").alias("workbook"), F.col("projectName").alias("project"),
                F.explode("sheets").alias("sheet"))
        .select("workbook", "project", F.col("sheet.name").alias("sheet"),
                F.explode("sheet.sheetFieldInstances").alias("field"))
        .select("workbook", "project", "sheet", F.col("field.name").alias("field"),
                F.col("field.fullyQualifiedName").alias("qualified_field"),
                F.col("field.datasource.__typename").alias("datasource_type"),
                F.col("field.datasource.name").alias("datasource"),
                F.explode_outer("field.datasource.upstreamDatasources").alias("up"))
        .select("workbook", "project", "sheet", "field", "qualified_field",
                "datasource_type", "datasource", F.col("up.name").alias("upstream_datasource"))
    )


def published_datasources(nodes: DataFrame) -> DataFrame:
    """Upstream tables, dashboards and fields of published datasources."""
    head = ["ordinal", F.col("name").alias("datasource"), "uri",
            F.col("hasExtracts").alias("has_extracts")]
    return _listed(nodes, head, [
        _items("upstreamTables", "table", name="fullName"),
        _items("downstreamDashboards", "dashboard", name="name"),
        _items("fields", "field", id="fullyQualifiedName", name="name"),
    ]).select("ordinal", "datasource", "uri", "has_extracts", "item.kind", "item.name",
              F.col("item.id").alias("qualified_name"))


def embedded_datasources(nodes: DataFrame) -> DataFrame:
    """(datasource, dashboard); a datasource without one keeps a row."""
    return nodes.select(
        F.col("name").alias("datasource"), F.explode_outer("downstreamDashboards").alias("d")
    ).select("datasource", F.col("d.name").alias("dashboard"))


def workbook_lineage(nodes: DataFrame) -> DataFrame:
    """(workbook_id, workbook, kind, upstream_id, upstream_name)."""
    head = [F.col("id").alias("workbook_id"), F.col("name").alias("workbook"), "uri"]
    return _listed(nodes, head, [
        _items("upstreamDatasources", "datasource", id="id", name="name"),
        _items("upstreamDatabases", "database", id="id", name="name"),
        _items("upstreamTables", "table", id="id", name="name"),
    ]).select("workbook_id", "workbook", "uri", "item.kind",
              F.col("item.id").alias("upstream_id"), F.col("item.name").alias("upstream_name"))
