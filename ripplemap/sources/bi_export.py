"""BI metadata exports: responses of the eight metadata queries, stored as JSON.

Each response kind has a fixed schema, so nothing is inferred and unused fields are
never parsed. Export large sites page by page (one response per file): a file is the
unit that Spark can hand to a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Where the nodes are in a response, and their fields.
_NAMES = "array<struct<name:string>>"
NODES = {
    "tables_to_dashboards": ("databaseTables", (
        "name:string,fullName:string,schema:string,connectionType:string,"
        f"columns:{_NAMES},downstreamDashboards:array<struct<name:string,path:string>>")),
    "custom_sql": ("customSQLTablesConnection.nodes", (
        "database:struct<name:string,connectionType:string>,"
        "tables:array<struct<name:string,schema:string>>,"
        f"columns:{_NAMES},"
        "downstreamDashboards:array<struct<__typename:string,name:string,path:string>>")),
    "database_tables": ("databaseTables", (
        "luid:string,id:string,name:string,schema:string,fullName:string,"
        "connectionType:string")),
    "databases": ("databases", "luid:string,id:string,name:string,connectionType:string"),
    "workbook_fields": ("workbooks", (
        "__typename:string,name:string,projectName:string,sheets:array<struct<"
        "__typename:string,name:string,sheetFieldInstances:array<struct<"
        "__typename:string,name:string,fullyQualifiedName:string,datasource:struct<"
        "__typename:string,name:string,upstreamDatasources:array<struct<"
        "__typename:string,name:string>>>>>>>")),
    "published_datasources": ("publishedDatasources", (
        "name:string,uri:string,hasExtracts:boolean,"
        f"upstreamTables:array<struct<fullName:string>>,downstreamDashboards:{_NAMES},"
        "fields:array<struct<name:string,fullyQualifiedName:string>>")),
    "embedded_datasources": ("embeddedDatasources",
                             f"name:string,downstreamDashboards:{_NAMES}"),
    "workbooks": ("workbooks", (
        "id:string,luid:string,name:string,uri:string,"
        "upstreamDatasources:array<struct<id:string,luid:string,name:string>>,"
        "upstreamDatabases:array<struct<id:string,luid:string,name:string,"
        "connectionType:string>>,"
        "upstreamTables:array<struct<id:string,luid:string,name:string>>")),
}


def response_schema(kind: str) -> StructType:
    where, fields = NODES[kind]
    nested = f"array<struct<{fields}>>"
    for piece in reversed(where.split(".")):
        nested = f"struct<{piece}:{nested}>"
    return StructType.fromDDL(f"data {nested}")


def _nodes(responses: DataFrame, where: str, page) -> DataFrame:
    """One row per node; ``ordinal`` = (page, position in it) keeps the response order."""
    return responses.select(
        page.alias("page"), F.posexplode(f"data.{where}").alias("at", "node")
    ).select(F.struct("page", "at").alias("ordinal"), "node.*")


def _page() -> Column:
    """A file's place: the last number in its name, none first, then its path."""
    number = F.regexp_extract("_metadata.file_name", r"(\d+)\D*$", 1)
    return F.struct(F.coalesce(number.try_cast("long"), F.lit(-1).cast("long")).alias("number"),
                    F.col("_metadata.file_path").alias("file"))


def read_nodes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes of the response files in ``path``, pages by the last number in the file name.

    Files without a number come first, and equal numbers go by path.
    """
    where, _ = NODES[kind]
    responses = (
        spark.read.schema(response_schema(kind)).option("multiLine", True).json(path)
    )
    return _nodes(responses, where, _page())


def read_node_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes stored one to a line, in numbered files that Spark may split anywhere.

    ``ordinal`` = (file by the rule of ``read_nodes``, offset of the line's block in it, line):
    as ordered as the lines are.
    """
    fields = StructType.fromDDL(NODES[kind][1])
    lines = spark.read.text(path).select(
        "value", _page().alias("page"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    node = F.from_json("value", fields).alias("node")
    ordinal = F.struct("page", F.struct("block", "line").alias("at")).alias("ordinal")
    return lines.select(ordinal, node).select("ordinal", "node.*")


def nodes_from_text(df: DataFrame, text: str, page: str, kind: str) -> DataFrame:
    """Nodes of responses that are a text column of a table, pages ordered by ``page``."""
    where, _ = NODES[kind]
    parsed = df.select(F.col(page), F.from_json(text, response_schema(kind)).alias("r"))
    return _nodes(parsed.select(page, "r.data"), where, F.col(page))
