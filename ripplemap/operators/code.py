"""Tables named by SQL files and by the SQL steps of pipeline definitions.

One narrow stage does all text work per file; only (file key, url, table names)
crosses a shuffle, never file content.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import names, sqltext, text
from ripplemap.functions.yaml_udf import load_steps
from ripplemap.operators.files import (
    SQL_STEP_TYPE, STEP_MARK, STEPS_MARK, classify_files, gate_yml, last_per_key,
)
from ripplemap.schemas import check_mode

_FILE = ("kind", "file_key", "ordinal", "path", "url")
NO_STEPS_ERROR = "NoStepsSection"
BAD_STEP_ERROR = "UnusableStep"


def split_statements(files: DataFrame) -> DataFrame:
    """(ordinal, path, pos, statement) of each file's script."""
    return files.select(
        "ordinal", "path", F.posexplode(sqltext.statements(F.col("content")))
    ).select("ordinal", "path", F.col("pos").cast("long").alias("pos"),
             F.col("col").alias("statement"))


def insert_statements(stmts: DataFrame) -> DataFrame:
    return stmts.filter(sqltext.is_insert(F.col("statement")))


def table_refs(stmts: DataFrame) -> DataFrame:
    """Adds ``tables``: what each statement names, in order, distinct."""
    return stmts.withColumn("tables", sqltext.named_tables(F.col("statement")))


def yml_documents(
    classified: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """Gated pipeline definitions with ``steps`` and the ``error`` that quarantines them."""
    gated = gate_yml(classified, step_type)
    return _load(
        gated.withColumn("yml", _yml_text(variables, check_mode(mode))).drop("content"), step_type
    )


def _yml_text(variables: Mapping[str, str], mode: str) -> Column:
    return text.substitute(text.lint_yml(F.col("content"), mode), variables, mode)


def _load(rows: DataFrame, step_type: str) -> DataFrame:
    """``yml`` and ``has_steps`` replaced by ``steps`` and ``error``; null ``yml`` gives nulls."""
    loaded = rows.withColumn("doc", load_steps(F.col("yml"))).drop("yml")
    wanted = F.filter(
        F.col("doc.steps"),
        lambda s: (s["step_type"] == step_type)
        & (s["command"].isNull() | (s["command"] != "")),
    )
    # A wanted step without a text name or with a command that is no text.
    unusable = F.exists("steps", lambda s: s["name"].isNull() | s["command"].isNull())
    return (
        loaded.withColumn("steps", wanted)
        .withColumn(
            "error",
            F.when(~F.col("has_steps"), NO_STEPS_ERROR)
            .when(F.col("doc.error").isNotNull(), F.col("doc.error"))
            .when(unusable, BAD_STEP_ERROR),
        )
        .drop("doc", "has_steps")
    )


def _named_steps(documents: DataFrame) -> DataFrame:
    """Documents with ``steps`` named, sorted by name, the last of a name kept.

    A quarantined document has null steps. It is not filtered out here: a filter on what
    the loader returns may be pushed to where it loads the text a second time.
    """
    ordered = documents.withColumn(
        "steps",
        F.when(F.col("error").isNull(), F.array_sort(F.transform("steps", lambda s: F.struct(
            names.step_key(s["name"]).alias("name"), s["pos"].alias("pos"),
            s["command"].alias("command"))))),
    )
    return ordered.withColumn(
        "steps",
        F.filter("steps", lambda s, i: ~F.get(F.col("steps"), i + 1)["name"].eqNullSafe(s["name"])),
    )


def yml_steps(
    classified: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """(ordinal, path, name, pos, command): the SQL steps that count."""
    steps = _named_steps(yml_documents(classified, variables, mode, step_type))
    return steps.select("ordinal", "path", F.explode("steps").alias("s")).select(
        "ordinal", "path", "s.name", F.col("s.pos").cast("long").alias("pos"), "s.command"
    )


def file_tables(
    classified: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    yml_variables: Mapping[str, str] | None = None, step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """(kind, file_key, url, tables): one row per file that is the last of its key.

    parity: a script's last INSERT counts. intended: all of its INSERTs.

    The corpus is read once. SQL files are done before the YAML loader, which sees of
    them a null each; no content goes through it but that of gated definitions.
    """
    every = check_mode(mode) == "intended"
    sql, has_steps = F.col("kind") == "sql", F.col("content").contains(STEPS_MARK)
    script = text.substitute(F.col("content"), variables, mode)
    yml_text = _yml_text(variables if yml_variables is None else yml_variables, mode)
    rows = classified.filter(sql | F.col("content").contains(STEP_MARK.format(step_type))).select(
        *_FILE,
        F.when(sql, names.qualified_tables(sqltext.script_tables(script, every), mode))
        .alias("sql_tables"),
        F.when(~sql, yml_text).alias("yml"),
        (sql | has_steps).alias("has_steps"),
    )
    # Naming ``sql_tables`` twice keeps its project, which drops the content, below the loader.
    rows = rows.withColumn("yml", F.when(F.col("sql_tables").isNull(), F.col("yml")))
    of_steps = F.flatten(
        F.transform("steps", lambda s: sqltext.script_tables(s["command"], every))
    )
    tables = F.when(F.col("sql_tables").isNotNull(), F.col("sql_tables")).otherwise(
        names.qualified_tables(of_steps, mode)
    )
    parsed = _named_steps(_load(rows, step_type)).select(*_FILE, tables.alias("tables"))
    return last_per_key(parsed, "url", "tables", counts=F.col("tables").isNotNull())


def yml_quarantine(
    classified: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """(ordinal, path, reason) of pipeline definitions that cannot be read."""
    return (
        yml_documents(classified, variables, mode, step_type)
        .filter(F.col("error").isNotNull())
        .select("ordinal", "path", F.col("error").alias("reason"))
    )


def tables_per_file(file_tables: DataFrame) -> DataFrame:
    """(kind, file_key, url, pos, table): each table once per file, first appearance first."""
    return file_tables.select("kind", "file_key", "url", F.posexplode("tables")).select(
        "kind", "file_key", "url", F.col("pos").cast("long").alias("pos"),
        F.col("col").alias("table"),
    )


def table_to_files(file_tables: DataFrame) -> DataFrame:
    """The inverted form as rows (table, file, url).

    A file key is unique among the rows that come in and its tables are distinct, so
    the pairs are unique without another shuffle. A table that a third of all files
    use stays many rows; it is never gathered into one map.
    """
    return tables_per_file(file_tables).select("table", F.col("file_key").alias("file"), "url")


def ingest_stats(
    files: DataFrame, variables: Mapping[str, str], mode: str = "parity"
) -> DataFrame:
    """(kind, outcome, files): found per kind, parsed and failed pipeline definitions."""
    classified = classify_files(files, mode)
    gated = (F.col("kind") == "yml") & F.col("content").contains(STEP_MARK.format(SQL_STEP_TYPE))
    rows = classified.select(
        "kind", F.when(gated, _yml_text(variables, check_mode(mode))).alias("yml"), gated.alias("gated"),
        F.col("content").contains(STEPS_MARK).alias("has_steps"),
    )
    outcome = F.when(F.col("error").isNull(), "parsed").otherwise("failed")
    outcomes = F.when(F.col("gated"), F.array(F.lit("found"), outcome)).otherwise(F.array(F.lit("found")))
    return _load(rows, SQL_STEP_TYPE).select("kind", F.explode(outcomes).alias("outcome")).groupBy(
        "kind", "outcome").agg(F.count("*").alias("files"))
