"""The ingest jobs: code index, BI index, reference index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.names import base_name, file_kind
from ripplemap.operators import bi, code
from ripplemap.operators.files import (
    NO_VARIABLES, SQL_STEP_TYPE, VARIABLE_FILE, classify_files, collect_vars, env_vars,
)
from ripplemap.operators.index import reference_index
from ripplemap.schemas import check_mode


def file_tables(
    files: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    yml_variables: Mapping[str, str] | None = None, step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """(kind, file_key, url, tables) of all SQL files and pipeline definitions."""
    return code.file_tables(
        classify_files(files, mode), variables, mode, yml_variables, step_type
    )


def code_index(
    files: DataFrame, variables: Mapping[str, str], mode: str = "parity",
    yml_variables: Mapping[str, str] | None = None, step_type: str = SQL_STEP_TYPE,
) -> DataFrame:
    """(pk, label, url): the code attribute. One shuffle, of keys and table names only.

    A SQL key and a pipeline key never meet (they differ in kind), so the union of
    both is already the merged map of each table.
    """
    inverted = code.table_to_files(file_tables(files, variables, mode, yml_variables, step_type))
    return inverted.select(F.col("table").alias("pk"), F.col("file").alias("label"), "url")


def code_index_of_repo(
    files: DataFrame, variable_file: str = VARIABLE_FILE, mode: str = "parity"
) -> DataFrame:
    """Code index with the variables of the repository's own variable file.

    SQL files look for it among all files, pipeline definitions among their own kind. It is
    read once; its name tells whether it is a definition.
    """
    variables = collect_vars(env_vars(files, variable_file, mode))
    kind = file_kind(base_name(F.lit(variable_file)), check_mode(mode))
    is_definition = files.sparkSession.range(1).filter(kind == "yml").count() > 0
    return code_index(files, variables, mode, variables if is_definition else NO_VARIABLES)


def bi_index(
    tables: DataFrame, dashboards: DataFrame, server_url: str, mode: str = "parity"
) -> DataFrame:
    """(pk, label, url): the BI attribute."""
    return bi.bi_entries(tables, dashboards, server_url, mode)


def bi_index_of_nodes(nodes: DataFrame, server_url: str, mode: str = "parity") -> DataFrame:
    """BI attribute of exported table nodes."""
    return bi_index(*bi.flatten_nodes(nodes), server_url, mode)


__all__ = [
    "bi_index", "bi_index_of_nodes", "code_index", "code_index_of_repo", "file_tables",
    "reference_index",
]
