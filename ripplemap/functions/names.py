"""Names: file kinds, table names, dashboard addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FILE_KINDS = ("sql", "yml")
WORK_TABLE_SUFFIXES = ("_tmp", "_temp", "_staging")
DASHBOARD_ROUTE = "/#/views/"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_kind(name: Column, mode: str = "parity") -> Column:
    """``sql``, ``yml`` or null.

    parity: the last dot piece must be a known kind and the *second* piece names it,
    so ``a.b.sql`` has none and ``a.sql.yml`` is SQL. intended: the last piece.
    """
    last = F.substring_index(name, ".", -1)
    picked = second_piece(name) if mode == "parity" else last
    return F.when(
        name.contains(".") & last.isin(*FILE_KINDS) & picked.isin(*FILE_KINDS), picked
    )


def second_piece(name: Column) -> Column:
    """The piece after the first dot, up to the next dot; of a name with a dot."""
    return F.substring_index(F.substring_index(name, ".", 2), ".", -1)


def has_sql_extension(name: Column) -> Column:
    """Looser predicate: only the second dot piece is tested."""
    return name.contains(".") & second_piece(name).isin(*FILE_KINDS)


def step_key(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def strip_brackets(name: Column) -> Column:
    return F.translate(name, "[]", "")


def normalise_table(table: Column, mode: str = "parity") -> Column:
    """Lower-cased name without work-table suffixes.

    parity: suffixes go anywhere in the name, case-sensitively, in the fixed order.
    intended: only trailing ones, in any case.
    """
    if mode == "intended":
        ending = "(?i)(?:" + "|".join(WORK_TABLE_SUFFIXES) + ")+$"
        return F.lower(F.regexp_replace(table, ending, ""))
    for suffix in WORK_TABLE_SUFFIXES:
        table = F.replace(table, F.lit(suffix), F.lit(""))
    return F.lower(table)


def qualified_tables(tables: Column, mode: str = "parity") -> Column:
    """Distinct normalised names of the schema-qualified tables, first appearance first."""
    dotted = F.filter(tables, lambda t: t.contains("."))
    return F.array_distinct(F.transform(dotted, lambda t: normalise_table(t, mode)))


def dashboard_url(server_url: str, path: Column) -> Column:
    return F.concat(F.lit(server_url + DASHBOARD_ROUTE), path)
