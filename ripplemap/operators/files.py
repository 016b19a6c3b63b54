"""Repository files: kinds, last-wins rules, variable files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import names, text
from ripplemap.functions.yaml_udf import VARIABLE_DEPTH, load_variables
from ripplemap.schemas import check_mode
from ripplemap.sources.scratch import cut

# Where the variable file is by default, the map used when there is
# none, the step type whose command is SQL, and the texts that show such steps.
VARIABLE_FILE = "pipelines/example_template_config.yml"
NO_VARIABLES = {"env_vars": "none"}
SQL_STEP_TYPE = "sql-command"
STEP_MARK = "- step_type: {}\n"
STEPS_MARK = "steps:\n"


def classify_files(files: DataFrame, mode: str = "parity") -> DataFrame:
    """Files of a known kind, with ``kind`` and the ``file_key`` that names them later.

    SQL files are known by base name (intended mode: by path), pipeline definitions by path.
    """
    check_mode(mode)
    kind = names.file_kind(F.col("name"), mode)
    by_name = (F.col("kind") == "sql") & F.lit(mode == "parity")
    return (
        files.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("file_key", F.when(by_name, F.col("name")).otherwise(F.col("path")))
    )


def last_per_key(files: DataFrame, *columns: str, counts: Column | None = None) -> DataFrame:
    """The last file (highest ordinal, then path) of each (kind, file_key).

    Call it with narrow columns: the winners are found by partial aggregation before
    the shuffle, so a base name that many folders share costs one row per task. A file
    that does not count (``counts`` is false) never wins; a key without any has nulls.
    """
    place = F.struct("ordinal", "path")
    if counts is not None:
        place = F.when(counts, place)
    latest = F.max_by(F.struct(*columns), place).alias("kept")
    return files.groupBy("kind", "file_key").agg(latest).select("kind", "file_key", "kept.*")


def latest_scripts(files: DataFrame, mode: str = "parity") -> DataFrame:
    """Files without the scripts that a later one of their key replaces, so that these are never parsed.

    A step before ``code_index``, which gives the same rows from it, for a corpus in which base
    names repeat; it shuffles the files' text once. The last ones are found from narrow rows and
    joined by name and place, so a name that very many folders share is no hot key. Other files
    pass: a definition that cannot be read never wins. intended: keys are paths, all files pass.
    """
    if check_mode(mode) == "intended":
        return files
    place = F.struct(F.col("content").isNotNull().alias("counts"), "ordinal", "path")
    last = files.groupBy(F.col("name").alias("__name")).agg(F.max(place).alias("__last"))
    same = ((F.col("name") == F.col("__name")) & F.col("ordinal").eqNullSafe(F.col("__last.ordinal"))
            & F.col("path").eqNullSafe(F.col("__last.path")))
    replaced = (names.file_kind(F.col("name")) == "sql") & F.col("__name").isNull()
    # Asked behind the join: before it, a filter would be worked out on texts that are still being made.
    return files.join(last, same, "left").filter(~F.coalesce(replaced, F.lit(False))).select(*files.columns)


def file_urls(classified: DataFrame) -> DataFrame:
    """(kind, file_key, url) with the last file's address."""
    return last_per_key(classified, "url")


def gate_yml(classified: DataFrame, step_type: str = SQL_STEP_TYPE) -> DataFrame:
    """Pipeline definitions that show a SQL step; ``has_steps`` tells malformed ones apart."""
    return classified.filter(
        (F.col("kind") == "yml") & F.col("content").contains(STEP_MARK.format(step_type))
    ).withColumn("has_steps", F.col("content").contains(STEPS_MARK))


def substitute_vars(
    files: DataFrame, variables: Mapping[str, str], mode: str = "parity"
) -> DataFrame:
    """Template variables in ``content`` replaced line by line."""
    check_mode(mode)
    return files.withColumn("content", text.substitute(F.col("content"), variables, mode))


def flatten_variables(files: DataFrame, mode: str = "parity") -> DataFrame:
    """Variables of many variable files: (ordinal, path, key, value, error).

    A file that cannot be read is one row with an error.
    """
    loaded = files.select(
        "ordinal", "path", load_variables(text.lint_yml(F.col("content"), mode)).alias("doc"))
    return _flattened(cut(loaded.select("ordinal", "path", "doc.*"), "variable-files"))


def env_vars(files: DataFrame, path: str = VARIABLE_FILE, mode: str = "parity") -> DataFrame:
    """(key, value, error) of the first file with this path; the default map without one."""
    first = (
        files.filter(F.col("path") == path)
        .agg(F.min_by("content", "ordinal").alias("content"), F.count("*").alias("found"))
    )
    document = load_variables(F.when(F.col("found") > 0, F.coalesce(text.lint_yml(F.col("content"), mode), F.lit(""))))
    loaded = cut(first.select(
        F.lit(0).alias("ordinal"), F.lit(path).alias("path"), "found", document.alias("doc")).select(
        "ordinal", "path", "found", "doc.*"), "variable-file")
    default = F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in NO_VARIABLES.items()])
    none = loaded.filter("found = 0").select(F.inline(default), "error")
    return _flattened(loaded.drop("found")).select("key", "value", "error").unionByName(none)


_ID = ("ordinal", "path")


def _pairs(rows: DataFrame) -> DataFrame:
    """``pairs`` (JSON) as rows: the other columns, ``at``, ``key``, ``value`` and ``inner`` pairs."""
    listed = rows.withColumn("pairs", F.parse_json("pairs"))
    found = rows.sparkSession.sql(
        "SELECT listed.* EXCEPT (pairs), pair.pos AS at, pair.value AS pair"
        " FROM {listed} listed, LATERAL variant_explode(listed.pairs) pair", listed=listed)
    return found.select(
        *[c for c in found.columns if c != "pair"], F.variant_get("pair", "$[0]", "string").alias("key"),
        F.variant_get("pair", "$[1]", "string").alias("value"),
        F.nullif(F.to_json(F.variant_get("pair", "$[2]", "variant")), F.lit("null")).alias("inner"))


def _last_of_name(rows: DataFrame) -> DataFrame:
    """Of one name in one file the last value, at the place of the first."""
    return rows.groupBy(*_ID, "name").agg(
        F.max_by(F.struct("value", "inner"), "place").alias("last"), F.min("place").alias("place")
    ).select(*_ID, "name", "place", "last.*")


def _flattened(loaded: DataFrame) -> DataFrame:
    """Nested keys joined with dots, a depth at a time, down to ``VARIABLE_DEPTH``.

    A later section replaces what an earlier one has under a key. Within a depth the last of
    a name counts; a name that is settled hides a deeper one. ``loaded`` is a written table
    (ordinal, path, document, error); keys are rows, so one file may have very many.
    """
    sections = loaded.filter("document IS NOT NULL").select(*_ID, F.posexplode(
        F.from_json("document", "array<string>")).alias("section", "pairs"))
    rows = _pairs(sections).select(
        *_ID, F.col("key").alias("name"), F.array("section", "at").alias("place"), "value", "inner")
    settled: list[DataFrame] = []
    for depth in range(1, VARIABLE_DEPTH + 1):
        level = _last_of_name(rows)
        for known in settled:
            level = level.join(known, [*_ID, "name"], "left_anti")
        done = level.filter("inner IS NULL").select(*_ID, "name", "value")
        settled.append(done)
        if depth < VARIABLE_DEPTH:
            deeper = _pairs(level.filter("inner IS NOT NULL").select(*_ID, "name", "place", F.col("inner").alias("pairs")))
            rows = deeper.select(
                *_ID, F.concat_ws(".", "name", "key").alias("name"),
                F.concat("place", F.array("at")).alias("place"), "value", "inner")
    broken = loaded.filter("error IS NOT NULL").select(
        *_ID, *(F.lit(None).cast("string").alias(c) for c in ("name", "value")), "error")
    found = reduce(DataFrame.unionByName, settled).withColumn("error", F.lit(None).cast("string"))
    return found.unionByName(broken).withColumnRenamed("name", "key")


def collect_vars(variables: DataFrame) -> dict[str, str]:
    """The variable map as a constant of later plans: the content of one file only."""
    rows = variables.collect()
    broken = [r["error"] for r in rows if r["error"]]
    if broken:
        raise ValueError(f"the variable file cannot be read: {broken[0]}")
    return {r["key"]: r["value"] for r in rows}
