"""Row shapes shared by the operators.

``ordinal`` and ``pos`` are any orderable type: a number, or a struct such as
(depth, path pieces). The operators only compare them, so no job ever has to
number a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The attributes of an index record and what each of them lists.
SOURCES = {"tableau": "dashboards", "github": "files"}
BI_SOURCE, CODE_SOURCE = "tableau", "github"

MODES = ("parity", "intended")

REPO_FILES = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
])

ISSUES = T.StructType([
    T.StructField("issue_key", T.StringType()),
    T.StructField("summary", T.StringType()),
])

# One row per listed file or dashboard. ``label`` is null in the one row that stands
# for an attribute that is there but lists nothing.
ENTRIES = T.StructType([
    T.StructField("pk", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("url", T.StringType()),
])
INDEX = T.StructType([T.StructField("source", T.StringType()), *ENTRIES.fields])


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def check_source(source: str) -> str:
    if source not in SOURCES:
        raise ValueError(f"source must be one of {tuple(SOURCES)}, not {source!r}")
    return source
