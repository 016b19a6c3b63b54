"""Tickets: the tables they mention, the lookup of those, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.functions.names import normalise_table
from ripplemap.operators.index import index_keys
from ripplemap.operators.skew import SALT, SALTS, default_salts, join_back, key_rows, salt_of, with_salt
from ripplemap.schemas import BI_SOURCE, CODE_SOURCE, SOURCES, check_mode

# The pattern of a table or field name in a lower-cased summary, the
# two states of a reference and the text shown for an unreferenced one.
REFERENCE_PATTERN = r"[0-9]*[a-z]+[0-9]*[\.\_a-z]+[0-9]*(\.|\_)[0-9]*[a-z]+[0-9]*"
USED, UNUSED = "error", "confirmation"
UNUSED_NOTE = "No Tableau or GitHub references found"
NO_REFERENCE = "none"
MISSING_PARAMETER = "Missing query string 'field'"
FAILED_REQUEST = "Failed to process request"
REPLACEMENT = "\ufffd"

#: Tickets of one field that a report joins in one task with a share of its entries.
TICKET_SHARE = 10_000


# Stretches of name characters with a separator in them, found in one pass. A name lies
# within one; the pattern itself, which backtracks a lot on plain words, sees no others.
_STRETCH = r"(?<![0-9a-z._])[0-9a-z]*+[._][0-9a-z._]*+"


def references_in(text: Column) -> Column:
    """All names in a text, left to right, repeats kept."""
    stretches = F.regexp_extract_all(F.lower(text), F.lit(_STRETCH), F.lit(0))
    return F.flatten(F.transform(
        stretches, lambda s: F.regexp_extract_all(s, F.lit(REFERENCE_PATTERN), F.lit(0))
    ))


def issue_refs(issues: DataFrame, mode: str = "parity") -> DataFrame:
    """(issue_key, pos, field) for each name in a summary.

    parity: names as they stand. intended: without work-table suffixes, like index keys.
    """
    field = F.col("col")
    if check_mode(mode) == "intended":
        field = normalise_table(field, mode)
    return issues.select("issue_key", F.posexplode(references_in(F.col("summary")))).select(
        "issue_key", F.col("pos").cast("long").alias("pos"), field.alias("field")
    )


def _status(used: Column) -> Column:
    return F.when(used, USED).otherwise(UNUSED)


def lookup(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Each reference, in order, with a summary of its key's record; ``pk`` is null without one.

    (issue_key, pos, field, pk, status, n_dashboards, n_files). Only index rows of mentioned
    fields are grouped, by key before any shuffle, so a key with very many entries sends one
    row per task; a field is looked up once, however many tickets mention it.
    """
    salted = with_salt(refs, ["issue_key", "pos"])
    fields = key_rows(salted, ["field"])
    mentioned = index.join(refs.select(F.col("field").alias("pk")).distinct(), "pk", "left_semi")
    keys = index_keys(mentioned)
    found = fields.join(keys, fields["field"] == keys["pk"], "left")
    used = F.coalesce(F.col("has_dashboards") | F.col("has_files"), F.lit(False))
    return join_back(salted, found.withColumn("status", _status(used)), ["field"]).select(
        "issue_key", "pos", "field", "pk", "status",
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_dashboards", "n_files")])


def unreferenced(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References no index key matches."""
    salted = with_salt(refs, ["issue_key", "pos"])
    unknown = key_rows(salted, ["field"]).join(
        index.select(F.col("pk").alias("field")).distinct(), "field", "left_anti"
    )
    return join_back(salted, unknown, ["field"]).select("issue_key", "pos", "field")


def issue_status(issues: DataFrame, index: DataFrame, mode: str = "parity") -> DataFrame:
    """(issue_key, refs, used, status): status is ``none`` without a reference."""
    per_issue = lookup(issue_refs(issues, mode), index).groupBy("issue_key").agg(
        F.count("*").alias("refs"),
        F.count(F.when(F.col("status") == USED, 1)).alias("used"),
        F.max("status").alias("status"),
    )
    silent = issues.filter(
        F.coalesce(F.size(references_in(F.col("summary"))), F.lit(0)) <= 0
    ).select(
        "issue_key", F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("used"),
        F.lit(NO_REFERENCE).alias("status"),
    )
    return per_issue.unionByName(silent)


def _sections(index: DataFrame) -> DataFrame:
    """Index rows as report sections; dashboards come before files."""
    section = F.when(F.col("source") == BI_SOURCE, SOURCES[BI_SOURCE]).otherwise(
        SOURCES[CODE_SOURCE]
    )
    return index.filter(F.col("label").isNotNull()).select(
        F.col("pk").alias("field"), section.alias("section"), "label", "url"
    )


def mentioned_entries(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(field, section, label, url) of each mentioned field, once.

    With ``lookup`` this holds the whole report in two tables whose size is that of
    the tickets plus that of the index, not their product: the form for bulk runs.
    """
    entries = with_salt(_sections(index), ["label"])
    wanted = key_rows(entries, ["field"]).join(
        refs.select("field").distinct(), "field", "left_semi"
    )
    return join_back(entries, wanted, ["field"])


def impact_report(issues: DataFrame, index: DataFrame, mode: str = "parity") -> DataFrame:
    """What each ticket's panel lists: a row per entry, or one row for a bare reference.

    (issue_key, pos, field, status, section, label, url, note). The panel's listing is
    asked for per ticket, so a reference's row is repeated for each entry of its key; for
    all tickets at once, ``lookup`` and ``mentioned_entries`` hold the same in less. A key's
    entries are spread by salt, its tickets by share: one share for each ``TICKET_SHARE`` of
    them, so a key of many tickets with one entry is split too. References without entries
    take no part in the join.
    """
    refs = with_salt(issue_refs(issues, mode), ["issue_key", "pos"])
    salts = default_salts(refs)
    tickets = key_rows(refs, ["field"], F.count("*").alias("n_refs"))
    entry_salt = F.when(F.col("label").isNotNull(), F.col(SALT))
    keys = index_keys(with_salt(index, ["label"]), F.collect_set(entry_salt).alias("entry_salts"))
    shares = F.least(F.ceil(F.col("n_refs") / TICKET_SHARE).cast("int"), F.lit(salts))
    used = F.coalesce(F.col("has_dashboards") | F.col("has_files"), F.lit(False))
    fields = tickets.join(keys, tickets["field"] == keys["pk"], "left").select(
        "field", SALTS, _status(used).alias("status"), "entry_salts", shares.alias("shares"))
    found = join_back(refs, fields, ["field"]).withColumn(
        "share", F.pmod(F.xxhash64(F.lit(1), "issue_key", "pos"), "shares").cast("int"))
    listed = F.coalesce(F.size("entry_salts"), F.lit(0)) > 0

    entries = with_salt(_sections(index), ["label"])
    spread_over = key_rows(entries, ["field"]).join(fields.filter(listed).select("field", "shares"), "field")
    entries = join_back(entries, spread_over, ["field"]).withColumn(SALT, salt_of("label", salts=salts)).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    full = found.filter(listed).withColumn(SALT, F.explode("entry_salts")).join(entries, ["field", SALT, "share"])
    nothing = F.lit(None).cast("string")
    bare = found.filter(~listed).select("*", *(nothing.alias(n) for n in ("section", "label", "url")))
    columns = ("issue_key", "pos", "field", "status", "section", "label", "url")
    return full.select(*columns).union(bare.select(*columns)).withColumn(
        "note", F.when(F.col("status") == UNUSED, UNUSED_NOTE))


def order_report(report: DataFrame) -> DataFrame:
    """Panel order: references as mentioned, dashboards first, then files."""
    return report.orderBy("issue_key", "pos", "section", "label")


# The lookup's request parameter ------------------------------------------------------


def _decoded(param: Column) -> Column:
    # A plus sign stands for itself here, unlike in form encoding.
    return F.try_url_decode(F.replace(param, F.lit("+"), F.lit("%2B")))


def lookup_params(requests: DataFrame) -> DataFrame:
    """(request_id, pos, field) of well-formed requests: decoded, split at commas."""
    fields = F.split(_decoded(F.col("param")), ",")
    good = requests.filter(_rejection(F.col("param")).isNull())
    return good.select("request_id", F.posexplode(fields)).select(
        "request_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("field")
    )


def _rejection(param: Column) -> Column:
    """400 without a parameter, 500 for one that cannot be decoded or asks for an empty key."""
    fields = F.split(_decoded(param), ",")
    # Bytes that are no UTF-8 decode to a replacement character that nobody spelt.
    spelt = F.upper(param).contains("%EF%BF%BD") | param.contains(REPLACEMENT)
    invalid = _decoded(param).contains(REPLACEMENT) & ~spelt
    # A store takes no empty key, so a request with one fails as a whole.
    broken = _decoded(param).isNull() | invalid | F.array_contains(fields, "")
    return F.when(param.isNull() | (param == ""), 400).when(broken, 500)


def rejected_params(requests: DataFrame) -> DataFrame:
    """(request_id, status_code, message) of requests that cannot be answered."""
    code = _rejection(F.col("param")).cast("long")
    return requests.withColumn("status_code", code).filter(F.col("status_code").isNotNull()).select(
        "request_id", "status_code",
        F.when(F.col("status_code") == 400, MISSING_PARAMETER).otherwise(FAILED_REQUEST)
        .alias("message"),
    )


def answer_requests(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(request_id, pos, field, pk, status, n_dashboards, n_files) for bulk requests."""
    refs = lookup_params(requests).withColumnRenamed("request_id", "issue_key")
    return lookup(refs, index).withColumnRenamed("issue_key", "request_id")


def requested_fields(spark: SparkSession, fields: Sequence[str] | str) -> list[str]:
    """Fields of a lookup: a sequence as it is, a text as a request parameter, decoded or refused."""
    if not fields:
        raise ValueError(MISSING_PARAMETER)
    if not isinstance(fields, str):
        return list(fields)
    given = spark.createDataFrame([(fields,)], "param string")
    code, wanted = given.select(_rejection(F.col("param")), F.split(_decoded(F.col("param")), ",")).first()
    if code is not None:
        raise ValueError(MISSING_PARAMETER if code == 400 else FAILED_REQUEST)
    return wanted


def get_references(index: DataFrame, fields: Sequence[str] | str) -> DataFrame:
    """Point lookup of a few fields: (pos, field, source, label, url), nulls when absent.

    A text is a request parameter, decoded and refused by the rules of bulk requests; a
    sequence holds plain fields. They become a filter on ``pk`` that reaches the index files.
    """
    spark = index.sparkSession
    wanted = requested_fields(spark, fields)
    asked = spark.createDataFrame(list(enumerate(wanted)), "pos long, field string")
    hits = index.filter(F.col("pk").isin(*set(wanted)))
    return asked.join(hits, asked["field"] == hits["pk"], "left").drop("pk")
