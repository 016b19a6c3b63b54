"""Tickets: references, lookup, report, requests, stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ripplemap.operators import issues
from ripplemap.schemas import INDEX, ISSUES
from ripplemap.sources import tickets
from ripplemap.streaming.impact import hot_fields, stream_report, write_report
from tests.conftest import rows

NOTE = issues.UNUSED_NOTE
ENTRIES = [("github", "ods.orders", "a.sql", "u1"), ("github", "ods.orders", "b.sql", None),
           ("tableau", "ods.orders", "Dash", "v1"), ("tableau", "empty.bi", None, None),
           ("github", "raw.pay", "c.sql", "u3")]


@pytest.mark.parametrize("summary, fields", [
    ("a.b", []), ("ab.c", ["ab.c"]), ("db1.sch2.tbl3", ["db1.sch2.tbl3"]),
    ("x ODS.Orders_TMP2, foo_bar; foo_bar", ["ods.orders_tmp2", "foo_bar", "foo_bar"]),
    ("1a2b_3c4.d5", ["1a2b_3c4"]), ("", []), (None, []), ("Refresh dashboard", []),
    ("fields in ods.customers", ["ods.customers"]),
])
def test_references_of_a_summary(spark, summary, fields):
    df = spark.createDataFrame([("K-1", summary)], ISSUES)
    got = [r["field"] for r in issues.issue_refs(df).orderBy("pos").collect()]
    assert got == fields
    if summary:
        pattern = re.compile(issues.REFERENCE_PATTERN)
        assert [m.group(0) for m in pattern.finditer(summary.lower())] == fields


def ticket_data(spark):
    return spark.createDataFrame([
        ("K-1", "Drop ods.orders and raw.pay and raw.pay"), ("K-2", "Nothing here"),
        ("K-3", "See empty.bi or un.known"), ("K-4", None), ("K-5", "only un.known")], ISSUES)


REPORT = sorted([
    ("K-1", 0, "ods.orders", "error", "dashboards", "Dash", "v1", None),
    ("K-1", 0, "ods.orders", "error", "files", "a.sql", "u1", None),
    ("K-1", 0, "ods.orders", "error", "files", "b.sql", None, None),
    ("K-1", 1, "raw.pay", "error", "files", "c.sql", "u3", None),
    ("K-1", 2, "raw.pay", "error", "files", "c.sql", "u3", None),
    ("K-3", 0, "empty.bi", "error", None, None, None, None),
    ("K-3", 1, "un.known", "confirmation", None, None, None, NOTE),
    ("K-5", 0, "un.known", "confirmation", None, None, None, NOTE)], key=repr)


def test_report_states(spark):
    index = spark.createDataFrame(ENTRIES, INDEX)
    report = issues.impact_report(ticket_data(spark), index)
    assert rows(report) == REPORT
    assert [r["section"] for r in issues.order_report(report).collect()][:3] == [
        "dashboards", "files", "files"]


def test_lookup_status_and_unreferenced(spark):
    index, data = spark.createDataFrame(ENTRIES, INDEX), ticket_data(spark)
    refs = issues.issue_refs(data)
    assert rows(issues.lookup(refs, index), "issue_key", "pos", "pk", "status", "n_dashboards", "n_files") == sorted([
        ("K-1", 0, "ods.orders", "error", 1, 2), ("K-1", 1, "raw.pay", "error", 0, 1),
        ("K-1", 2, "raw.pay", "error", 0, 1), ("K-3", 0, "empty.bi", "error", 0, 0),
        ("K-3", 1, None, "confirmation", 0, 0), ("K-5", 0, None, "confirmation", 0, 0)], key=repr)
    assert rows(issues.issue_status(data, index)) == [
        ("K-1", 3, 3, "error"), ("K-2", 0, 0, "none"), ("K-3", 2, 1, "error"),
        ("K-4", 0, 0, "none"), ("K-5", 1, 0, "confirmation")]
    assert rows(issues.unreferenced(refs, index)) == [("K-3", 1, "un.known"), ("K-5", 0, "un.known")]
    assert rows(issues.mentioned_entries(refs, index)) == sorted([
        ("ods.orders", "dashboards", "Dash", "v1"), ("ods.orders", "files", "a.sql", "u1"),
        ("ods.orders", "files", "b.sql", None), ("raw.pay", "files", "c.sql", "u3")], key=repr)


@pytest.mark.parametrize("share", [5, issues.TICKET_SHARE])
def test_hot_key_on_both_sides_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(issues, "TICKET_SHARE", share)
    rng = random.Random(5)
    index = [("github", "hub.t", f"f{i}", "u") for i in range(300)]
    index += [("github", f"sc.t{i % 30}", f"g{i}", "u") for i in range(200)]
    data = [(f"K-{i}", "see hub.t" if i % 3 == 0 else f"see sc.t{rng.randrange(60)}") for i in range(240)]
    by_key = {}
    for _, pk, label, _ in index:
        by_key.setdefault(pk, []).append(label)
    expected = sorted(((k, s[4:], label) for k, s in data for label in by_key.get(s[4:], [None])), key=repr)
    for parts in (1, 7):
        report = issues.impact_report(
            spark.createDataFrame(data, ISSUES).repartition(parts),
            spark.createDataFrame(index, INDEX).repartition(parts))
        assert rows(report, "issue_key", "field", "label") == expected


@pytest.mark.parametrize("param, fields, code", [
    ("a.b%2Cc.d", ["a.b", "c.d"], None), ("a+b,c", ["a+b", "c"], None), ("x", ["x"], None),
    ("", None, 400), (None, None, 400), ("%zz", None, 500), ("a,,b", None, 500), ("caf%C3%A9", ["café"], None),
])
def test_request_parameters(spark, param, fields, code):
    df = spark.createDataFrame([(1, param)], "request_id long, param string")
    got = [r["field"] for r in issues.lookup_params(df).orderBy("pos").collect()]
    assert got == (fields or [])
    assert [r["status_code"] for r in issues.rejected_params(df).collect()] == ([code] if code else [])


def test_point_lookup(spark, tmp_path):
    spark.createDataFrame(ENTRIES, INDEX).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    got = issues.get_references(index, "un.known,raw.pay")
    assert rows(got) == [(0, "un.known", None, None, None), (1, "raw.pay", "github", "c.sql", "u3")]
    assert "In(pk" in got._jdf.queryExecution().toString()
    for missing in ("", []):
        with pytest.raises(ValueError):
            issues.get_references(index, missing)


def test_tickets_from_an_export(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"key": "K-1", "fields": {"summary": "see ab.c", "other": [1]}}\n{"key": "K-2", "fields": {}}\n')
    assert rows(tickets.read_issues(spark, str(tmp_path))) == [("K-1", "see ab.c"), ("K-2", None)]


def test_streams_give_the_batch_report(spark, tmp_path):
    ticket_data(spark).write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame(ENTRIES, INDEX)
    stream = lambda: spark.readStream.schema(ISSUES).parquet(str(tmp_path / "in"))
    joined = stream_report(stream(), index)
    joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(
        availableNow=True).start(str(tmp_path / "o1")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o1"))) == REPORT
    write_report(stream(), lambda: index, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o2")).drop("batch")) == REPORT
    # Nothing new: a second run adds nothing.
    write_report(stream(), lambda: index, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o2")).drop("batch")) == REPORT
    more = spark.createDataFrame([("K-9", "again raw.pay")], ISSUES)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    write_report(stream(), lambda: index, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    later = spark.read.parquet(str(tmp_path / "o2"))
    assert later.count() == len(REPORT) + 1 and later.filter(F.col("issue_key") == "K-9").count() == 1


def test_hot_field_of_a_stream_is_split(spark, tmp_path):
    entries = spark.createDataFrame([("github", "hub.t", "f", "u"), ("github", "ab.c", "g", "v")], INDEX)
    data = spark.range(100_000).select(
        F.concat(F.lit("K-"), F.col("id")).alias("issue_key"),
        F.when(F.col("id") % 10 > 0, "see hub.t").when(F.col("id") % 20 == 0, "see ab.c")
        .otherwise(F.concat(F.lit("see no.t"), F.col("id"))).alias("summary"))
    hot = hot_fields(issues.issue_refs(data))
    assert rows(hot, "field") == [("ab.c",), ("hub.t",)]
    # As a batch, to see tasks: without the hot table one task has the whole field.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        report = stream_report(data, entries, hot)
        tasks = report.groupBy("field", F.spark_partition_id().alias("task")).count().filter("field = 'hub.t'")
        counts = [r["count"] for r in tasks.collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(counts) == 90_000 and max(counts) < 60_000
    plain = stream_report(data, entries)
    assert report.exceptAll(plain).count() == 0 and plain.exceptAll(report).count() == 0


def test_stream_with_hot_fields_gives_the_batch_report(spark, tmp_path):
    ticket_data(spark).write.parquet(str(tmp_path / "in"))
    hot = hot_fields(issues.issue_refs(ticket_data(spark)))
    stream = spark.readStream.schema(ISSUES).parquet(str(tmp_path / "in"))
    stream_report(stream, spark.createDataFrame(ENTRIES, INDEX), hot).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(
        str(tmp_path / "o")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == REPORT
    none = issues.issue_refs(ticket_data(spark)).limit(0)
    assert rows(hot_fields(none)) == []


@pytest.mark.parametrize("param, code", [
    ("", 400), (None, 400), ("a.b%FF", 500), ("%C3.x", 500), ("ab.c,,x", 500), ("bad%zz", 500),
    ("ab.c%2Cx", None), ("%EF%BF%BD.x", None), ("\ufffd.x", None), ("a+b", None)])
def test_bulk_and_point_lookup_refuse_alike(spark, param, code):
    asked = spark.createDataFrame([(1, param)], "request_id long, param string")
    assert [r["status_code"] for r in issues.rejected_params(asked).collect()] == ([code] if code else [])
    index = spark.createDataFrame(ENTRIES, INDEX)
    if code:
        with pytest.raises(ValueError):
            issues.get_references(index, param)
    else:
        assert issues.get_references(index, param).count() == issues.lookup_params(asked).count()
