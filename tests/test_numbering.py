"""Places in an order: plain sorting says the same, no task holds a whole group."""

import random

import pytest

from ripplemap.operators.lineage import page_numbers
from ripplemap.operators.numbering import _carries, _offsets, numbered
from ripplemap.sources import scratch
from tests.conftest import rows
from tests.test_plans import plan


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    # One group holds most rows, one null group, some small ones; unique and null orders.
    out = [("hot", i) for i in range(3000)] + [(None, i) for i in range(40)] + [
        (f"g{i % 17}", i) for i in range(200)] + [("nulls", None)]
    rng.shuffle(out)
    return out


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small parts stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_places_in_the_whole_order(spark, data):
    got = numbered(spark.createDataFrame(data, "g string, o long").repartition(5), ["g", "o"])
    expected = [(*row, i) for i, row in enumerate(sorted(data, key=lambda r: ((r[0] is not None, r[0] or ""), key(r[1:]))))]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[-1]) == expected


def test_places_within_groups(spark, data):
    got = numbered(spark.createDataFrame(data, "g string, o long").repartition(5), ["o"], by=["g"], name="at")
    expected = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: key(r[1:]))
        expected += [(*row, i) for i, row in enumerate(own)]
    assert rows(got) == sorted(expected, key=repr)


def test_weighted_places(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"g{i % 5}", i, rng.randint(1, 9)) for i in range(900)]
    df = spark.createDataFrame(data, "g string, o long, w long").repartition(4)
    for by in ((), ("g",)):
        expected, before = [], {}
        for g, o, w in sorted(data, key=lambda r: r[1]):
            seen = before.get(g if by else "", 0)
            expected.append((g, o, w, seen))
            before[g if by else ""] = seen + w
        assert rows(numbered(df, ["o"], by=by, weight="w")) == sorted(expected, key=repr)


def test_equal_rows_get_neighbouring_places(spark):
    got = numbered(spark.createDataFrame([("a", 1)] * 7 + [("a", 0), ("b", 1)], "g string, o long"), ["o"], by=["g"])
    assert sorted(r["number"] for r in got.filter("g = 'a' AND o = 1").collect()) == list(range(1, 8))
    assert numbered(got.limit(0).drop("number"), ["o"]).collect() == []
    assert numbered(got.limit(0).drop("number"), ["o"], by=["g"]).collect() == []


def test_sums_over_parts():
    assert _offsets([(2, 5), (0, 3)]) == [(0, 0), (2, 3)]
    # part 0 ends in b, parts 1 and 2 are b as a whole, part 3 begins with b and ends in c
    assert _carries([(3, "b", "c", 4), (0, "a", "b", 2), (1, "b", "b", 10), (2, "b", "b", 7)]) == [
        (1, 2), (2, 12), (3, 19)]


def test_one_database_with_all_nodes_is_many_tasks_work(spark):
    nodes = spark.range(20_000).selectExpr(
        "struct(id div 10 AS page, id % 10 AS at) AS ordinal",
        "struct('db' AS name, 'redshift' AS connectionType) AS database")
    paged = page_numbers(nodes, 50)
    assert "SinglePartition" not in plan(paged)
    parts = [spark.read.parquet(f).count() for f in paged.inputFiles()]
    assert len(parts) > 1 and max(parts) < 12_000
    assert rows(paged.groupBy("page_number").count()) == sorted(((p, 50) for p in range(400)), key=repr)
    assert rows(paged.filter("ordinal.page = 5 AND ordinal.at = 0"), "page_number") == [(1,)]


def test_scratch_tables_go_when_asked(spark):
    kept = scratch.cut(spark.range(5).toDF("x"), "some")
    gone = scratch.cut(spark.range(7).toDF("x"), "other")
    scratch.discard(gone)
    assert kept.count() == 5 and spark.read.schema("x long").parquet(gone.inputFiles()[0].rsplit("/", 1)[0]).count() == 0
    assert scratch.scratch_root(spark) in kept.inputFiles()[0]


def test_writers_in_threads_leave_the_session_as_it_was(spark):
    before = spark.conf.get(scratch.CLEANUP, None)
    with scratch._cleanup(spark):
        with scratch._cleanup(spark):
            assert spark.conf.get(scratch.CLEANUP) == "true"
        assert spark.conf.get(scratch.CLEANUP) == "true"
    assert spark.conf.get(scratch.CLEANUP, None) == before
