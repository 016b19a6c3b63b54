"""Index: merge, records, stored versions."""

import pytest

from ripplemap.operators import index
from ripplemap.schemas import ENTRIES, INDEX
from ripplemap.sources import index_store
from tests.conftest import rows

OLD = [("github", "a.b", "f1", "u1"), ("github", "a.b", "f2", "u2"), ("github", "gone.x", "f1", "u1"),
       ("tableau", "a.b", "d1", "v1"), ("tableau", "only.bi", "d2", "v2")]
NEW = [("a.b", "f3", "u3"), ("new.t", "f3", "u3")]


def test_upsert_replaces_keys_of_the_run_and_keeps_stale_ones(spark):
    old, new = spark.createDataFrame(OLD, INDEX), spark.createDataFrame(NEW, ENTRIES)
    merged = index.merge_index(old, new, "github")
    assert rows(merged) == sorted([("github", *e) for e in NEW] + [OLD[2], OLD[3], OLD[4]])
    assert rows(index.merge_index(merged, new, "github")) == rows(merged)
    assert rows(index.merge_index(old, new, "github", "replace")) == sorted(
        [("github", *e) for e in NEW] + OLD[3:])


def test_merging_one_source_leaves_the_other_alone(spark):
    old, new = spark.createDataFrame(OLD, INDEX), spark.createDataFrame(NEW, ENTRIES)
    for mode in ("upsert", "replace"):
        merged = index.merge_index(old, new, "github", mode)
        assert rows(merged.filter("source = 'tableau'")) == sorted(OLD[3:])


def test_bad_input_is_refused(spark):
    old = spark.createDataFrame(OLD, INDEX)
    bad = spark.createDataFrame([(None, "f", "u"), ("", "g", "u"), ("k.l", "h", "u")], ENTRIES)
    assert rows(index.rejected_keys(bad), "label", "reason") == [("f", "MissingKey"), ("g", "MissingKey")]
    assert rows(index.merge_index(old, bad, "github", "replace").filter("source = 'github'")) == [
        ("github", "k.l", "h", "u")]
    with pytest.raises(ValueError):
        index.merge_index(old, bad, "gitlab")
    with pytest.raises(ValueError):
        index.merge_index(old, bad, "github", "append")


def test_merge_with_a_hot_key(spark):
    hot = [("github", "hub.t", f"f{i}", "u") for i in range(5000)] + OLD
    old = spark.createDataFrame(hot, INDEX).repartition(6)
    kept = index.merge_index(old, spark.createDataFrame([("x.y", "z", "u")], ENTRIES), "github")
    assert kept.count() == len(hot) + 1
    replaced = index.merge_index(old, spark.createDataFrame([("hub.t", "z", "u")], ENTRIES), "github")
    assert rows(replaced.filter("pk = 'hub.t'")) == [("github", "hub.t", "z", "u")]


def test_records_tell_missing_from_empty_and_stay_small(spark):
    entries = OLD + [("tableau", "empty.bi", None, None)] + [
        ("github", "hub.t", f"f{i}", None) for i in range(95)]
    records = index.to_records(spark.createDataFrame(entries, INDEX).repartition(3), 10).collect()
    by_key = {}
    for r in records:
        by_key.setdefault(r["pk"], []).append(r)
    (ab,), (gone,), (empty,) = by_key["a.b"], by_key["gone.x"], by_key["empty.bi"]
    assert (ab["part"], ab["github"]["files"]) == (0, {"f1": "u1", "f2": "u2"})
    assert ab["tableau"]["dashboards"] == {"d1": "v1"}
    assert gone["tableau"] is None
    assert empty["tableau"]["dashboards"] == {} and empty["github"] is None
    parts = [r["github"]["files"] for r in by_key["hub.t"]]
    assert 1 < len(parts) <= 10 and all(len(p) < 40 for p in parts)
    assert {k for p in parts for k in p} == {f"f{i}" for i in range(95)}


def test_key_summary(spark):
    entries = OLD + [("tableau", "empty.bi", None, None)]
    assert rows(index.index_keys(spark.createDataFrame(entries, INDEX))) == [
        ("a.b", True, True, 1, 2), ("empty.bi", True, False, 0, 0), ("gone.x", False, True, 0, 1),
        ("only.bi", True, False, 1, 0)]


def test_stored_versions(spark, tmp_path):
    base = str(tmp_path / "index")
    assert rows(index_store.read_index(spark, base)) == []
    entries = lambda *e: spark.createDataFrame(list(e), ENTRIES)
    assert index_store.upsert_index(spark, base, entries(("a.b", "f", "u"), ("c.d", "g", "u")), "github") == 1
    assert index_store.upsert_index(spark, base, entries(("a.b", "d", "v")), "tableau") == 1
    assert index_store.upsert_index(spark, base, entries(("a.b", "h", "u")), "github") == 2
    assert rows(index_store.read_index(spark, base)) == [
        ("github", "a.b", "h", "u"), ("github", "c.d", "g", "u"), ("tableau", "a.b", "d", "v")]
    # A run that died after its data and before its version row is not seen, then overwritten.
    entries(("lost.x", "f", "u")).write.parquet(f"{base}/github/data/version=3")
    assert index_store.current_version(spark, base, "github") == 2
    assert index_store.upsert_index(spark, base, entries(("e.f", "f", "u")), "github", "replace") == 3
    assert rows(index_store.read_entries(spark, base, "github")) == [("e.f", "f", "u")]
    with pytest.raises(ValueError):
        index_store.read_entries(spark, base, "jira")


def bucket_files(tmp_path, source="github"):
    """Files with rows of each (version, bucket), by name and size."""
    out = {}
    for f in (tmp_path / "index" / source / "data").glob("version=*/bucket=*/*.parquet"):
        out.setdefault((f.parent.parent.name, f.parent.name), []).append((f.name, f.stat().st_size))
    return {k: sorted(v) for k, v in out.items()}


def test_a_run_of_one_key_rewrites_one_bucket(spark, tmp_path):
    base = str(tmp_path / "index")
    first = spark.range(3000).selectExpr("concat('s.t', id % 900) AS pk", "concat('f', id) AS label", "'u' AS url")
    index_store.upsert_index(spark, base, first, "github")
    before, old = bucket_files(tmp_path), rows(index_store.read_entries(spark, base, "github"))
    assert len(before) > 200
    new = spark.createDataFrame([("s.t7", "g", "v")], ENTRIES)
    assert index_store.upsert_index(spark, base, new, "github") == 2
    after = bucket_files(tmp_path)
    written = [k for k in after if k[0] == "version=2"]
    assert len(written) == 1 and {k: v for k, v in after.items() if k[0] == "version=1"} == before
    listed = index_store.manifest(spark, base, "github")
    assert sorted(v for v in listed.values()).count(2) == 1 and len(listed) == len(before)
    expected = [r for r in old if r[0] != "s.t7"] + [("s.t7", "g", "v")]
    assert rows(index_store.read_entries(spark, base, "github")) == sorted(expected, key=repr)
    # the replaced bucket goes, the others stay
    assert index_store.expire_versions(spark, base, "github") == 1
    assert rows(index_store.read_entries(spark, base, "github")) == sorted(expected, key=repr)
    left = {k for k in bucket_files(tmp_path) if k[0] == "version=1"}
    stale = ("version=1", written[0][1])
    assert before.keys() - left <= {stale} and spark.read.schema(ENTRIES).parquet(
        f"{base}/github/data/{stale[0]}/{stale[1]}").count() == 0
    assert index_store.current_version(spark, base, "github") == 2
    assert index_store.upsert_index(spark, base, new, "github", "replace") == 3
    assert rows(index_store.read_entries(spark, base, "github")) == [("s.t7", "g", "v")]
    with pytest.raises(ValueError):
        index_store.expire_versions(spark, base, "github", keep=0)


def test_a_lookup_opens_only_the_buckets_of_its_keys(spark, tmp_path):
    base = str(tmp_path / "index")
    assert index_store.read_keys(spark, base, ["a.b"]).collect() == []
    entries = spark.range(3000).selectExpr("concat('s.t', id % 900) AS pk", "concat('f', id) AS label", "'u' AS url")
    index_store.upsert_index(spark, base, entries, "github")
    index_store.upsert_index(spark, base, spark.createDataFrame([("s.t7", "d", "w")], ENTRIES), "tableau")
    found = index_store.read_keys(spark, base, ["s.t7"])
    folders = {f.rsplit("/", 2)[1] for f in found.inputFiles()}
    assert len(folders) == 1
    assert rows(found) == sorted(
        [("github", "s.t7", f"f{i}", "u") for i in range(7, 3000, 900)] + [("tableau", "s.t7", "d", "w")], key=repr)
    answer = rows(index_store.stored_references(spark, base, "s.t7%2Cno.such"), "pos", "field", "source", "label")
    assert len(answer) == 6 and (1, "no.such", None, None) in answer
    assert index_store.read_keys(spark, base, []).collect() == []
    with pytest.raises(ValueError):
        index_store.stored_references(spark, base, "a.b,,c.d")


def test_many_entries_of_one_key_are_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(20_000).selectExpr("'hub.t' AS pk", "concat('f', id) AS label", "'u' AS url")
        index_store.upsert_index(spark, str(tmp_path / "index"), hot, "github")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (listed,) = bucket_files(tmp_path).values()
    assert len(listed) > 1
    assert index_store.read_keys(spark, str(tmp_path / "index"), ["hub.t"]).count() == 20_000
