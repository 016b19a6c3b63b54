"""Physical plans: no pairing of everything with everything, filters where they belong."""

import re

import pytest
from pyspark.sql import functions as F

from ripplemap.operators import code, files, issues
from ripplemap.plans import corpora, jobs, registry
from ripplemap.schemas import INDEX
from ripplemap.sources import repo

SF = "/root/testdata/sf0.001"
# Queries that write something first; their parts are checked under other names.
WRITING = {"q_impact_stream", "q_impact_stream_batches"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - WRITING))
def test_no_query_pairs_all_rows_or_gathers_them_in_one_task(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # One-row aggregates (the variable file) are the only exception.
    if name not in {"q_env_vars", "q_env_vars_missing"}:
        assert "SinglePartition" not in text


def stored_files(spark, folder):
    repo.from_table(corpora.derive(spark, SF, corpora.REPO_FILES)).write.parquet(folder)
    return spark.read.parquet(folder)


def test_code_index_shuffles_once_and_never_content(spark, tmp_path):
    text = plan(jobs.code_index(stored_files(spark, str(tmp_path / "f")), {}))
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?)\)", text)
    assert len(shuffles) == 1 and shuffles[0].startswith("kind")
    # One scan; no content above the loader, so none in its queue or in the shuffle.
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1
    above = text[: text.index("ArrowEvalPython")]
    assert "content#" not in above and "Join" not in text


def test_gate_runs_below_the_yaml_loader(spark, tmp_path):
    corpus = stored_files(spark, str(tmp_path / "f"))
    text = plan(code.yml_documents(files.classify_files(corpus), {}))
    assert text.index("ArrowEvalPython") < text.index("Filter") < text.index("FileScan")
    assert text.count("ArrowEvalPython") == 1
    assert "StringContains(content" in text


def test_scan_reads_only_what_is_used(spark, tmp_path):
    corpus = stored_files(spark, str(tmp_path / "f"))
    schema = re.search(r"ReadSchema: (struct<.*?>)", plan(files.file_urls(files.classify_files(corpus))))
    assert "content" not in schema.group(1)


def test_salts_split_a_hot_key(spark):
    index = spark.range(4000).select(
        F.lit("github").alias("source"), F.lit("hub.t").alias("pk"),
        F.concat(F.lit("f"), F.col("id")).alias("label"), F.lit("u").alias("url"))
    tickets = spark.createDataFrame([("K-1", "see hub.t")], "issue_key string, summary string")
    assert index.schema.names == INDEX.names
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = issues.impact_report(tickets, index)
        sizes = [r["count"] for r in report.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 4000


def test_shares_split_the_tickets_of_a_field_with_one_entry_or_none(spark):
    entry = spark.createDataFrame([("github", "hub.t", "f", "u")], INDEX)
    tickets = spark.range(100_000).select(
        F.concat(F.lit("K-"), F.col("id")).alias("issue_key"),
        F.when(F.col("id") % 2 == 0, "see hub.t").otherwise("see no.such").alias("summary"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = issues.impact_report(tickets, entry)
        sizes = report.groupBy("field", F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for field in ("hub.t", "no.such"):
        counts = [r["count"] for r in sizes if r["field"] == field]
        assert sum(counts) == 50_000 and max(counts) < 40_000
