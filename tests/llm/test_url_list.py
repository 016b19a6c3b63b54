"""A list of domains as a table: marked by joins, as the fixed list is; and the query that derives one."""

import duckdb

import __spark_entry__ as entry_points
from ripplemap.llm import url_cascade
from ripplemap.llm.queries import LISTED_DOMAINS, URL_RULES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_marks_as_fixed_list_does(spark, odd_dir):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet").select("page_id", "url")
    table = spark.createDataFrame([(d,) for d in (*LISTED_DOMAINS, LISTED_DOMAINS[0], None)], "domain string")
    assert rows(url_cascade.filter_urls(pages, URL_RULES, table)) == rows(
        url_cascade.filter_urls(pages, URL_RULES, LISTED_DOMAINS))


def test_long_list_has_several_levels_and_no_error(spark):
    hosts = spark.range(4000).selectExpr("'www.h' || id || '.net' AS key", "id")
    domains = spark.range(0, 4000, 3).selectExpr("'h' || id || '.net' AS domain")
    universe = url_cascade.marked_hosts(hosts.select("key"), domains)
    cascade, shards = url_cascade.build_cascade(universe)
    assert len(cascade.first()["levels"]) >= 2
    pages = hosts.selectExpr("id AS page_id", "'http://' || key || '/x' AS url")
    got = url_cascade.filter_urls(pages, (), domains).select("page_id", "verdict").collect()
    assert len(got) == 4000 and all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_spam_names_are_listed_under_any_top_level_domain(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    df = entry_points.queries()["op10_url_cascade_listed"](spark, folder)
    sql = entry_points.oracle_sql()["op10_url_cascade_listed"]
    found = df.collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=repr)
    spam = [r for r in found if r["host"] == "www.cheap-pills.example.com" and r["rule"] is None]
    assert spam and all(r["verdict"] == "block" for r in spam)
