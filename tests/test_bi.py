"""BI metadata."""

import json
import random

from ripplemap.operators import bi, lineage
from ripplemap.plans import jobs
from ripplemap.sources import bi_export
from tests.conftest import rows

TABLE = "ordinal long, table_id long, name string, fullName string, schema string, connectionType string"
DASH = "table_id long, pos long, name string, path string"
SERVER = "https://s"


def tables(spark, *full_names, connection="redshift"):
    return spark.createDataFrame(
        [(i, i, n, n, "x", connection) for i, n in enumerate(full_names)], TABLE)


def dashboards(spark, *lists):
    return spark.createDataFrame(
        [(t, p, n, f"{n or ''}{p}") for t, names in enumerate(lists) for p, n in enumerate(names)], DASH)


def test_names_are_kept_up_to_the_first_repeat(spark):
    edges = dashboards(spark, list("abac"), list("qqrr"), list("xy"), ["a", None, "b", None, "c"])
    assert rows(bi.dashboards_by_table(edges), "table_id", "name") == sorted([
        (0, "a"), (0, "b"), (1, "q"), (2, "x"), (2, "y"), (3, "a"), (3, None), (3, "b")], key=repr)
    assert rows(bi.dashboards_by_table(edges, "intended")) == sorted([
        (0, "a", "a0"), (0, "b", "b1"), (0, "c", "c3"), (1, "q", "q0"), (1, "r", "r2"),
        (2, "x", "x0"), (2, "y", "y1"), (3, "a", "a0"), (3, None, "1"), (3, "b", "b2"),
        (3, "c", "c4")], key=repr)


def test_last_table_with_a_dashboard_wins(spark):
    t = tables(spark, "[A].[B]", "a.b", "[a].b", "c.d")
    edges = dashboards(spark, ["p"], ["q", "r"], [], ["s"])
    assert rows(jobs.bi_index(t, edges, SERVER)) == [
        ("a.b", "q", "https://s/#/views/q0"), ("a.b", "r", "https://s/#/views/r1"),
        ("c.d", "s", "https://s/#/views/s0")]
    assert rows(jobs.bi_index(t, edges, SERVER, "intended"), "pk", "label") == [
        ("a.b", "p"), ("a.b", "q"), ("a.b", "r"), ("c.d", "s")]


def test_one_dashboard_name_repeated_throughout_a_hot_table(spark):
    edges = dashboards(spark, ["first"] + ["same"] * 3000, ["x"])
    assert rows(jobs.bi_index(tables(spark, "h.t_tmp", "o.t"), edges, SERVER), "pk", "label") == [
        ("h.t_tmp", "first"), ("h.t_tmp", "same"), ("o.t", "x")]
    assert rows(jobs.bi_index(tables(spark, "h.t_tmp", "h.t"), edges, SERVER, "intended"), "pk", "label") == [
        ("h.t", "first"), ("h.t", "same"), ("h.t", "x")]


def brute_force(t, edges):
    """Index by plain dictionaries."""
    out = {}
    for number, full_name in t:
        kept = {}
        for name in edges.get(number, []):
            if name in kept:
                break
            kept[name] = f"https://s/#/views/{name}{edges[number].index(name)}"
        if kept:
            out[full_name] = kept
    return sorted((pk, n, u) for pk, kept in out.items() for n, u in kept.items())


def test_hot_table_against_brute_force(spark):
    rng = random.Random(3)
    edges = {i: [f"d{rng.randrange(40)}" for _ in range(rng.randrange(12))] for i in range(60)}
    edges[7] = [f"d{i}" for i in range(4000)]  # most rows belong to one table
    edges[8] = ["same"] * 1500  # one name is repeated throughout
    named = [(i, f"s.t{i % 45}") for i in range(60)]
    t = tables(spark, *[n for _, n in named])
    e = dashboards(spark, *[edges[i] for i in range(60)])
    assert rows(jobs.bi_index(t, e, SERVER)) == brute_force(named, edges)
    assert rows(jobs.bi_index(t.repartition(5), e.repartition(7), SERVER)) == brute_force(named, edges)


def test_clean_and_quarantine(spark):
    t = spark.createDataFrame([
        (0, 0, "T", "[Ods].[T]", "ods", None), (1, 1, "U", "[Ods].[U]", "ODS", "redshift"),
        (2, 2, "V", "v", "dbo", "redshift"), (3, 3, "W", "o.w", "o", "hyper"),
        (4, 4, "X", None, "o", "redshift"), (5, 5, "Y", "o.y", None, "redshift"),
        (6, 6, "Z", None, None, "textscan")], TABLE)
    assert rows(bi.bi_clean(t), "table_name", "schema_name", "fullName") == [
        ("T", "ods", "ods.t"), ("U", "ods", "ods.u"), ("V", "v", "v")]
    assert rows(bi.bi_quarantine(t), "ordinal") == [(4,), (5,)]


def test_export_files_are_read_by_schema_in_page_order(spark, tmp_path):
    def node(full_name, *listed):
        return {"name": "N", "fullName": full_name, "schema": "a", "connectionType": None,
                "columns": [{"name": "Id"}], "downstreamDashboards":
                    [{"name": n, "path": n + "/p"} for n in listed], "unused": [1, 2]}

    pages = [[node("[A].[B]", "one"), node("a.c", "x")], [node("a.b", "two", "three", "two", "four")]]
    for i, nodes in enumerate(pages):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"data": {"databaseTables": nodes}}, indent=1))
    read = bi_export.read_nodes(spark, str(tmp_path), "tables_to_dashboards")
    assert rows(jobs.bi_index_of_nodes(read, SERVER)) == [
        ("a.b", "three", "https://s/#/views/three/p"), ("a.b", "two", "https://s/#/views/two/p"),
        ("a.c", "x", "https://s/#/views/x/p")]
    assert rows(bi.bi_clean(read), "columns")[0] == (["id"],)


def test_every_response_kind_has_a_reader(spark, tmp_path):
    for kind, (where, _) in bi_export.NODES.items():
        body = {}
        for piece in reversed(where.split(".")):
            body = {piece: body or [{"name": "n"}]}
        folder = tmp_path / kind
        folder.mkdir()
        (folder / "r.json").write_text(json.dumps({"data": body}))
        assert bi_export.read_nodes(spark, str(folder), kind).count() == 1


def test_lists_without_items_keep_the_node(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"data": {"workbooks": [
        {"id": "1", "name": "w"},
        {"id": "2", "name": "v", "upstreamTables": [{"id": "t", "name": "T"}]}]}}))
    read = bi_export.read_nodes(spark, str(tmp_path), "workbooks")
    assert rows(lineage.workbook_lineage(read), "workbook_id", "kind", "upstream_id") == [
        ("1", None, None), ("2", "table", "t")]


def test_nodes_stored_one_to_a_line(spark, tmp_path):
    lines = [{"id": "1", "name": "a", "luid": "x", "connectionType": None}, {"id": "2", "name": "b"}]
    (tmp_path / "part1.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    read = bi_export.read_node_lines(spark, str(tmp_path), "databases")
    assert [(r["id"], r["name"]) for r in read.orderBy("ordinal").collect()] == [("1", "a"), ("2", "b")]


def test_files_of_lines_are_ordered_by_number(spark, tmp_path):
    for page, dash in ((2, "two"), (10, "ten"), (9, "nine")):
        node = {"name": "N", "fullName": "a.b", "schema": "a", "downstreamDashboards": [{"name": dash, "path": "p"}]}
        (tmp_path / f"page{page}.json").write_text(json.dumps(node) + "\n")
    read = bi_export.read_node_lines(spark, str(tmp_path), "tables_to_dashboards")
    assert rows(jobs.bi_index_of_nodes(read, SERVER)) == [("a.b", "ten", "https://s/#/views/p")]


def test_a_dashboard_without_a_name_is_listed(spark):
    t = tables(spark, "a.b", "c.d")
    edges = dashboards(spark, [None, "x"], [None, None, "y"])
    for mode, second in (("parity", [("c.d", "")]), ("intended", [("c.d", ""), ("c.d", "y")])):
        found = jobs.bi_index(t, edges, SERVER, mode)
        assert rows(found, "pk", "label") == [("a.b", ""), ("a.b", "x"), *second]


def test_bi_index_reads_and_shuffles_the_listing_once(spark, tmp_path):
    t, e = tables(spark, "a.b", "c.d"), dashboards(spark, ["x", "y"], ["z"])
    t.write.parquet(str(tmp_path / "t"))
    e.write.parquet(str(tmp_path / "e"))
    t, e = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "e"))
    found = jobs.bi_index(t, e, SERVER)
    assert len(found.collect()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [table_id") == 1 and plan.count("ReusedExchange") == 1
