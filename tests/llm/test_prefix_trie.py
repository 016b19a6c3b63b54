"""The conversation trie against plain Python and SQL, on odd conversations and deep ones."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from ripplemap.llm import prefix_trie
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_query_equals_plain_python_and_sql(spark, odd_dir, which):
    folder = odd_dir if which == "odd" else SMALL
    data = spark.read.parquet(f"{folder}/conversations.parquet")
    found = rows(entry_points.queries()["op13_prefix_trie"](spark, folder))
    assert found == sorted(brute.op13([tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()]), key=repr)
    con = duckdb.connect()
    pattern = f"{folder}/conversations.parquet" + ("/*.parquet" if which == "odd" else "")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{pattern}'")
    assert found == sorted(con.execute(entry_points.oracle_sql()["op13_prefix_trie"]).fetchall(), key=repr)


def test_small_blocks_pieces_and_parts_give_the_same(spark, odd_dir, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        expected = rows(prefix_trie.trie(prefix_trie.rebuilt(spark.read.parquet(f"{odd_dir}/conversations.parquet"))))
        monkeypatch.setattr(prefix_trie, "BLOCK", 4)
        monkeypatch.setattr(prefix_trie, "PACKED", 3)
        data = spark.read.parquet(f"{odd_dir}/conversations.parquet").repartition(5)
        assert rows(prefix_trie.trie(prefix_trie.rebuilt(data))) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_totals(parent, leaves, saved):
    order = sorted(parent, key=lambda v: -depth_of(v, parent))
    totals = {v: [leaves[v], saved[v]] for v in parent}
    for v in order:
        if parent[v] is not None:
            for k in (0, 1):
                totals[parent[v]][k] += totals[v][k]
    return totals


def depth_of(v, parent):
    d = 0
    while parent[v] is not None:
        v, d = parent[v], d + 1
    return d


def tree(kind, n, rng):
    """parent of each node, node 0 the root."""
    if kind == "chain":
        return {i: i - 1 if i else None for i in range(n)}
    if kind == "star":
        return {i: 0 if i else None for i in range(n)}
    if kind == "caterpillar":
        return {i: None if not i else i - 1 if i % 2 else max(0, i - 2) for i in range(n)}
    return {i: rng.randint(max(0, i - 4), i - 1) if i else None for i in range(n)}


@pytest.mark.parametrize("kind", ["chain", "star", "caterpillar", "random"])
def test_contraction_gives_every_subtree_total(spark, kind, monkeypatch):
    rng = random.Random(1)
    parent = tree(kind, 300, rng)
    kids = {v: 0 for v in parent}
    for p in parent.values():
        if p is not None:
            kids[p] += 1
    saved = {v: rng.randint(0, 100) for v in parent}
    leaves = {v: int(kids[v] == 0) for v in parent}
    rows_ = [((v, -v), None if p is None else (p, -p), depth_of(v, parent), kids[v], leaves[v], saved[v]) for v, p in parent.items()]
    node = "struct<a:bigint,b:bigint>"
    nodes = spark.createDataFrame(
        rows_, f"node {node}, parent {node}, depth long, n_kids long, leaves long, saved long").repartition(3)
    rounds = []
    contract = prefix_trie._contract
    monkeypatch.setattr(prefix_trie, "_contract", lambda s, k: rounds.append(k) or contract(s, k))
    found = {r["node"]["a"]: [r["leaves"], r["saved"]] for r in prefix_trie.subtree_totals(nodes).collect()}
    assert found == plain_totals(parent, leaves, saved)
    # a chain of 300 would take 299 rounds of raking alone
    assert len(rounds) <= {"chain": 12, "star": 1, "caterpillar": 16, "random": 30}[kind]


def test_other_columns_and_empty_tables(spark, odd_dir):
    data = spark.read.parquet(f"{odd_dir}/conversations.parquet")
    wide = data.withColumns({c: F.lit(c) for c in ("node", "place", "depth", "__salt", "n", "h")})
    some = data.filter("conv_id < 105")
    assert rows(prefix_trie.trie(prefix_trie.rebuilt(wide.filter("conv_id < 105")))) == rows(
        prefix_trie.trie(prefix_trie.rebuilt(some)))
    assert prefix_trie.trie(prefix_trie.rebuilt(data.limit(0))).collect() == []


def test_conversations_as_they_are(spark):
    data = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "bb"), (3, 0, "user", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(prefix_trie.turns(df)).collect()}
    assert sorted(found) == [(1, 0), (1, 1), (1, 2), (2, 2)]
    assert (found[1, 1]["n_convs"], found[1, 1]["n_children"], found[1, 1]["n_leaves"]) == (3, 2, 2)
    assert found[1, 0]["saved_tokens"] == 2 and found[1, 1]["ends_sha256"] == brute.sha("3")
