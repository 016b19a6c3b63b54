"""Suffix-array dedup against counting strings, on grids of every width and with several doublings."""

import random

import pytest
from pyspark.sql import functions as F

from ripplemap.llm import suffix_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def patchwork():
    """Texts made of shared passages with other bytes around them, periodic ones and copies."""
    rng = random.Random(17)
    letters = "abcdefgh é"

    def some(n, of=letters):
        return "".join(rng.choice(of) for _ in range(n))

    shared = [some(rng.randint(15, 140)) for _ in range(12)]
    texts = ["".join(x for _ in range(4) for x in (some(rng.randint(0, 12)), rng.choice(shared))) for _ in range(60)]
    texts += ["a" * 700, "ab" * 900, ("abc" * 40 + "d") * 30, "a" * 650 + "b" + "a" * 90, some(3000, "ab"), None, "", "a"]
    texts += [some(9) + s[rng.randint(0, 9):] for s in shared] + texts[:3]
    return list(enumerate(texts))


@pytest.mark.parametrize("size, seed, every, doublings", [(40, 8, 8, 2), (41, 8, 4, 3), (20, 3, 1, 3), (60, 50, 4, 1)])
def test_every_grid_equals_brute_force(spark, patchwork, size, seed, every, doublings):
    grid = suffix_dedup.grid(size, seed)
    length, steps = seed, 0
    while length < grid.core:
        length, steps = length + suffix_dedup._step(length, grid), steps + 1
    assert (grid.every, steps) == (every, doublings)
    docs = spark.createDataFrame(patchwork, "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(docs, size=size, seed=seed).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.op6(patchwork, size))


def test_production_grid_fills_a_long():
    assert suffix_dedup.grid(400, 200) == (400, 200, 8, 392, 8)


@pytest.mark.parametrize("limit", [0, 3_000])
@pytest.mark.parametrize("size, seed", [(40, 8), (20, 3), (60, 50)])
def test_hot_anchors_equal_brute_force(spark, patchwork, monkeypatch, limit, size, seed):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
    docs = spark.createDataFrame(patchwork, "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(docs, size=size, seed=seed).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.op6(patchwork, size))


def test_members_of_a_hot_class_lie_in_several_tasks(spark, monkeypatch):
    """Many distinct texts around one passage: what is ranked of it is not one task's work."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 20_000)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(48))
    texts = [f"{i:06d}" + passage + f"{i * 7:06d}" for i in range(2_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = {}
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, name, cut=suffix_dedup.cut: kept.setdefault(name, cut(df, name)))
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: None)
    rows = suffix_dedup.remove_repeats(docs, size=40, seed=30).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.op6(list(enumerate(texts)), 40))
    monkeypatch.undo()
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, name: df.withColumn("task", F.spark_partition_id()))
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: None)
    try:
        cores = suffix_dedup.repeated_cores(kept["stretches"].repartition(4), suffix_dedup.grid(40, 30))
        tasks = cores.groupBy("rank", "task").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    classes = {}
    for r in tasks:
        classes.setdefault(r["rank"], []).append(r["count"])
    hot = max(classes.values(), key=sum)
    assert sum(hot) > 1_000
    assert max(hot) < sum(hot) / 2
