"""The ring against a plain one: the same shards, and little moves when a shard is added."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from ripplemap.llm import ring_shards

CELLS = 1 << 12


def plain_owners(spark, shards, vnodes):
    """Owner of each cell by looking up the next point clockwise; the lesser shard of a cell's points."""
    points = spark.createDataFrame(
        [(s, r) for s in range(shards) for r in range(vnodes)], "shard int, replica long")
    placed = points.select(ring_shards.cell_of(CELLS, F.lit("node"), "shard", "replica").alias("cell"), "shard")
    least = {}
    for cell, shard in placed.collect():
        least[cell] = min(shard, least.get(cell, shard))
    cells = sorted(least)
    return [least[cells[bisect_left(cells, c) % len(cells)]] for c in range(CELLS)]


def test_owners_are_those_of_a_plain_ring(spark):
    assert ring_shards.cell_owners(spark, 7, 16, CELLS) == plain_owners(spark, 7, 16)


def test_one_more_shard_takes_cells_only_into_itself(spark):
    old, new = (ring_shards.cell_owners(spark, n, 64, CELLS) for n in (40, 41))
    moved = [(a, b) for a, b in zip(old, new) if a != b]
    assert moved and all(b == 40 for _, b in moved) and len(moved) < CELLS / 20


def rows_of(df, shards):
    placed = ring_shards.assign_shards(df, ["key"], shards, cells=CELLS)
    return {r["id"]: (r["shard"], r["slot"]) for r in placed.collect()}


def test_few_rows_move_and_counts_stay_even(spark):
    rng = random.Random(9)
    data = [(i, rng.randint(0, 10**9)) for i in range(6000)]
    df = spark.createDataFrame(data, "id long, key long")
    old, new = rows_of(df, 40), rows_of(df, 41)
    for placed, shards in ((old, 40), (new, 41)):
        counts = [0] * shards
        for shard, _ in placed.values():
            counts[shard] += 1
        assert max(counts) - min(counts) <= 1
    # a ring that renames its points would move 40 of 41 rows; bounded loads move some besides the new shard's
    assert sum(old[i][0] != new[i][0] for i in old) < len(data) / 3


def test_rows_of_one_key_lie_together_until_a_shard_is_full(spark):
    rng = random.Random(2)
    data = [(i, i % 50 if i < 2000 else 77 if i < 3000 else rng.randint(100, 10**6)) for i in range(4000)]
    placed = rows_of(spark.createDataFrame(data, "id long, key long"), 10)
    shards = {}
    for i, key in data:
        shards.setdefault(key, set()).add(placed[i][0])
    assert len(shards[77]) >= 3  # 1,000 rows in shards of 400
    assert sum(len(s) == 1 for k, s in shards.items() if k < 50) >= 40


def test_copies_are_given_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ring_shards, "CHUNK", 100)
    df = spark.createDataFrame([(1,)] * 950 + [(2,)] * 50, "key long")
    placed = ring_shards.assign_shards(df, ["key"], 4, cells=CELLS).collect()
    slots = {}
    for r in placed:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(250)) for s in slots.values()) and len(slots) == 4


def test_taken_names_are_refused(spark):
    with pytest.raises(ValueError):
        ring_shards.assign_shards(spark.range(3).withColumn("slot", F.lit(1)), ["id"], 2)
