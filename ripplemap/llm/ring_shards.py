"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on the ring; a row belongs to the first point clockwise
of its key's hash. A shard takes at most its capacity. Rows beyond it go on clockwise to
the next shard with room, after the rows that are at home there, so only the overflow
moves. With capacities that add up to the number of rows, counts differ by at most one.

The ring is cut into ``cells`` equal parts, each owned by the next point clockwise. A
point's place follows from its shard and number alone, so one more shard renames no point:
it takes cells only into itself. Only the number of rows in each cell (``cells`` numbers,
whatever the data) decides how much of a cell goes where. Rows are then numbered within
their cell by parallel prefix sums, equal rows by their count, so one key or one row may
hold a third of all rows; the numbers are given out in chunks. Column functions only.

Rows of one key lie together: in one shard, or, where that is full, on from its end to the
next ones clockwise.

Defined results: null ids and texts are keys like any other; equal rows go to neighbouring
slots; an empty table gives an empty result. All columns of the input are kept (they must
be orderable), after ``shard`` and ``slot``; an input column of such a name, or one that
begins with two underscores, is refused.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.llm.common import cut
from ripplemap.operators.numbering import numbered

#: Equal rows that one task gives back at a time.
CHUNK = 100_000


def cell_of(cells: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int")


def cell_owners(spark: SparkSession, shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard of each cell: that of the next virtual node clockwise, its own cell included."""
    shard, replica = F.floor(F.col("id") / vnodes).cast("int"), F.col("id") % vnodes
    nodes = spark.range(shards * vnodes).select(
        cell_of(cells, F.lit("node"), shard, replica).alias("cell"), shard.alias("shard"))
    at: dict[int, int] = {}
    for cell, shard in sorted(tuple(r) for r in nodes.collect()):
        at.setdefault(cell, shard)
    owners, owner = [0] * cells, at[min(at)]
    for cell in range(cells - 1, -1, -1):
        owner = owners[cell] = at.get(cell, owner)
    return owners


def even_capacity(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allot(counts: Sequence[int], owners: Sequence[int], capacity: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, rows, shard) for each part of a cell.

    First every cell fills its owner, in ring order; then the rest goes clockwise, first
    come first served, for at most two laps.
    """
    room, parts, over = list(capacity), [], {}
    for cell, (n, shard) in enumerate(zip(counts, owners)):
        here = min(n, room[shard])
        room[shard] -= here
        if here:
            parts.append((cell, 0, here, shard))
        if n > here:
            over[cell] = (cell, here, n - here)
    carried: deque[tuple[int, int, int]] = deque()
    for lap in range(2):
        for cell, shard in enumerate(owners):
            if lap == 0 and cell in over:
                carried.append(over[cell])
            while carried and room[shard]:
                home, first, n = carried.popleft()
                here = min(n, room[shard])
                room[shard] -= here
                parts.append((home, first, here, shard))
                if n > here:
                    carried.appendleft((home, first + here, n - here))
    if carried:
        raise ValueError("too little room on the ring for all rows")
    return parts


def assign_shards(rows: DataFrame, key: Sequence[str], shards: int, vnodes: int = 64,
                  cells: int = 1 << 16) -> DataFrame:
    """``shard`` (int) and ``slot`` (long) for every row, then the row's own columns."""
    spark, columns = rows.sparkSession, rows.columns
    if taken := [c for c in columns if c in ("shard", "slot") or c.startswith("__")]:
        raise ValueError(f"these names are taken: {taken}")
    groups = cut(
        rows.withColumn("__cell", cell_of(cells, *key)).groupBy("__cell", *columns).agg(
            F.count("*").alias("__n")), "ring-groups")
    counts = [0] * cells
    for cell, n in groups.groupBy("__cell").agg(F.sum("__n")).collect():
        counts[cell] = n
    owners = cell_owners(spark, shards, vnodes, cells)
    parts, used = [], [0] * shards
    for cell, first, n, shard in allot(counts, owners, even_capacity(sum(counts), shards)):
        parts.append((cell, first, first + n, shard, used[shard] - first))
        used[shard] += n
    # at most two rows a cell and one for each shard that gets full: bounded, so broadcast
    table = F.broadcast(spark.createDataFrame(
        parts, "__cell int, __first long, __end long, shard int, __shift long"))
    order = [*key, *(c for c in columns if c not in key)]
    ranked = numbered(groups, order, by=["__cell"], name="__from", weight="__n")
    low = F.greatest("__from", "__first")
    high = F.least(F.col("__from") + F.col("__n"), F.col("__end"))
    placed = ranked.join(table, "__cell").withColumns({"__low": low, "__high": high}).filter("__low < __high")
    chunked = placed.withColumn("__low", F.explode(F.sequence("__low", F.col("__high") - 1, F.lit(CHUNK))))
    spread = chunked.repartition("__cell", "__low")
    last = F.least(F.col("__low") + CHUNK, F.col("__high")) - 1
    given = spread.withColumn("__rank", F.explode(F.sequence("__low", last)))
    return given.select("shard", (F.col("__rank") + F.col("__shift")).alias("slot"), *columns)
