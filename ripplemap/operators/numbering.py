"""Places in an order, without one task that sees all rows: a parallel prefix sum.

Rows are dealt by ranges of the order, sorted and written with their place in their part.
The parts' counts, one row each, are added up on the driver (their number is that of the
shuffle partitions, whatever the data) and joined back as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemap.sources.scratch import cut

#: Bits of ``monotonically_increasing_id`` that hold the row's place in its part.
_ROW_BITS = 33


def _offsets(counts: list) -> list[tuple[int, int]]:
    """(part, rows before it) of (part, rows)."""
    out, total = [], 0
    for part, n in sorted(counts):
        out.append((part, total))
        total += n
    return out


def _carries(summaries: list) -> list[tuple[int, int]]:
    """(part, rows of its first group in earlier parts), where there are any.

    ``summaries`` has (part, first group, last group, rows of the last group).
    """
    out, group, held = [], None, 0
    for part, first, last, rows in sorted(summaries, key=lambda s: s[0]):
        carried = held if held and group == first else 0
        if carried:
            out.append((part, carried))
        held = rows + carried if first == last else rows
        group = last
    return out


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "number",
             weight: str | None = None) -> DataFrame:
    """Add ``name`` (long): the row's place from 0 in the ascending order, among rows equal in ``by``.

    With ``weight``, a positive whole number, a row stands for so many rows and gets the place of
    the first. Nulls come first. Rows equal in ``by`` and ``order`` get neighbouring places, in any
    order, and are one task's work. One value of ``by`` may hold any share of the rows. Names that
    begin with ``__number`` are the operator's own.
    """
    keys = [*by, *order]
    placed = cut(
        rows.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys))
        .sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys))
        .withColumn("__number_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__number_at", _ROW_BITS).alias("__number_part")
    spark = rows.sparkSession
    if not by and weight is None:
        counts = placed.groupBy(part).agg(F.count("*")).collect()
        offsets = spark.createDataFrame(
            _offsets([tuple(r) for r in counts]), "__number_part long, __number_offset long")
        in_part = F.col("__number_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        return placed.withColumn("__number_part", part).join(F.broadcast(offsets), "__number_part").select(
            *rows.columns, (in_part + F.col("__number_offset")).alias(name))
    # the places of a group's rows in one part, and after them those it has in earlier parts
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counted = F.sum(weight) if weight else F.count("*")
    local = placed.withColumns({"__number_part": part, "__number_group": group}).withColumn(
        "__number_end", counted.over(Window.partitionBy("__number_part", "__number_group").orderBy(
            "__number_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    ends = local.groupBy("__number_part").agg(*(
        pick(c, "__number_at") for pick, c in (
            (F.min_by, "__number_group"), (F.max_by, "__number_group"), (F.max_by, "__number_end")))).collect()
    firsts = {r[0]: r[1] for r in ends}
    carries = [(p, firsts[p], n) for p, n in _carries([tuple(r) for r in ends])]
    kind = local.schema["__number_group"].dataType.simpleString()
    known = F.broadcast(spark.createDataFrame(
        carries, f"__number_of long, __number_first {kind}, __number_carry long"))
    met = (F.col("__number_part") == F.col("__number_of")) & F.col("__number_group").eqNullSafe(
        F.col("__number_first"))
    number = F.col("__number_end") - (F.col(weight) if weight else F.lit(1)) + F.coalesce(
        "__number_carry", F.lit(0).cast("long"))
    return local.join(known, met, "left").select(*rows.columns, number.cast("long").alias(name))
