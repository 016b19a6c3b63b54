"""Content-defined anchors that tell where repeated windows can be.

The anchor of a window is the least hash of the shorter strings inside it, so equal windows
have equal anchors. Anchors that occur once in the corpus rule their windows out without
moving any text. The repeated ones are kept as bits of a fixed-size table that is broadcast:
its size does not depend on the corpus, and a bit set by chance only costs work, because
whatever it lets through is compared exactly later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table has 2^BITS bits (16 MB), whatever the corpus.
BITS = 27


def bit_table(anchors: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """Bits of the anchors (long column ``name``), or-ed before the shuffle.

    At most 2^bits / 64 rows reach the driver: a fixed bound.
    """
    at = F.shiftrightunsigned(name, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = anchors.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which anchors have their bit set."""
    at = anchors >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def owner(id_column: str) -> Column:
    """Ids as comparable numbers; a null id comes after all others."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1))
