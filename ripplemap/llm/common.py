"""What several corpus operators share: shared-folder tables, Arrow batches, digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemap.sources.scratch import cut, discard, shared_path

#: One Arrow batch is worked on in pieces of at most so many text bytes (or one document).
PIECE_BYTES = 1 << 20

__all__ = ["cut", "discard", "encoded", "pieces", "shared_path", "text_digest"]


def text_digest(text: str = "text") -> Column:
    """128 bits that stand for a whole text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif not pa.types.is_binary(column.type):
        column = column.cast(pa.string()).view(pa.binary())
    return [value or b"" for value in column.to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, each with its first index."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]
