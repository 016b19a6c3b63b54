"""Token ids in ORC files, in ascending order of document ids.

Documents are dealt by ranges of their id and sorted; each task encodes its range as it
streams by and writes one file. A file has integer columns only, so ORC's run-length encoding
packs them; its stripes can be read by tasks of their own; row indexes and Bloom filters on
the id let a reader skip stripes and row groups by metadata. ``start`` in a file counts from
its own first token. What the files before it hold is in a small table of parts, one row a
file, written last: a folder without it is unfinished.

A tokenizer that drops white space sees a text's words one by one (``by_words``): the ids of
short words are kept for the next texts, and only new ones go through the library. Words are
few when those are merged that the tokenizer tells apart by nothing: for one that lower-cases,
A-Z is lower-cased first, and ``marks`` names punctuation that it parts from a letter before
it, so that a word and the marks behind it are two.

Defined results: a null or empty text is the end id alone; a null id comes first; rows of one
id follow each other by text, and are one task's work; an empty table gives an empty file set;
special tokens in a text follow the tokenizer file. Only id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.llm.common import encoded, pieces

#: Words kept with their ids, in the younger of two generations, and the longest kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 48
#: Bytes of text whose distinct words are looked up together.
PIECE = 4 << 20
#: Latin letters, which a mark may follow.
_LETTER = "[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
STRIPE_BYTES, INDEX_ROWS = 64 << 20, 10_000
#: Rows after which a writer looks whether its stripe is full; few, since documents may be long.
ROWS_BETWEEN_CHECKS = 100
SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"
PARTS = "part int, n_docs long, n_tokens long, first_id long, last_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()),
                    ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Encoder:
    """Ids of texts by a tokenizer file."""

    def __init__(self, path: str, by_words: bool, marks: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if marks and any(t[-1] in marks for t in self.special):
            raise ValueError(f"a special token ends with one of {marks}")
        self.marks = f"({_LETTER})([{re.escape(marks)}]+)(\\s|$)" if marks else None
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(ascii_uppercase) == ascii_lowercase
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in found]

    def _known(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words; new ones go through the library."""
        found = list(map(self.young.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        met = {w: ids for w in missing if (ids := self.old.get(w)) is not None}
        if new := [w for w in missing if w not in met]:
            met.update(zip(new, self._encode(new)))
        self.young.update((w, ids) for w, ids in met.items() if len(w) <= KEPT_CHARS)
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        return [met[w] if ids is None else ids for w, ids in zip(words, found)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if not self.by_words:
            rows = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(rows), "<i4"), np.array([len(x) // 4 for x in rows], np.int64)
        if self.lowers:
            lower = pc.ascii_lower(texts)
            # a lower-cased text must not become a special token that it was not
            if not any(pc.any(pc.match_substring(lower, t)).as_py() for t in self.special):
                texts = lower
        if self.marks:
            texts = pc.replace_substring_regex(texts, self.marks, r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)  # an empty word at an edge has no ids
        words = split.flatten().dictionary_encode()
        rows = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, size = np.frombuffer(b"".join(rows), "<i4"), np.array([len(x) // 4 for x in rows], np.int64)
        at = words.indices.to_numpy()
        count = size[at]
        ends = np.cumsum(count)
        chosen = np.repeat((np.cumsum(size) - size)[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return ids[chosen], np.diff(np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()])


@lru_cache(maxsize=1)
def encoder(path: str, by_words: bool, marks: str) -> Encoder:
    """One for all tasks of a Python worker, which so share the kept words."""
    return Encoder(path, by_words, marks)


def _rows(batches: Iterator[pa.RecordBatch], encode: Encoder, end: Sequence[int]) -> Iterator[pa.RecordBatch]:
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(1).fill_null("")
        for first, rows in pieces(encoded(texts), PIECE):
            ids, sizes = encode(texts.slice(first, len(rows)))
            number = np.repeat(np.arange(len(rows)), sizes)
            closed = np.empty(len(ids) + len(rows) * len(end), np.int32)
            closed[np.arange(len(ids)) + number * len(end)] = ids
            sizes = sizes + len(end)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for k, value in enumerate(end):
                closed[ends[1:] - len(end) + k] = value
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(rows)), pa.array(np.full(len(rows), part, np.int32)),
                 pa.array(start + ends[:-1]), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(closed))], schema=_ARROW)
            start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: Sequence[int] = (1,), by_words: bool = False,
                 marks: str = "", id_column: str = "doc_id", text: str = "text", stripe_bytes: int = STRIPE_BYTES,
                 index_rows: int = INDEX_ROWS) -> None:
    """Encode whole texts, each with the ``end`` ids behind it, into a new folder ``path``."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    in_order = chosen.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    end = tuple(end)
    tokens = in_order.mapInArrow(lambda batches: _rows(batches, encoder(tokenizer, by_words, marks), end), SCHEMA)
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true").option("orc.rows.between.memory.checks", ROWS_BETWEEN_CHECKS)
        .option("compression", "zstd").orc(f"{path}/tokens")
    )
    counts = _tokens(spark, path).groupBy("part").agg(
        F.count("*"), F.sum("n_tokens"), F.min("doc_id"), F.max("doc_id")).collect()
    rows, offset = [], 0
    for part, n_docs, n_tokens, first, last in sorted((tuple(r) for r in counts), key=lambda r: r[0]):
        rows.append((part, n_docs, n_tokens, first, last, offset))
        offset += n_tokens
    spark.createDataFrame(rows, PARTS).coalesce(1).write.orc(f"{path}/parts")  # one row for each file


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(f"{path}/tokens")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_docs, n_tokens, first_id, last_id, offset): one row for each file."""
    return spark.read.schema(PARTS).orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents, or some found by metadata.

    ``start`` is the number of tokens of all documents before this one. Given ids become a
    filter that reaches the files' Bloom filters and row indexes.
    """
    tokens = _tokens(spark, path)
    if ids is not None:
        tokens = tokens.filter(F.col("doc_id").isin(*ids))
    parts = read_parts(spark, path).select("part", "offset")
    return tokens.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    def over(column: pa.Array) -> pa.Array:
        data = memoryview(column.values.to_numpy().astype("<i4", copy=False)).cast("B")
        ends = column.offsets.to_numpy().astype(np.int64) * 4
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())

    return F.arrow_udf(over, "long")(ids)
