"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
least ``min_chars`` characters in at least ``min_docs`` documents are frequent. They are
counted by a 128-bit hash (pre-aggregated before the shuffle, so a key may be in a third
of all documents), and each shard of the frequent hashes gets a minimal perfect hash that
indexes arrays of a 64-bit fingerprint, the count and the largest document id. Documents
probe these arrays; lines are never joined.

The arrays reach the tasks by broadcast, in slices of at most ``slice_keys`` keys, counted
first. More keys mean more passes over the documents, with what was found written in
between; no slice is ever larger.

Defined results: a null or empty text is one empty line; every row counts as a document,
so repeated rows count; a null id is never the largest unless all ids of a key are null;
of rows that share the largest id all keep the line; empty tables are fine; other columns
are kept; names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import cut, encoded, pieces
from ripplemap.llm.wordscan import mix

#: Keys of one shard of the index, about.
SHARD_KEYS = 20_000
#: Positions for each key in one level of a perfect hash.
SPREAD = 2
LINES = "struct<n_lines:bigint,dropped:array<int>,kept:string>"


def line_hashes(text: bytes, min_chars: int) -> tuple[int, dict[int, tuple[int, int]]]:
    """Number of lines, and the 128-bit hash, in two halves, of each line long enough."""
    lines, found = text.split(b"\n"), {}
    for i, line in enumerate(lines):
        if len(line) < min_chars:
            continue
        key = line.strip().lower()  # bytes: ASCII only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            h = xxhash.xxh3_128_intdigest(key)
            found[i] = (h >> 64, h & 0xFFFFFFFFFFFFFFFF)
    return len(lines), found


def line_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """(high, low, docs, last) for each key: documents that have it and the largest id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, owner = [], [], []
            for i, t in enumerate(encoded(batch.column(1))):
                own = set(line_hashes(t, min_chars)[1].values())
                high += [h for h, _ in own]
                low += [x for _, x in own]
                owner += [i] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)),
                 batch.column(0).take(pa.array(owner, pa.int64()))], ["high", "low", "id"])

    ids = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return ids.mapInArrow(keys, "high long, low long, id long").groupBy("high", "low").agg(
        F.count("*").alias("docs"), F.max("id").alias("last"))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, positions by rank.

    A key that is alone at its position of a level is placed there; the others go on to the
    next level. A key's number is the count of set bits before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, left = [], keys
        while len(left):
            size = SPREAD * len(left) + 1
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.starts = np.concatenate(([0], np.cumsum([int(b.sum()) for b in self.levels]))).astype(np.int64)
        self.ranks = [np.cumsum(b, dtype=np.uint32) for b in self.levels]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1, or any number, for a key that is not in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._at(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.starts[level] + self.ranks[level][at[here]] - 1
            left = left[~here]
        return out


class Shard:
    """Fingerprints, counts and largest ids of one shard, by perfect hash number."""

    def __init__(self, high, low, docs, last, no_id):
        self.number = PerfectHash(high)
        at = self.number(high)
        self.fingerprint, self.docs, self.last, self.no_id = (np.empty_like(a) for a in (low, docs, last, no_id))
        for array, values in ((self.fingerprint, low), (self.docs, docs), (self.last, last), (self.no_id, no_id)):
            array[at] = values

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is not in the shard."""
        at = self.number(high)
        return np.where((at >= 0) & (self.fingerprint[at] == low), at, -1)


def shard_of_key(low: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(low, 33), F.lit(shards)).cast("int")


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, data) for rows of ``line_counts``; one shard is built in one piece.

    Of keys with equal first halves (a chance of 2^-64 for a pair) one is in the perfect
    hash and the others are listed beside it.
    """

    def one(table: pa.Table) -> pa.Table:
        high, low = (table[n].to_numpy().view(np.uint64) for n in ("high", "low"))
        last = table["last"].combine_chunks()
        no_id, ids = last.is_null().to_numpy(zero_copy_only=False), last.fill_null(0).to_numpy()
        own = np.unique(high, return_index=True)[1]
        shard = Shard(high[own], low[own], table["docs"].to_numpy()[own], ids[own], no_id[own])
        beside = {(int(high[i]), int(low[i])): (int(ids[i]), bool(no_id[i]))
                  for i in np.setdiff1d(np.arange(len(high)), own)}
        return pa.table({"shard": table["shard"].slice(0, 1),
                         "data": pa.array([pickle.dumps((shard, beside))], pa.binary())})

    return frequent.withColumn("shard", shard_of_key(F.col("low"), shards)).groupBy("shard").applyInArrow(
        one, "shard int, data binary")


class Index:
    """Some shards of the index, as broadcast."""

    def __init__(self, shards: int, parts: list[tuple[int, bytes]]):
        self.shards = shards
        self.parts = {shard: pickle.loads(data) for shard, data in parts}

    def dropped(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Which lines have a frequent key of these shards that another, larger id holds."""
        out = np.zeros(len(high), bool)
        shard = ((low >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)
        for number in np.unique(shard):
            if int(number) not in self.parts:
                continue
            table, beside = self.parts[int(number)]
            mine = np.flatnonzero(shard == number)
            at = table.find(high[mine], low[mine])
            mine, at, missed = mine[at >= 0], at[at >= 0], mine[at < 0]
            holds = np.where(table.no_id[at], no_id[mine], ~no_id[mine] & (table.last[at] == ids[mine]))
            out[mine] = ~holds
            for i in missed if beside else ():
                if (found := beside.get((int(high[i]), int(low[i])))) is not None:
                    out[i] = not (no_id[i] if found[1] else not no_id[i] and found[0] == ids[i])
        return out


def _keep_lines(texts: list[bytes], ids: pa.Array, known: list, index: Index, min_chars: int) -> list[tuple]:
    """(lines, numbers of dropped lines, kept text) for each text."""
    scanned = [line_hashes(t, min_chars) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(found) for _, found in scanned])
    line = [i for _, found in scanned for i in found]
    halves = [h for _, found in scanned for h in found.values()]
    high, low = (np.array([h[k] for h in halves], np.uint64) for k in (0, 1))
    no_id = ids.is_null().to_numpy(zero_copy_only=False)[owner]
    drop = index.dropped(high, low, ids.fill_null(0).to_numpy()[owner], no_id)
    gone: dict[int, set[int]] = {t: set(k) for t, k in enumerate(known) if k}
    for at in np.flatnonzero(drop):
        gone.setdefault(int(owner[at]), set()).add(line[at])
    out = []
    for t, (text, (n, _)) in enumerate(zip(texts, scanned)):
        lost = gone.get(t, ())
        kept = text if not lost else b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in lost)
        out.append((n, sorted(lost), kept))
    return out


def drop_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = 40,
               min_docs: int = 5, slice_keys: int = 1_000_000) -> DataFrame:
    """All documents with ``n_lines``, ``n_dropped`` and the text without dropped lines."""
    spark = docs.sparkSession
    frequent = cut(line_counts(docs, id_column, text, min_chars).filter(F.col("docs") >= min_docs), "line-counts")
    n = frequent.count()
    shards = max(1, -(-n // SHARD_KEYS))
    slices = max(1, -(-n // slice_keys))
    index = cut(build_index(frequent, shards), "line-index")
    result = docs.withColumn("__lines", F.lit(None).cast(LINES))
    for k in range(slices):
        mine = index.filter(F.col("shard") % slices == k)
        held = spark.sparkContext.broadcast([(r["shard"], bytes(r["data"])) for r in mine.collect()])
        if k:
            result = cut(result, "line-pass")
        result = result.withColumn("__lines", _probe(held, shards, min_chars)(
            F.col(text), F.col(id_column).cast("long"), F.col("__lines")["dropped"]))
    return result.withColumns({
        "n_lines": F.col("__lines")["n_lines"],
        "n_dropped": F.size(F.col("__lines")["dropped"]).cast("long"),
        text: F.col("__lines")["kept"],
    }).drop("__lines")


def _probe(held, shards: int, min_chars: int):
    cache: list[Index] = []

    def over(text: pa.Array, ids: pa.Array, known: pa.Array) -> pa.Array:
        if not cache:
            cache.append(Index(shards, held.value))
        rows = []
        texts, before = encoded(text), known.to_pylist()
        for begin, part in pieces(texts):
            end = begin + len(part)
            rows += _keep_lines(part, ids.slice(begin, len(part)), before[begin:end], cache[0], min_chars)
        n, dropped, kept = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(dropped, pa.list_(pa.int32())),
             pa.array(kept, pa.binary()).view(pa.string())], ["n_lines", "dropped", "kept"])

    return F.arrow_udf(over, LINES)
