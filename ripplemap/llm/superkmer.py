"""Substring dedup over word windows by super-k-mer partitioning.

A window is ``size`` consecutive words of a document. Its minimiser is the least hash of the
``k``-word strings inside it. Consecutive windows that share a minimiser form a super-k-mer:
one packed string (the words, one blank apart) that travels to the minimiser's bucket, where
sorting its windows tells the least document id of each exactly.

* First pass: only minimisers and ids are shuffled (pre-aggregated). One that occurs in
  documents of one id cannot hide a repeated window; the others are kept as a fixed-size
  bit table (see ``anchors``).
* Second pass: super-k-mers whose minimiser is repeated travel. Equal strings are one row
  before they reach a bucket, so copies cost nothing there. The windows of a minimiser found
  in over ``hot`` documents travel each for itself, in the bucket of their own hash: a
  passage that a third of all documents share is many small buckets, not one.
* The verdicts go back to the occurrences by the string's 128-bit hash, and to the texts by
  document.

Defined results: a null text has no word; a null id comes after all others, and neither two
null ids nor two rows with one id remove from each other; repeated rows are treated alike;
an empty table stays empty; other columns are kept; names that begin with two underscores
are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.anchors import bit_table, has_bit, owner
from ripplemap.llm.common import cut, encoded, pieces, text_digest
from ripplemap.llm.wordscan import SPACED, covered, joined, mix, runs, sliding, window_hashes, word_hashes, words

#: Words of the strings that minimisers are chosen from.
K = 16
#: Documents of one minimiser that still share a bucket.
HOT = 4_096
RESULT = "struct<n_words:bigint,n_removed:bigint,kept:binary>"


def _windows(part: list[bytes], size: int, k: int):
    """Words of some texts, and the minimiser of each window, with the windows within one text."""
    buffer, text_starts = joined(part)
    starts, ends = words(buffer, SPACED)
    first = np.concatenate((np.searchsorted(starts, text_starts), [len(starts)]))
    text_of = np.repeat(np.arange(len(part)), np.diff(first))
    h = word_hashes(buffer, starts, ends)
    least = sliding(mix(window_hashes(h, k)), size - k + 1)
    inside = text_of[:len(least)] == text_of[size - 1:] if len(least) else np.zeros(0, bool)
    return buffer, starts, ends, first, text_of, least, inside


def _super_kmers(least: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and window behind the last of each run with one minimiser in one text."""
    begin, end = runs(np.where(inside, least, 0) + inside)
    good = inside[begin] if len(begin) else np.zeros(0, bool)
    return begin[good], end[good]


def repeated_minimisers(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(h, n): minimisers of documents with at least two ids; ``docs`` has __owner, __text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(0).to_numpy()
            for at, part in pieces(encoded(batch.column(1))):
                _, _, _, _, text_of, least, inside = _windows(part, size, k)
                begin, _ = _super_kmers(least, inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[begin].view(np.int64)), pa.array(owners[at + text_of[begin]])], ["h", "id"])

    found = docs.select("__owner", "__text").mapInArrow(emit, "h long, id long")
    counts = found.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    return counts.filter("low < high").select("h", "n")


def super_kmers(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray, size: int, k: int) -> DataFrame:
    """Occurrences (bucket, key, packed, id, digest, first, n) of strings that may repeat."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, hot))
    schema = "bucket long, key binary, packed binary, id long, digest binary, first int, n int"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = sent.value
        for batch in batches:
            owners, digests = batch.column(0).to_numpy(), batch.column(2)
            for at, part in pieces(encoded(batch.column(1))):
                buffer, starts, ends, first, text_of, least, inside = _windows(part, size, k)
                begin, end = _super_kmers(least, inside)
                going = has_bit(repeated, least[begin])
                begin, end = begin[going], end[going]
                alone = has_bit(hot, least[begin])
                single = np.concatenate([np.arange(b, e) for b, e in zip(begin[alone], end[alone])] or [begin[:0]])
                begin = np.concatenate((begin[~alone], single))
                end = np.concatenate((end[~alone], single + 1))
                n_shared = int((~alone).sum())
                keep = SPACED[buffer]
                keep[ends] = True
                squeezed = np.where(SPACED[buffer], buffer, np.uint8(0x20))[keep].tobytes()
                place = np.concatenate(([0], np.cumsum(ends - starts + 1)))
                strings = [squeezed[a:b - 1] for a, b in
                           zip(place[begin].tolist(), place[end + size - 1].tolist())]
                keys = [xxhash.xxh3_128_digest(s) for s in strings]
                bucket = least[begin].view(np.int64).copy()
                bucket[n_shared:] = np.frombuffer(b"".join(x[:8] for x in keys[n_shared:]), np.int64)
                text = text_of[begin]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), pa.array(keys, pa.binary()), pa.array(strings, pa.binary()),
                    pa.array(owners[at + text]), digests.take(pa.array(at + text)),
                    pa.array((begin - first[text]).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                    ["bucket", "key", "packed", "id", "digest", "first", "n"])

    return docs.select("__owner", "__text", "__digest").mapInArrow(emit, schema)


def least_ids(strings: DataFrame, size: int) -> DataFrame:
    """(key, least): the least id of each window of each distinct string, bucket by bucket.

    ``strings`` has bucket, key, packed, low and high (the ids that have the string). The
    windows of a bucket are sorted, and the first of equal ones has the least id. Strings in
    which no window is older than all of its holders are left out.
    """

    def flush(held: list[tuple]) -> Iterator[tuple[bytes, list[int]]]:
        if len(held) == 1:
            key, packed, low, high = held[0]
            if low < high:
                yield key, [low] * (packed.count(b" ") + 2 - size)
            return
        rows, least = [], []
        for number, (_, packed, low, _) in enumerate(held):
            blanks = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
            begin = [0, *(blanks + 1).tolist()]
            end = [*blanks.tolist(), len(packed)]
            n = len(begin) - size + 1
            rows += [(packed[begin[i]:end[i + size - 1]], low, number, i) for i in range(n)]
            least.append([low] * n)
        rows.sort()  # equal windows stand together, the least id first
        window, first = None, 0
        for w, low, number, i in rows:
            if w != window:
                window, first = w, low
            least[number][i] = first
        for (key, _, _, high), found in zip(held, least):
            if min(found) < high:
                yield key, found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, out = [], None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if b != bucket:
                    out += flush(held) if held else ()
                    held, bucket = [], b
                held.append(tuple(row))
            yield _least_batch(out)
            out = []
        yield _least_batch(list(flush(held)) if held else [])

    return strings.select("bucket", "key", "packed", "low", "high").repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(count, "key binary, least array<bigint>")


def _least_batch(rows: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
        ["key", "least"])


def repeated_windows(docs: DataFrame, size: int = 50, k: int = K, hot: int = HOT) -> DataFrame:
    """(__owner, __digest, windows): first words of the windows that a smaller id has too."""
    minimisers = cut(repeated_minimisers(docs, size, k), "minimisers")
    repeated = bit_table(minimisers, "h")
    crowded = bit_table(minimisers.filter(F.col("n") > hot), "h")
    found = cut(super_kmers(docs, repeated, crowded, size, k), "super-kmers")
    strings = found.groupBy("bucket", "key", "packed").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    verdicts = least_ids(strings, size)
    windows = F.filter(
        F.transform(F.col("least"), lambda low, i: F.when(low < F.col("id"), F.col("first") + i)),
        lambda w: w.isNotNull())
    hits = found.select("key", "id", "digest", "first").join(verdicts, "key").select(
        "id", "digest", windows.alias("windows")).filter(F.size("windows") > 0)
    return hits.groupBy(F.col("id").alias("__owner"), F.col("digest").alias("__digest")).agg(
        F.flatten(F.collect_list("windows")).alias("windows"))


def _cut_words(texts: list[bytes], windows: list, size: int) -> list[tuple[int, int, bytes]]:
    out = []
    for at, part in pieces(texts):
        for text, hits in zip(part, windows[at:at + len(part)]):
            w = text.split()
            if hits is None or not len(hits):
                out.append((len(w), 0, b" ".join(w)))
                continue
            begin = np.asarray(hits, np.int64)
            gone = covered(begin, begin + size, len(w))
            out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone.tolist()) if not g)))
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 50,
                   k: int = K, hot: int = HOT) -> DataFrame:
    """All documents with ``n_words``, ``n_removed`` and ``kept_text`` (words one blank apart)."""
    keyed = docs.withColumns({
        "__owner": owner(id_column), "__text": F.coalesce(F.col(text), F.lit("")), "__digest": text_digest(text)})
    windows = repeated_windows(keyed.select("__owner", "__text", "__digest"), size, k, hot)

    def over(column: pa.Array, hits: pa.Array) -> pa.Array:
        rows = _cut_words(encoded(column), hits.to_pylist(), size)
        n, removed, kept = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            ["n_words", "n_removed", "kept"])

    result = F.arrow_udf(over, RESULT)(F.col("__text"), F.col("windows"))
    return keyed.join(windows, ["__owner", "__digest"], "left").withColumn("__r", result).select(
        *docs.columns, F.col("__r")["n_words"].alias("n_words"), F.col("__r")["n_removed"].alias("n_removed"),
        F.decode(F.col("__r")["kept"], "UTF-8").alias("kept_text"))
