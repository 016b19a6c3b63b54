"""Benchmark decontamination with a broadcast hash set of normalised word n-grams.

Texts are lower-cased (A-Z) and cut into words; every ``size`` consecutive words of a
benchmark item are a window (an item with fewer words is one window). Document windows of
the same lengths are hashed and looked up in the set; each hit is verified as bytes.

The set is broadcast in slices of at most ``slice_pairs`` (window, item) pairs, counted
first: normally one slice and one pass. More slices mean more passes, with the documents
and what was found so far written in between; no slice is ever larger.

Defined results: null or empty texts have no word and are clean; an item whose id is null
marks words but is not listed; repeated items count once; repeated documents are judged
each for itself; empty tables are fine. Other columns are kept; names that begin with two
underscores are the operator's own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemap.llm.common import cut, encoded, pieces
from ripplemap.llm.wordscan import covered, joined, mix, window_hashes, word_hashes, word_table, words

WORD = word_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
FILTER_BITS = 20
MARKS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("cuts", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class Scan(NamedTuple):
    """Words of several texts: hashes, places in the texts, and squeezed to one blank each."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    squeezed: bytes
    at: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words
    texts: np.ndarray  # where each text starts


def scan(texts: list[bytes]) -> Scan:
    buffer, text_starts = joined(texts)
    buffer = LOWER[buffer]
    starts, ends = words(buffer, WORD)
    keep = WORD[buffer]
    keep[ends] = True
    squeezed = np.where(WORD[buffer], buffer, np.uint8(0x20))[keep].tobytes()
    at = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    first = np.concatenate((np.searchsorted(starts, text_starts), [len(starts)]))
    return Scan(word_hashes(buffer, starts, ends), starts, ends, squeezed, at, first, text_starts)


def item_windows(items: DataFrame, size: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window binary, length int, item string) of all items."""

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for begin, part in pieces(texts):
                s, rows = scan(part), []
                for t in range(len(part)):
                    a, b = int(s.first[t]), int(s.first[t + 1])
                    n = min(size, b - a)
                    rows += [(s.squeezed[s.at[i]:s.at[i + n] - 1], n, ids[begin + t])
                             for i in range(a, b - n + 1) if n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in
                     enumerate((pa.binary(), pa.int32(), pa.string()))], ["window", "length", "item"])

    picked = items.select(F.col(id_column).cast("string").alias("item"), F.col(text).alias("text"))
    return picked.mapInArrow(cut_windows, "window binary, length int, item string").distinct()


class WindowSet:
    """Windows of one slice: per length sorted hashes behind a small bit filter."""

    def __init__(self, pairs: list[tuple[bytes, int, str | None]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        lengths: dict[int, set[bytes]] = defaultdict(set)
        for window, n, item in pairs:
            lengths[n].add(window)
            if item is not None:
                self.items[window].append(item)
        self.by_length = {}
        for n, found in lengths.items():
            found = sorted(found)
            h = np.concatenate([self._hash(part, n) for _, part in pieces(found)])
            table = np.zeros(1 << FILTER_BITS, bool)
            table[h >> np.uint64(64 - FILTER_BITS)] = True
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (table, h[order], [found[i] for i in order])

    @staticmethod
    def _hash(found: list[bytes], n: int) -> np.ndarray:
        s = scan(found)
        return mix(window_hashes(s.hashes, n)[s.first[:-1]])

    def hits(self, s: Scan) -> Iterator[tuple[int, int, bytes]]:
        """(first word, length, window) wherever a window occurs within one text."""
        text_of = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
        for n, (table, hashes, found) in self.by_length.items():
            h = mix(window_hashes(s.hashes, n))
            near = np.flatnonzero(table[h >> np.uint64(64 - FILTER_BITS)])
            near = near[text_of[near] == text_of[near + n - 1]]
            left = np.searchsorted(hashes, h[near], "left")
            right = np.searchsorted(hashes, h[near], "right")
            for i, a, b in zip(near.tolist(), left.tolist(), right.tolist()):
                for k in range(a, b):
                    if s.squeezed[s.at[i]:s.at[i + n] - 1] == found[k]:
                        yield i, n, found[k]


def _intervals(flags: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


def _mark(texts: list[bytes], windows: WindowSet, known: list[dict | None]) -> list[dict]:
    """Spans of hit words, the same spans as text bytes, and items, for each text."""
    out = []
    for begin, part in pieces(texts):
        s = scan(part)
        found = list(windows.hits(s))
        starts = np.array([i for i, _, _ in found], np.int64)
        flags = covered(starts, starts + np.array([n for _, n, _ in found], np.int64), len(s.starts))
        items: dict[int, set[str]] = defaultdict(set)
        if found:
            for t, (_, _, window) in zip((np.searchsorted(s.first, starts, "right") - 1).tolist(), found):
                items[t].update(windows.items[window])
        for t in range(len(part)):
            a, b = int(s.first[t]), int(s.first[t + 1])
            own, before = flags[a:b], known[begin + t]
            for x, y in before["spans"] if before else ():
                own[x:y] = True
            spans = _intervals(own)
            out.append({
                "n_words": b - a, "spans": spans,
                "cuts": [[int(s.starts[a + x] - s.texts[t]), int(s.ends[a + y - 1] - s.texts[t])] for x, y in spans],
                "items": sorted(items[t].union(before["items"] if before else ())),
            })
    return out


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text", size: int = 10,
                       item_id: str = "item_id", item_text: str = "text",
                       slice_pairs: int = 500_000) -> DataFrame:
    """Add ``__marks``: words, spans of hit words, the same spans in bytes, items hit."""
    pairs = cut(item_windows(items, size, item_id, item_text), "benchmark-windows")
    slices = max(1, -(-pairs.count() // slice_pairs))
    marked = docs
    for k in range(slices):
        mine = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == k)
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        marked = _pass(marked if k == 0 else cut(marked, "decontaminate-pass"), held, text, k > 0)
    return marked


def _pass(docs: DataFrame, held, text: str, again: bool) -> DataFrame:
    kind = T._parse_datatype_string(MARKS.simpleString())
    cache: list[WindowSet] = []

    def windows() -> WindowSet:
        if not cache:
            cache.append(WindowSet([(bytes(w), n, i) for w, n, i in held.value]))
        return cache[0]

    def first(column: pa.Array) -> pa.Array:
        return pa.array(_mark(encoded(column), windows(), [None] * len(column)), ARROW_MARKS)

    def more(column: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array(_mark(encoded(column), windows(), known.to_pylist()), ARROW_MARKS)

    if again:
        return docs.withColumn("__marks", F.arrow_udf(more, kind)(F.col(text), F.col("__marks")))
    return docs.withColumn("__marks", F.arrow_udf(first, kind)(F.col(text)))


_SPANS = pa.list_(pa.list_(pa.int64()))
ARROW_MARKS = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("cuts", _SPANS), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """All documents with ``n_words``, ``n_hit``, ``items`` and ``contaminated``."""
    spans = F.col("__marks")["spans"]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    marked = mark_contamination(docs, items, **options)
    return marked.select(
        *docs.columns, F.col("__marks")["n_words"].alias("n_words"), hit.alias("n_hit"),
        F.col("__marks")["items"].alias("items"), (F.size(spans) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, action: str = "documents", text: str = "text",
                  **options) -> DataFrame:
    """Clean documents only, or (``action="spans"``) all documents without the hit words."""
    marked = mark_contamination(docs, items, text=text, **options)
    cuts = F.col("__marks")["cuts"]
    if action == "documents":
        return marked.filter(F.size(cuts) == 0).drop("__marks")
    if action != "spans":
        raise ValueError(action)
    data = F.col(text).cast("binary")
    kept = F.aggregate(
        cuts, F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.substring(data, (s["at"] + 1).cast("int"), (c[0] - s["at"]).cast("int"))).alias("out"),
            c[1].alias("at")),
        lambda s: F.concat(s["out"], F.substring(data, (s["at"] + 1).cast("int"), F.octet_length(data))))
    cleaned = F.when(F.size(cuts) == 0, F.col(text)).otherwise(F.decode(kept, "UTF-8"))
    return marked.withColumn(text, cleaned).drop("__marks").select(*docs.columns)
