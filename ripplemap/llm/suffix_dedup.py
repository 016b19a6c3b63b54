"""Suffix-array dedup by distributed prefix doubling: bytes that a repeated string covers go.

A position's rank names the string that starts there: equal ranks, equal strings. From ranks
of strings of length L, the pair (rank here, rank d bytes on) names strings of length L + d;
Spark sorts the pairs with their positions, positions in a group get the group's first
position as their new rank, and unique positions are dropped: nothing that starts there can
repeat at any greater length. Offsets grow until the strings have ``size`` bytes.

Only positions whose fate is open are ranked:

* A repeated string of ``size`` bytes has a repeated anchor, the least hash among its strings
  of ``seed`` bytes (see ``anchors``). A first pass finds repeated anchors.
* Consecutive windows with one repeated anchor are a *stretch*. A second pass lists stretches
  by a 128-bit hash of their bytes. A stretch found twice is repeated as a whole; one whose
  anchor has no other stretch, and only one place in it, is not repeated at all.
* A third pass sends the bytes of each distinct stretch of the other anchors once. Ranks
  start with hashes of ``seed`` bytes; the first pair is 128 bits, later ranks are exact.
* Equal windows have their anchor at the same place, so every eighth position, counted from the
  anchor, is ranked: for the core that eight neighbouring windows share. The last step
  lengthens repeated cores to windows by their surrounding bytes, exactly (``repeated_starts``).

Equal texts are one text with a number of copies, and equal stretches one stretch, so groups
of copies cost nothing in the sorts. Positions are numbers in one address space: a stretch
starts at a multiple of ``BLOCK`` and leaves a gap of ``size``, so a rank ``d`` bytes on is an
equi-join and a position finds its stretch by its block. A sorted group is streamed in Arrow
batches; no group is held in memory. Anchors with very many bytes of stretches have no sort: their
pairs are counted before the shuffle and ranks joined back on salts (``rerank_hot``). Each step ends in a written table, and what it no longer
needs is removed, so pairs, stretches and texts are never on disk together.

Defined results: a null text is empty; a text with a copy is repeated as a whole, if it is
long enough; repeated rows are copies; an empty table stays empty; other columns are kept;
names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.anchors import bit_table, has_bit
from ripplemap.llm.common import cut, discard, encoded, pieces
from ripplemap.llm.wordscan import BYTE_VALUES, covered, joined, mix, runs, sliding, window_hashes
from ripplemap.operators.skew import SALTS, join_back, key_rows, with_salt

#: Addresses are dealt in blocks; the starts found in a block are one row.
BLOCK = 1_024
SHIFT = BLOCK.bit_length() - 1
#: A longer text is worked on in parts that overlap by one window.
PART_BYTES = 4 << 20
#: Anchors whose distinct stretches hold more bytes may have classes of very many positions.
HOT_BYTES = 1 << 20
#: Bits of the table of such anchors; one set by chance only chooses the other way to the same ranks.
HOT_BITS = 20
RESULT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def _parts(texts: list[bytes], size: int) -> tuple[list[int], list[int], list[bytes]]:
    """Text number, place and bytes of parts that hold every window once."""
    owner, offset, out = [], [], []
    for t, text in enumerate(texts):
        if len(text) < size:
            continue
        for at in range(0, len(text) - size + 1, PART_BYTES):
            owner.append(t)
            offset.append(at)
            out.append(text if len(text) <= PART_BYTES else text[at:at + PART_BYTES + size - 1])
    return owner, offset, out


class Anchored(NamedTuple):
    """Some texts: where each starts, seed hashes, and each window's anchor if it is in one text."""

    starts: np.ndarray
    hashes: np.ndarray
    least: np.ndarray
    inside: np.ndarray


def _anchored(part: list[bytes], size: int, seed: int) -> Anchored:
    buffer, starts = joined(part)
    h = mix(window_hashes(BYTE_VALUES[buffer], seed))
    least = sliding(h, size - seed + 1)
    inside = covered(starts, starts + np.array([len(p) for p in part]) - size + 1, len(least))
    return Anchored(starts, h, least, inside)


def _places(a: Anchored, size: int, seed: int) -> np.ndarray:
    """Positions that are the anchor of a window."""
    edge = np.zeros(size - seed, np.uint64)
    most = sliding(np.concatenate((edge, np.where(a.inside, a.least, 0), edge)), size - seed + 1, np.maximum)
    return np.flatnonzero(most == a.hashes)


def repeated_anchors(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(h) of anchors that different texts, or two places of one text, have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            owner, _, parts = _parts(encoded(batch.column(2)), size)
            several = np.bincount(owner, minlength=batch.num_rows)[owner] > 1 if owner else np.zeros(0, bool)
            for at, part in pieces(parts):
                a = _anchored(part, size, seed)
                place = _places(a, size, seed)
                text = np.searchsorted(a.starts, place, "right") - 1
                order = np.lexsort((a.hashes[place], text))
                value, text = a.hashes[place][order], text[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.concatenate((begin, [len(value)])))
                text, value = at + text[begin], value[begin]
                of = np.asarray(owner, np.int64)[text]
                # a number for the text, another one for each anchor; both it and its complement if twice
                mark = high[of] ^ low[of] * (value << np.uint64(1) | np.uint64(1))
                twice = (times > 1) | several[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((value, value[twice])).view(np.int64)),
                     pa.array(np.concatenate((mark, ~mark[twice])).view(np.int64))], ["h", "mark"])

    found = docs.select("__hi", "__lo", "__text").mapInArrow(emit, "h long, mark long")
    marks = found.groupBy("h").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
    return marks.filter("a <> b").select("h")


def _stretches(a: Anchored, table: np.ndarray, size: int, seed: int):
    """First window, window behind the last and text of each stretch, and if its anchor is in it again."""
    begin, end = runs(np.where(a.inside, a.least, 0) + a.inside)
    if len(begin):
        good = a.inside[begin] & has_bit(table, a.least[begin])
        begin, end = begin[good], end[good]
    place = _places(a, size, seed)
    first = np.searchsorted(place, begin)
    n = np.searchsorted(place, end + size - seed) - first
    stretch = np.repeat(np.arange(len(begin)), n)
    member = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    same = a.hashes[place[member]] == a.least[begin][stretch]
    again = np.bincount(stretch[same], minlength=len(begin)) > 1
    return begin, end, np.searchsorted(a.starts, begin, "right") - 1, again


def stretches(docs: DataFrame, repeated: np.ndarray, size: int, seed: int) -> DataFrame:
    """Distinct (anchor, key, again, hi, lo, start, n) of all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated)
    schema = "anchor long, key binary, again boolean, hi long, lo long, start int, n int"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, offset, parts = _parts(encoded(batch.column(2)), size)
            for at, part in pieces(parts):
                a = _anchored(part, size, seed)
                begin, end, text, again = _stretches(a, sent.value, size, seed)
                local = begin - a.starts[text]
                keys = [xxhash.xxh3_128_digest(part[t][i:i + n + size - 1])
                        for t, i, n in zip(text.tolist(), local.tolist(), (end - begin).tolist())]
                of = pa.array(np.asarray(owner, np.int64)[at + text])
                yield pa.RecordBatch.from_arrays([
                    pa.array(a.least[begin].view(np.int64)), pa.array(keys, pa.binary()), pa.array(again),
                    batch.column(0).take(of), batch.column(1).take(of),
                    pa.array((np.asarray(offset, np.int64)[at + text] + local).astype(np.int32)),
                    pa.array((end - begin).astype(np.int32))], schema_names(schema))

    return docs.select("__hi", "__lo", "__text").mapInArrow(emit, schema).distinct()


def schema_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def open_stretches(docs: DataFrame, unsettled: np.ndarray, hot: np.ndarray, size: int, seed: int) -> DataFrame:
    """(key, data, hot, base): the bytes of each distinct stretch of these anchors, with an address."""
    sent = docs.sparkSession.sparkContext.broadcast(unsettled)
    crowded = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, parts = _parts(encoded(batch.column(0)), size)
            found: dict[bytes, tuple[bytes, bool]] = {}
            for _, part in pieces(parts):
                a = _anchored(part, size, seed)
                begin, end, text, _ = _stretches(a, sent.value, size, seed)
                many = has_bit(crowded.value, a.least[begin]).tolist()
                for t, i, n, h in zip(text.tolist(), (begin - a.starts[text]).tolist(), (end - begin).tolist(), many):
                    data = part[t][i:i + n + size - 1]
                    found[xxhash.xxh3_128_digest(data)] = data, h
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([d for d, _ in found.values()], pa.binary()),
                 pa.array([h for _, h in found.values()], pa.bool_())], ["key", "data", "hot"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = TaskContext.get().partitionId() << 42
        for batch in batches:
            lengths = np.array([len(d) for d in batch.column(1).to_pylist()], np.int64)
            room = -(-(lengths + size) // BLOCK) * BLOCK
            base = free + np.cumsum(room) - room
            free += int(room.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base)], ["key", "data", "hot", "base"])

    once = docs.select("__text").mapInArrow(emit, "key binary, data binary, hot boolean").distinct()
    return cut(once.mapInArrow(number, "key binary, data binary, hot boolean, base long"), "stretches")


class Grid(NamedTuple):
    """Positions of a stretch are ranked at every ``every``-th byte from its anchor on.

    A window of ``size`` bytes holds the ``core`` bytes behind the first such position, and
    ``rest`` = size - core bytes around them, which fit a long.
    """

    size: int
    seed: int
    every: int
    core: int
    rest: int


def grid(size: int, seed: int) -> Grid:
    """The widest grid whose rest fits eight bytes; with few bytes beside the seed, all positions."""
    for every in (8, 4):
        beside = size - seed - every + 1
        if seed >= every and beside >= 0:
            core = seed + beside // every * every
            if size - core <= 8:
                return Grid(size, seed, every, core, size - core)
    return Grid(size, seed, 1, size, 0)


def _step(length: int, g: Grid) -> int:
    return min(length, g.core - length) // g.every * g.every


def _first_pairs(found: DataFrame, g: Grid) -> DataFrame:
    """(a, b, at): hashes of the seed at each position of the grid and one step on.

    The first also holds the anchor, so neighbouring stretches that share bytes don't match.
    """
    step = _step(g.seed, g)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = batch.column(1).to_numpy()
            for at, part in pieces(encoded(batch.column(0)), 256 << 10):
                buffer, starts = joined(part)
                lengths = np.array([len(p) for p in part])
                h = mix(window_hashes(BYTE_VALUES[buffer], g.seed))
                inside = covered(starts, starts + lengths - g.seed + 1, len(h))
                masked = np.where(inside, h, np.uint64((1 << 64) - 1))
                least = np.minimum.reduceat(masked, starts)
                of = np.concatenate(([0], np.repeat(np.arange(len(part)), lengths + 1)))[:len(h)]
                anchor = np.flatnonzero(inside & (h == least[of]))
                chains = np.unique(of[anchor] * g.every + (anchor - starts[of[anchor]]) % g.every)
                chain_of, from_ = chains // g.every, chains % g.every
                n = np.maximum((lengths[chain_of] - g.seed - step - from_) // g.every + 1, 0)
                of = np.repeat(chain_of, n)
                local = np.repeat(from_, n) + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * g.every
                place = starts[of] + local
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h[place] ^ mix(least)[of]).view(np.int64)), pa.array(h[place + step].view(np.int64)),
                     pa.array(bases[at + of] + local)], ["a", "b", "at"])

    return found.select("data", "base").mapInArrow(emit, "a long, b long, at long")


def rerank(pairs: DataFrame) -> DataFrame:
    """(at, rank): equal pairs share the first position's number as rank; unique ones go."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, single = None, 0, False  # of the last group so far
        for batch in batches:
            a, b, at = (batch.column(i).to_numpy() for i in range(3))
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            begin = np.flatnonzero(new)
            size, first = np.diff(np.concatenate((begin, [len(a)]))), at[begin].copy()
            many, held = size > 1, []
            if key == (a[0], b[0]):
                held, first[0], many[0] = [rank] if single else [], rank, True
            group = np.cumsum(new) - 1
            keep = many[group]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((np.array(held, np.int64), at[keep]))),
                 pa.array(np.concatenate((np.array(held, np.int64), first[group][keep])))], ["at", "rank"])
            key, rank, single = (a[-1], b[-1]), int(first[-1]), not many[-1]

    return pairs.repartition("a", "b").sortWithinPartitions("a", "b", "at").mapInArrow(name, "at long, rank long")


def rerank_hot(pairs: DataFrame) -> DataFrame:
    """What ``rerank`` gives, for classes of very many positions: no class goes to one task.

    Members are counted before the shuffle, and the rank comes back to them by salts of their places.
    """
    rows = cut(pairs, "hot-pairs")
    salted = with_salt(rows, ["at"])
    named = key_rows(salted, ["a", "b"], F.count("*").alias("times"), F.min("at").alias("rank")).filter("times > 1")
    ranked = cut(join_back(salted, named.drop("times"), ["a", "b"]).select("at", "rank"), "hot-ranks")
    discard(rows)
    return ranked


def _ranked_cores(found: DataFrame, g: Grid, rerank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    length = g.seed + _step(g.seed, g)
    ranked = rerank(_first_pairs(found, g))
    while length < g.core:
        ranked, step = cut(ranked, "ranks"), _step(length, g)
        behind = ranked.select((F.col("at") - step).alias("at"), F.col("rank").alias("b"))
        ranked = rerank(ranked.withColumnRenamed("rank", "a").join(behind, "at").select("a", "b", "at"))
        length += step
    return ranked


def repeated_cores(found: DataFrame, g: Grid) -> DataFrame:
    """(at, rank): positions of the grid whose ``core`` bytes start at another one too.

    A class has one anchor, so all its members lie in hot stretches or none.
    """
    return cut(_ranked_cores(found.filter("NOT hot"), g, rerank), "cores").union(
        _ranked_cores(found.filter("hot"), g, rerank_hot))


def _little_endian(data: np.ndarray, places: np.ndarray, offsets: range) -> np.ndarray:
    """Bytes at these offsets from the places as one number, the first one lowest; zero outside."""
    out = np.zeros(len(places), np.uint64)
    for j, offset in enumerate(offsets):
        at = places + offset
        good = (at >= 0) & (at < len(data))
        out[good] |= data[at[good]].astype(np.uint64) << np.uint64(8 * j)
    return out


def _surroundings(cores: DataFrame, found: DataFrame, g: Grid) -> DataFrame:
    """(rank, before, behind, at): a core's surroundings, all that its windows hold.

    ``before`` has the bytes before the core, the nearest lowest, and in its top byte the first
    and last number of bytes before the core with which a window lies in the stretch.
    """
    places = cores.groupBy(F.shiftright("at", SHIFT).alias("block")).agg(F.collect_list(F.struct(
        F.col("at").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("place"), "rank")).alias("ranked"))
    skipped = (F.col("block") - F.col("from")) * BLOCK
    begin = F.greatest(F.lit(0), skipped - g.every)
    slices = _blocks(found, F.col("data"), F.octet_length("data").alias("length")).select(
        "block", skipped.alias("skipped"), begin.alias("begin"), "length",
        F.substr("data", (begin + 1).cast("int"), F.lit(BLOCK + 2 * (g.size + g.every))).alias("slice"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            block, skip, start, length = (c.to_numpy() for c in columns[:4])
            ranked = columns[5]
            owner = np.repeat(np.arange(len(block)), ranked.value_lengths().to_numpy())
            of_place, rank = (f.to_numpy() for f in ranked.flatten().flatten())
            data, starts = joined(encoded(columns[4]))
            local = skip[owner] + of_place
            at = starts[owner] + local - start[owner]
            last = np.minimum(g.every - 1, local)
            first = np.maximum(0, local - (length[owner] - g.size))
            before = _little_endian(data, at, range(-1, -g.every, -1))
            behind = _little_endian(data, at, range(g.core, g.size))
            # what lies outside the stretch belongs to no window of it
            before &= (np.uint64(1) << (8 * last).astype(np.uint64)) - np.uint64(1)
            used = np.maximum(g.rest - first, 0).astype(np.uint64)
            behind &= np.where(used < 8, (np.uint64(1) << (np.uint64(8) * (used % np.uint64(8)))) - np.uint64(1),
                               np.uint64((1 << 64) - 1))
            before |= (first * 16 + last).astype(np.uint64) << np.uint64(56)
            good = first <= last
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank[good]), pa.array(before[good].view(np.int64)), pa.array(behind[good].view(np.int64)),
                 pa.array((block[owner] * BLOCK + of_place)[good])], ["rank", "before", "behind", "at"])

    return slices.join(places, "block").select("block", "skipped", "begin", "length", "slice", "ranked").mapInArrow(
        emit, "rank long, before long, behind long, at long")


def repeated_starts(found: DataFrame, g: Grid) -> DataFrame:
    """(at, mask): bit i is set if the window that starts i bytes before ``at`` starts elsewhere too.

    Cores with equal surroundings have all their windows in common. Windows are compared one by
    one only between different surroundings of one core, where matches begin and end.
    """
    cores = repeated_cores(found, g)
    if g.every == 1:
        return cores.select("at", F.lit(1).alias("mask"))
    key = ["rank", "before", "behind"]
    rows = cut(_surroundings(cores, found, g), "surroundings")
    discard(cores)
    # what a third of all rows may share is spread over salts of their places
    salted = with_salt(rows, ["at"])
    kinds = cut(key_rows(salted, key, F.count("*").alias("times")), "kinds")
    first = F.shiftrightunsigned("before", 60).cast("int")
    last = F.shiftrightunsigned("before", 56).bitwiseAND(F.lit(15)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    several = kinds.groupBy("rank").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    bits = F.col("i") * 8
    near = F.col("before").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    far = F.call_function("shiftleft", F.call_function("shiftleft", F.col("behind"), F.lit(8 * (8 - g.rest))), bits)
    windows = kinds.join(several, "rank", "left_semi").withColumn("i", F.explode(F.sequence(first, last))).select(
        *key, "i", near.bitwiseOR(far).alias("around"))
    windows = cut(windows, "windows")
    again = windows.groupBy("rank", "i", "around").agg(F.count("*").alias("n")).filter("n > 1")
    matched = windows.join(again, ["rank", "i", "around"], "left_semi").select(*key, bit.alias("mask"))
    all_bits = F.call_function("shiftleft", F.lit(1), last + 1) - F.call_function("shiftleft", F.lit(1), first)
    masks = matched.union(kinds.filter("times > 1").select(*key, all_bits.alias("mask"))).groupBy(key).agg(
        F.bit_or("mask").alias("mask"))
    starts = cut(join_back(salted, masks.join(kinds.select(*key, SALTS), key), key).select("at", "mask"), "starts")
    discard(rows, kinds, windows)
    return starts


def _blocks(found: DataFrame, *columns: Column) -> DataFrame:
    """(key, from, block, columns): one row for each block of a stretch."""
    first = F.shiftright("base", SHIFT)
    return found.select("key", first.alias("from"), *columns, F.explode(F.sequence(
        first, F.shiftright(F.col("base") + F.octet_length("data") - 1, SHIFT))).alias("block"))


def _merged(places: np.ndarray, masks: np.ndarray, g: Grid) -> list[int]:
    """Begin and end, in turn, of what the windows of these masks cover."""
    row, back = np.nonzero(masks[:, None] >> np.arange(g.every) & 1)
    starts = np.sort(places[row] - back)
    cuts = np.flatnonzero(starts[1:] > starts[:-1] + g.size)
    begin = starts[np.concatenate(([0], cuts + 1))]
    end = starts[np.concatenate((cuts, [len(starts) - 1]))] + g.size
    return np.stack((begin, end), 1).ravel().tolist()


def _ranked_spans(found: DataFrame, size: int, seed: int) -> DataFrame:
    """(key, inner): what repeated strings cover in a stretch, from its first byte."""
    g = grid(size, seed)
    by_block = repeated_starts(found, g).groupBy(F.shiftright("at", SHIFT).alias("block")).agg(
        F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("place"), "mask"))
        .alias("starts"))

    def cover(starts: pa.Array, shift: pa.Array) -> pa.Array:
        rows = ([np.array([x[name] for x in row], np.int64) for name in ("place", "mask")] for row in starts.to_pylist())
        return pa.array([_merged(place + s, mask, g) for (place, mask), s in zip(rows, shift.to_pylist())],
                        pa.list_(pa.int64()))

    shift = (F.col("block") - F.col("from")) * BLOCK
    spans = F.arrow_udf(cover, "array<bigint>")(F.col("starts"), shift)
    return by_block.join(_blocks(found), "block").select("key", spans.alias("inner")).groupBy("key").agg(
        F.flatten(F.collect_list("inner")).alias("inner"))


def spans_of_texts(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(__hi, __lo, spans): begin and end, in turn, of what repeated strings cover."""
    anchors = cut(repeated_anchors(docs, size, seed), "anchors")
    listed = cut(stretches(docs, bit_table(anchors, "h"), size, seed), "stretch-list")
    kinds = cut(listed.groupBy("anchor", "key").agg(
        F.count("*").alias("times"), F.max("again").alias("again"),
        (F.max("n").cast("long") + size - 1).alias("n_bytes")), "stretch-kinds")
    unsettled = cut(kinds.groupBy("anchor").agg(
        F.count("*").alias("n"), F.max("again").alias("again"), F.sum("n_bytes").alias("n_bytes")).filter(
        "n > 1 OR again").select("anchor", "n_bytes"), "unsettled")
    discard(anchors)
    hot = bit_table(unsettled.filter(F.col("n_bytes") > HOT_BYTES), "anchor", HOT_BITS)
    found = open_stretches(docs, bit_table(unsettled, "anchor"), hot, size, seed)
    discard(unsettled)
    inner = cut(_ranked_spans(found, size, seed).withColumnRenamed("key", "ranked"), "ranked-spans")
    discard(found)
    verdicts = kinds.join(inner, kinds["key"] == inner["ranked"], "left").filter(
        "times > 1 OR inner IS NOT NULL").select("key", "times", "inner")
    start = F.col("start").cast("long")
    whole = F.array(start, start + F.col("n") - 1 + size)
    spans = F.when(F.col("times") > 1, whole).otherwise(F.transform("inner", lambda x: x + start))
    of_texts = cut(listed.join(verdicts, "key").select(
        F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), spans.alias("spans")).groupBy("__hi", "__lo").agg(
        F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(listed, kinds, inner)
    return of_texts


def _remove(text: bytes, spans: list[int] | None, copies: int | None, size: int) -> tuple[int, int, int, bytes]:
    if copies is not None and copies > 1 and len(text) >= size:
        return len(text), len(text), 1, b""
    if not spans:
        return len(text), 0, 0, text
    edges = np.asarray(spans, np.int64).reshape(-1, 2)
    gone = covered(edges[:, 0], edges[:, 1], len(text))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    begins = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(text), int(gone.sum()), begins, kept


def remove_repeats(docs: DataFrame, text: str = "text", size: int = 400, seed: int = 200) -> DataFrame:
    """All documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes)."""
    if not 0 < seed < size:
        raise ValueError("0 < seed < size")
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({
        "__text": whole, "__hi": F.xxhash64(whole), "__lo": F.xxhash64(F.lit(1), whole)})
    spans = spans_of_texts(keyed, size, seed)
    copies = keyed.groupBy("__hi", "__lo").agg(F.count("*").alias("copies")).filter("copies > 1")
    known = spans.join(copies, ["__hi", "__lo"], "full")

    def over(column: pa.Array, spans: pa.Array, copies: pa.Array) -> pa.Array:
        rows = [_remove(t, s, c, size) for t, s, c in zip(encoded(column), spans.to_pylist(), copies.to_pylist())]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["n_bytes", "n_removed", "n_spans", "kept"])

    result = F.arrow_udf(over, RESULT)(F.col("__text"), F.col("spans"), F.col("copies"))
    return keyed.join(known, ["__hi", "__lo"], "left").withColumn("__r", result).select(
        *docs.columns, *(F.col("__r")[n].alias(n) for n in ("n_bytes", "n_removed", "n_spans", "kept")))
