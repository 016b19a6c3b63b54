"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most ``radius`` of 64 bits agree in at least
``BLOCKS - radius`` of ``BLOCKS`` blocks of bits. Each distinct fingerprint goes to one
shard for every choice of that many blocks, so linked ones meet in some shard. A shard
keeps a BK-tree (children keyed by their Hamming distance to the parent); each fingerprint
is looked up, following only edges within the radius, and then added. A shard returns a
forest of links, fewer than its members, never all pairs. Shards of more than
``SHARD_NODES`` members are cut into a grid: every part's tree is met by every part.

Links are joined to components by large-star and small-star rounds, each written to the
shared folder. Texts are never shuffled; equal fingerprints are one node from the start.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any
other; a null id is never the least id, and a group of only null ids has a null
component; repeated rows get the same component; an empty table stays empty; other
columns are kept by ``with_fingerprint`` and ``components``; names that begin with two
underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import cut, discard, encoded

SEED = 42
#: Bit widths of the blocks; any two of five agree when at most three bits differ.
BLOCK_WIDTHS = (13, 13, 13, 13, 12)
#: Nodes of one BK-tree, about.
SHARD_NODES = 4_096
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SHINGLES = 20_000


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, _SHINGLES):
        part = words[begin:min(begin + _SHINGLES, n) + size - 1]
        strings = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(h), 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, size: int = 3) -> Column:
    def over(column: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, size) for t in encoded(column)], np.uint64)
        return pa.array(found.view(np.int64))

    return F.arrow_udf(over, "long")(text)


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Add ``fp``, the 64 bits as a signed long."""
    return docs.withColumn("fp", fingerprint_column(F.col(text), size))


class BkForest:
    """A BK-tree that merges what it links: union-find over its nodes and queries.

    A node is *closed* while everything below it is in its own component; a search from
    that same component has nothing to gain there and does not go down.
    """

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.closed: list[bool] = []
        self.parent: list[int] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def link(self, a: int, b: int) -> int:
        a, b = self.root(a), self.root(b)
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        return a

    def node(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        self.closed.append(True)
        self.parent.append(len(self.parent))
        return len(self.values) - 1

    def search(self, me: int, radius: int) -> None:
        """Link a node to every tree node within the radius."""
        value, mine, waiting = self.values[me], self.root(me), [0]
        while waiting:
            at = waiting.pop()
            if self.closed[at] and self.root(at) == mine:
                continue
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                mine = self.link(mine, at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    waiting.append(child)

    def insert(self, me: int) -> None:
        at, value = 0, self.values[me]
        path = []
        while True:
            path.append(at)
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = me
                break
            at = child
        mine = self.root(me)
        for at in path:
            self.closed[at] = self.closed[at] and self.root(at) == mine


def shard_links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links among the members of a shard, and from further queries to them."""
    forest = BkForest()
    for value in members:
        me = forest.node(value)
        if me:
            if not queries:  # members of a grid cell meet each other in another cell
                forest.search(me, radius)
            forest.insert(me)
    for value in queries:
        forest.search(forest.node(value), radius)
    roots = [forest.root(i) for i in range(len(forest.values))]
    return [(v, forest.values[r]) for v, r in zip(forest.values, roots) if v != forest.values[r]]


def shard_keys(fp: Column, radius: int) -> Column:
    """One key for each choice of blocks that may all agree; the choice is part of it."""
    low = np.concatenate(([0], np.cumsum(BLOCK_WIDTHS)))[:-1].tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCK_WIDTHS)), len(BLOCK_WIDTHS) - radius)):
        key = F.lit(number).cast("long")
        for b in chosen:
            bits = F.shiftrightunsigned(fp, low[b]).bitwiseAND(F.lit((1 << BLOCK_WIDTHS[b]) - 1))
            key = F.shiftleft(key, BLOCK_WIDTHS[b]).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def links(fingerprints: DataFrame, radius: int = 3, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(a, b) rows that connect all of the distinct ``fp`` within ``radius`` bits of each other."""
    if not 0 <= radius < len(BLOCK_WIDTHS):
        raise ValueError(f"radius must be less than {len(BLOCK_WIDTHS)}")
    keyed = fingerprints.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / shard_nodes).cast("int")
    shards = keyed.join(sizes.select("key", parts.alias("parts")), "key")
    own, other = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.col("other")
    # a small shard is one cell; a large one is cut into (tree part, query part), tree <= query
    cells = shards.withColumns({
        "own": own, "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
    }).select("key", F.least("own", other).alias("tree"), F.greatest("own", other).alias("query"),
              (F.col("own") <= other).alias("member"), "fp")
    sorted_cells = cells.repartition("key", "tree", "query").sortWithinPartitions(
        "key", "tree", "query", F.desc("member"), "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, queries = None, [], []

        def flush() -> pa.RecordBatch:
            found = np.array(shard_links(members, queries, radius), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            key, tree, query, member = (batch.column(i).to_pylist() for i in range(4))
            fps = batch.column(4).to_numpy().view(np.uint64).tolist()
            for cell in zip(key, tree, query, member, fps):
                if cell[:3] != held:
                    if held is not None:
                        yield flush()
                    held, members, queries = cell[:3], [], []
                (members if cell[3] else queries).append(cell[4])
        if held is not None:
            yield flush()

    return sorted_cells.mapInArrow(search, "a long, b long").distinct()


def _least(pairs: DataFrame, of: str, other: str, name: str) -> DataFrame:
    return pairs.groupBy(of).agg(F.min(other).alias(name))


def connected(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the (a, b) rows; the root is the least node.

    Large-star: what is above a node goes to the node's least neighbour. Small-star: what
    is below goes to the least below. Both in turn until nothing changes.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u", "v", "m").withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = _least(large, "u", "v", "m")
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small, "links")
        discard(edges)
        edges = after
        # done when every node has one link and no root is below another node
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def components(fingerprinted: DataFrame, id_column: str = "doc_id", radius: int = 3) -> DataFrame:
    """Add ``component_id``, the least id reachable, and ``component``, its fingerprint.

    The input is read more than once, so give a written table; it needs no text.
    """
    nodes = fingerprinted.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = connected(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root").select(
        F.col("fp"), F.col("root").alias("component"), "component_id")
    return fingerprinted.join(known, "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3,
                    radius: int = 3) -> DataFrame:
    """Every document without its text, with ``fp``, ``component`` and ``component_id``."""
    slim = cut(with_fingerprint(docs, text, size).drop(text), "fingerprints")
    return components(slim, id_column, radius)
