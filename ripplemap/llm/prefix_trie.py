"""Prefix trie of conversations: what they share from their first turn on, with subtree totals.

A turn is a digest of role and text and a length; texts are not shuffled. A prefix is named
by the xor of the hashes of (place, digest) of its turns, 128 bits, so prefixes of a long
conversation are running sums, taken in blocks of ``BLOCK`` turns that are joined again by
running sums over blocks. A node is a distinct prefix; its members are counted before the
shuffle.

Subtree totals come from parallel tree contraction, in rounds of joins. *Rake*: leaves give
their totals to their parents and go. *Compress*: a node with one child left, picked by a
rule that never picks two neighbours, goes too; the child takes its place and carries its
amounts on. Each round removes all leaves and about a third or more of each unary chain, so
the number of rounds grows with the logarithm of depth, and the work with the nodes. Contracted nodes
are then given back in reverse order: a node's total is its child's, known by then, plus
what it carried. Each round ends in a written table.

The digest of a node's ending members is made of packed pieces of their sorted list, which
pass by one task without being held.

Defined results: rows without a conversation id belong to none; null roles and texts count as
empty; a null turn comes first; turns of one number go by their digest; repeated rows are turns
of their own; an empty table gives no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemap.llm.common import cut, discard
from ripplemap.operators.numbering import numbered
from ripplemap.operators.skew import join_back, key_rows, with_salt

#: Turns of a conversation that one task takes a running sum over; equal rows listed at a time.
BLOCK = 4_096
#: Conversation ids packed into one string.
PACKED = 1_024
MAX_ROUNDS = 200
ROOT = "named_struct('a', 0L, 'b', 0L)"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_chars): turns numbered from 0 in each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    equal = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(digest).alias("digest"), F.length(text).cast("long").alias("n_chars"),
    ).groupBy("conv_id", "turn", "digest", "n_chars").agg(F.count("*").alias("n"))
    placed = numbered(equal, ["turn", "digest"], by=["conv_id"], name="place", weight="n")
    last = F.col("place") + F.col("n") - 1
    pieces = placed.withColumns({"last": last, "from": F.explode(F.sequence("place", last, F.lit(BLOCK)))})
    to = F.least(F.col("last"), F.col("from") + BLOCK - 1)
    return pieces.select("conv_id", F.explode(F.sequence("from", to)).alias("place"), "digest", "n_chars")


def rebuilt(conversations: DataFrame, family: int = 100, shares: int = 6) -> DataFrame:
    """Conversations that begin like the first of their family.

    Each id c gets the first h = crc32(c) % ``shares`` turns of conversation c - c % ``family``
    (as many as there are), then its own turns after its first h. Same columns as ``turns``;
    a conversation without turns has one row without a place.
    """
    own = cut(turns(conversations), "turns")
    salted = with_salt(own, ["place"])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares).cast("int")
    ids = key_rows(salted, ["conv_id"], F.count("*").alias("n")).withColumns(
        {"h": h, "family": F.col("conv_id") - F.col("conv_id") % family})
    heads = own.filter(F.col("place") < shares - 1).groupBy(F.col("conv_id").alias("family")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "n_chars"))).alias("heads"))
    known = cut(ids.join(heads, "family", "left").withColumn(
        "heads", F.slice(F.coalesce("heads", F.expr("array()")), F.lit(1), F.col("h"))), "families")
    first = known.select("conv_id", F.inline("heads"))
    rest = join_back(salted, known.select("conv_id", "__salts", "h", F.size("heads").alias("taken")), ["conv_id"]).filter(
        "place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_chars")
    turnless = known.filter("n <= h AND size(heads) = 0").select("conv_id")
    return first.unionByName(rest).unionByName(turnless, allowMissingColumns=True)


def _prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_chars): one row for each prefix of each conversation."""
    placed = cut(sequences.withColumns({
        "block": F.floor(F.col("place") / BLOCK).cast("long"),
        "x": F.xxhash64(F.lit(1), "place", "digest"), "y": F.xxhash64(F.lit(2), "place", "digest")}), "sequences")
    some = placed.filter(F.col("place").isNotNull())
    blocks = some.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *(
        F.bit_xor(c).over(earlier).alias(f"{c}_before") for c in "xy")).filter("x_before IS NOT NULL")
    within = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = some.select("*", *(F.bit_xor(c).over(within).alias(f"{c}_run") for c in "xy")).join(
        carried, ["conv_id", "block"], "left")
    a, b = (F.col(f"{c}_run").bitwiseXOR(F.coalesce(F.col(f"{c}_before"), F.lit(0).cast("long"))) for c in "xy")
    named = running.select(
        "conv_id", (F.col("place") + 1).alias("depth"), F.struct(a.alias("a"), b.alias("b")).alias("node"),
        F.struct(a.bitwiseXOR(F.col("x")).alias("a"), b.bitwiseXOR(F.col("y")).alias("b")).alias("parent"), "n_chars")
    roots = placed.filter("place IS NULL OR place = 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.expr(ROOT).alias("node"),
        F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("n_chars"))
    return named.unionByName(roots)


def _rank(node: str, depth: str, number: int) -> Column:
    """What picks among neighbours of a chain: a bit of the depth, which alternates where depths do, then a hash."""
    return F.struct(F.shiftright(F.col(depth), number % 16).bitwiseAND(F.lit(1)), F.xxhash64(F.lit(number), node))


def _contract(state: DataFrame, number: int) -> DataFrame:
    """One rake and one compress; nodes that go by compression are named beside their child."""
    leaf = F.col("n_kids") == 0
    of_parent = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("to")).agg(
        *(F.sum(F.when(leaf, F.col(v) + F.col(f"up_{v}")).otherwise(0)).alias(f"more_{v}") for v in ("leaves", "saved")),
        F.count(F.when(~leaf, 1)).alias("left"),
        *(F.max(F.when(~leaf, F.col(c))).alias(f"kid_{c[-1]}") for c in ("depth", "node.a", "node.b")))
    raked = state.filter(~leaf).join(of_parent, F.col("node") == F.col("to")).select(
        "node", "depth", "parent", "parent_depth", "up_leaves", "up_saved", F.col("left").alias("n_kids"),
        *((F.col(v) + F.col(f"more_{v}")).alias(v) for v in ("leaves", "saved")),
        F.col("kid_h").alias("kid_depth"), F.struct(F.col("kid_a").alias("a"), F.col("kid_b").alias("b")).alias("kid"))
    mine = _rank("node", "depth", number)
    picked = (F.col("n_kids") == 1) & F.col("parent").isNotNull() & (mine > _rank("kid", "kid_depth", number)) & (
        (F.col("parent_depth") == 0) | (mine > _rank("parent", "parent_depth", number)))
    marked = cut(raked.withColumn("goes", F.coalesce(picked, F.lit(False))), "contraction")
    gone = marked.filter("goes").select(
        F.col("kid").alias("into"), F.col("node").alias("went"), F.col("parent").alias("new_parent"),
        F.col("parent_depth").alias("new_depth"), *(F.col(v).alias(f"own_{v}") for v in ("leaves", "saved")),
        *(F.col(f"up_{v}").alias(f"above_{v}") for v in ("leaves", "saved")))
    joined = marked.filter("NOT goes").join(gone, F.col("node") == F.col("into"), "left")
    moved = F.col("went").isNotNull()
    carried = {v: F.col(f"own_{v}") + F.col(f"up_{v}") for v in ("leaves", "saved")}
    stays = cut(joined.select(
        "node", "depth", "n_kids", "leaves", "saved", "went",
        F.when(moved, F.col("new_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(moved, F.col("new_depth")).otherwise(F.col("parent_depth")).alias("parent_depth"),
        *(carried[v].alias(f"went_{v}") for v in carried),
        *(F.when(moved, carried[v] + F.col(f"above_{v}")).otherwise(F.col(f"up_{v}")).alias(f"up_{v}") for v in carried)),
        "contracted")
    discard(marked)
    return stays


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums over each node and all below it.

    ``nodes`` has ``node``, ``parent`` (null for a root), ``depth`` (0 for a root), ``n_kids``
    and the node's own ``leaves`` and ``saved``.
    """
    zero = F.lit(0).cast("long")
    state = cut(nodes.select(
        "node", "depth", "parent", F.when(F.col("parent").isNotNull(), F.col("depth") - 1).alias("parent_depth"),
        "n_kids", "leaves", "saved", zero.alias("up_leaves"), zero.alias("up_saved")), "contraction")
    states = [state]
    while not states[-1].filter("n_kids > 0").isEmpty():
        if len(states) > MAX_ROUNDS:
            raise RuntimeError(f"the trie did not contract in {MAX_ROUNDS} rounds")
        states.append(_contract(states[-1], len(states) - 1))
    raked = [s.filter("n_kids = 0").select("node", "leaves", "saved") for s in states]
    known = raked[-1]
    for before, after in zip(reversed(raked[:-1]), reversed(states[1:])):
        gone = after.filter("went IS NOT NULL").select("went", F.col("node").alias("into"), "went_leaves", "went_saved")
        given = gone.join(known, F.col("into") == F.col("node")).select(
            F.col("went").alias("node"), (F.col("leaves") + F.col("went_leaves")).alias("leaves"),
            (F.col("saved") + F.col("went_saved")).alias("saved"))
        known = known.unionByName(cut(given, "given-back")).unionByName(before)
    return known


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted ids of each node: (a, b, first id, ids joined by commas)."""
    held, ids = None, []

    def piece(rows: list) -> pa.RecordBatch:
        a, b, first, text = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())],
            ["a", "b", "first", "ids"])

    for batch in batches:
        rows = []
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held != (a, b) or len(ids) == PACKED:
                if ids:
                    rows.append((*held, ids[0], ",".join(map(str, ids))))
                held, ids = (a, b), []
            ids.append(conv)
        if rows:
            yield piece(rows)
    if ids:
        yield piece([(*held, ids[0], ",".join(map(str, ids)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after the other."""
    held, digest = None, None

    def row(found: list) -> pa.RecordBatch:
        a, b, text = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], ["a", "b", "ends_sha256"])

    for batch in batches:
        found = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if held == (a, b):
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                found.append((*held, digest.hexdigest()))
            held, digest = (a, b), hashlib.sha256(ids.encode())
        if found:
            yield row(found)
    if held is not None:
        yield row([(*held, digest.hexdigest())])


def _ends(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    last = prefixes.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")).select("node.a", "node.b", "conv_id")
    pieces = last.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(
        _packed, "a long, b long, first long, ids string")
    streamed = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return streamed.mapInArrow(_digests, "a long, b long, ends_sha256 string").select(
        F.struct("a", "b").alias("node"), "ends_sha256")


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each node; ``sequences`` has the columns of ``turns``."""
    prefixes = cut(_prefixes(sequences), "prefixes")
    # what a prefix says of its node is the same for all members
    members = cut(prefixes.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"),
        F.min("parent.a").alias("a"), F.min("parent.b").alias("b"), F.min("n_chars").alias("n_chars")).withColumn(
        "parent", F.when(F.col("a").isNotNull(), F.struct("a", "b"))).drop("a", "b"), "members")
    children = with_salt(members.filter("parent IS NOT NULL"), ["node"])
    families = cut(key_rows(children, ["parent"], F.count("*").alias("n_kids")), "children")
    counted = families.select(F.col("parent").alias("of"), "n_kids")
    n_kids = F.coalesce("n_kids", F.lit(0).cast("long"))
    nodes = members.join(counted, F.col("node") == F.col("of"), "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", n_kids.alias("n_kids"),
        F.when(n_kids == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    nodes = cut(nodes, "nodes")
    totals = subtree_totals(nodes).select(
        F.col("node").alias("of"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    heads = families.drop("n_kids").join(
        members.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    above = join_back(children.select("node", "parent", "__salt"), heads, ["parent"]).select(
        F.col("node").alias("child"), "parent_conv_id")
    ends = _ends(prefixes).withColumnRenamed("node", "end")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, F.col("node") == F.col("of")).join(above, F.col("node") == F.col("child"), "left").join(
        ends, F.col("node") == F.col("end"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_kids").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
