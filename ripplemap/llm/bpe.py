"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by a pattern into pre-tokens; each is merged by itself. Its bytes are a
doubly linked list of tokens. Every adjacent pair that forms a token waits in the bucket
of that token's rank, buckets hold list positions, and a two-level bitmap tells by
find-first-set which bucket is next. Positions whose pair has changed meanwhile are stale
and skipped. A merge costs a few bit operations whatever the length, so pre-tokens of
megabytes take time in proportion to their bytes (times the log of a bucket).

Pre-tokens repeat, so each Python worker keeps the ids of short ones, up to a bound. New
short ones wait until many texts are split and then share one queue (``merge_many``): a
bucket's positions are merged together, one of each pre-token, so that every pre-token sees
its own merges in the same order as alone.
``token_bytes`` are ids as little-endian unsigned 32-bit integers, end to end.

Defined results: null and empty texts have no token and decode to the empty text; other
columns are kept; repeated rows are encoded each for itself; an empty table stays empty.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import encoded

#: Pre-tokens of at most so many characters are kept, at most twice so many of them.
KEPT_CHARS, KEPT_TOKENS = 40, 300_000
#: Pre-tokens of a long text that are held at a time, and what counts as long.
BLOCK, LONG_CHARS = 50_000, 500_000
#: Pre-tokens whose ids are awaited together, and how many new ones are worth a shared queue.
AWAITED, SHARED = 3_000_000, 500
BIT = [1 << i for i in range(1024)]
#: Letters, besides A-Z, of texts that Python's own pattern engine splits alike, and faster.
PLAIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The content of a rank file: lines of a token in base 64, a blank and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class RankQueue:
    """List positions by rank; the least rank first, within a rank the leftmost position."""

    __slots__ = ("buckets", "low", "high")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # bits of 256 ranks each, words without bits left out
        self.high = 0  # a bit for each word

    def put(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            heappush(buckets[rank], position)
            return
        buckets[rank] = [position]
        self._mark(rank)

    def take(self) -> tuple[int, int]:
        """Rank and position of the next pair; the queue must not be empty."""
        rank = self._first()
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self._unmark(rank)
        return rank, bucket[0]

    def _first(self) -> int:
        word = (self.high & -self.high).bit_length() - 1
        bits = self.low[word]
        return word << 8 | (bits & -bits).bit_length() - 1

    def _mark(self, rank: int) -> None:
        word, low = rank >> 8, self.low
        if word in low:
            low[word] |= BIT[rank & 255]
        else:
            low[word] = BIT[rank & 255]
            self.high |= BIT[word]

    def _unmark(self, rank: int) -> None:
        word, low = rank >> 8, self.low
        low[word] ^= BIT[rank & 255]
        if not low[word]:
            del low[word]
            self.high ^= BIT[word]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n))  # where the token left of the one that starts here starts
    pair = [get(piece[i:i + 2], -1) for i in range(n)]  # rank of the token here with the next one
    pair[-1] = -1
    queue = RankQueue()
    put, take, following = queue.put, queue.take, queue.buckets
    for i, rank in enumerate(pair):
        if rank >= 0:
            put(rank, i)
    while following:
        rank, i = take()
        if pair[i] != rank:
            continue  # stale
        middle = end[i]
        stop = end[i] = end[middle]
        pair[middle] = grown = -1
        if stop < n:
            before[stop] = i
            grown = get(piece[i:end[stop]], -1)
            if grown >= 0:
                put(grown, i)
        pair[i] = grown
        left = before[i]
        if left >= 0:
            pair[left] = grown = get(piece[left:stop], -1)
            if grown >= 0:
                put(grown, left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class BlockQueue(RankQueue):
    """Arrays of list positions by rank; a bucket is taken as a whole."""

    __slots__ = ()

    def put(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
        else:
            self.buckets[rank] = [positions]
            self._mark(rank)

    def take(self) -> tuple[int, np.ndarray]:
        rank = self._first()
        found = self.buckets.pop(rank)
        self._unmark(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class PairRanks:
    """Ranks of pairs of tokens, as sorted arrays; ``none`` where a pair forms no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values(), default=0) + 1  # also the token beyond either end
        get, found = ranks.get, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        pairs = np.array(sorted(found) + [((1 << 63) - 1, self.none)], np.int64)
        self.keys, self.values = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.byte = np.array([get(bytes([b]), self.none) for b in range(256)], np.int64)
        left, right = np.repeat(self.byte, 256), np.tile(self.byte, 256)
        self.of_bytes = self.find(left << 32 | right)

    def find(self, key: np.ndarray) -> np.ndarray:
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def put(self, queue: BlockQueue, rank: np.ndarray, position: np.ndarray) -> None:
        some = rank != self.none
        rank, position = rank[some], position[some]
        order = rank.argsort(kind="stable")
        rank, position = rank[order], position[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        if len(rank):
            for value, begin, end in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
                queue.put(value, position[begin:end])


def merge_many(pieces: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Packed ids of many pre-tokens, none empty: their lists lie end to end in one queue.

    A bucket gives each pre-token its leftmost live position; what is left waits in the bucket,
    since a merge may have made a pair of a lower rank. ``n`` is the place beyond every end.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    n, stop_at = len(data), np.cumsum([len(p) for p in pieces])
    start_at = np.concatenate(([0], stop_at[:-1]))
    owner = np.repeat(np.arange(len(pieces)), stop_at - start_at)
    token = np.append(pairs.byte[data], pairs.none)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[stop_at - 1] = before[start_at] = n
    before = np.append(before, n)
    pair = np.full(n + 1, pairs.none)
    pair[:n - 1] = pairs.of_bytes[data[:-1] << 8 | data[1:]]
    pair[stop_at - 1] = pairs.none
    alive = np.ones(n, bool)
    queue = BlockQueue()
    pairs.put(queue, pair, np.arange(n + 1))
    while queue.buckets:
        rank, at = queue.take()
        at = at[pair[at] == rank]  # the others are stale
        if len(at) > 1:
            at.sort()
            first = np.ones(len(at), bool)
            whose = owner[at]
            np.not_equal(whose[1:], whose[:-1], out=first[1:])
            if not first.all():
                queue.put(rank, at[~first])
                at = at[first]
        elif not len(at):
            continue
        middle = after[at]
        stop, left = after[middle], before[at]
        token[at], after[at], before[stop] = rank, stop, at
        alive[middle], pair[middle] = False, pairs.none
        touched = np.concatenate((left, at))
        grown = pairs.find(np.concatenate((token[left] << 32 | rank, rank << 32 | token[stop])))
        pair[touched] = grown
        pairs.put(queue, grown, touched)
    place = np.flatnonzero(alive)
    packed = token[place].astype("<u4").tobytes()
    edges = (np.searchsorted(place, np.append(start_at, n)) * 4).tolist()
    return [packed[i:j] for i, j in zip(edges, edges[1:])]


class PieceIds(dict):
    """Cells of packed ids by pre-token: a bounded memory of merges in two generations.

    When the young one is full it becomes the old one; what is asked for again moves back.
    Cells of new pre-tokens are empty until ``settle``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old, self.new = ranks, {}, {}
        self.pairs = PairRanks(ranks)

    def __missing__(self, piece: str) -> list[bytes]:
        if len(piece) > KEPT_CHARS:
            return [self._alone(piece)]
        cell = self.old.get(piece)
        if cell is None:
            cell = self.new.get(piece)
        if cell is None:
            cell = self.new[piece] = []
        if len(self) >= KEPT_TOKENS:
            self.old = dict(self)
            self.clear()
        self[piece] = cell
        return cell

    def _alone(self, piece: str) -> bytes:
        ids = merge_bytes(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def settle(self) -> None:
        """Fill the cells of all new pre-tokens."""
        if len(self.new) < SHARED:
            for piece, cell in self.new.items():
                cell.append(self._alone(piece))
        else:
            whole, parts = self.ranks.get, []
            for piece, cell in self.new.items():
                data = piece.encode()
                rank = whole(data)
                if rank is None:
                    parts.append((data, cell))
                else:
                    cell.append(struct.pack("<I", rank))
            if parts:
                for (_, cell), packed in zip(parts, merge_many([data for data, _ in parts], self.pairs)):
                    cell.append(packed)
        self.new = {}


class ByteBpe:
    """Encoder and decoder for a rank file's content and a split pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        # in a text of ASCII, these letters and white space, both engines have the same classes
        self.fast = re.compile(pattern.replace(r"\s\p{L}\p{N}", rf"\s{PLAIN_LETTERS}0-9").replace(
            r"\p{L}", f"[{PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]"))
        self.odd = re.compile(rf"[^\t-\r -~{PLAIN_LETTERS}]")
        self.ids = PieceIds(self.ranks)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    def _pieces(self, text: str) -> Iterator[list[str]]:
        pattern = self.pattern if self.odd.search(text) else self.fast
        if len(text) <= LONG_CHARS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Packed ids of each text; a bounded number of pre-tokens is held."""
        out: list[bytes] = []
        parts: list[tuple[int, list[list[bytes]]]] = []  # text number and cells
        held, cells_of = 0, self.ids.__getitem__

        def write() -> None:
            self.ids.settle()
            for number, cells in parts:
                out[number] += b"".join([cell[0] for cell in cells])
            parts.clear()

        for number, text in enumerate(texts):
            out.append(b"")
            for block in self._pieces(text):
                parts.append((number, list(map(cells_of, block))))
                held += len(block)
                if held >= AWAITED:
                    write()
                    held = 0
        write()
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(data: bytes, pattern: str) -> ByteBpe:
    """One per Python worker and rank file."""
    return ByteBpe(data, pattern)


def _binary_udf(run: Callable[[ByteBpe, pa.Array], list[bytes]], path: str, pattern: str):
    data = Path(path).read_bytes()  # on the driver: under a megabyte, sent with the function

    def over(column: pa.Array) -> pa.Array:
        return pa.array(run(tokenizer(data, pattern), column), pa.binary())

    return F.arrow_udf(over, "binary")


def encode_column(text: Column, path: str, pattern: str) -> Column:
    return _binary_udf(lambda bpe, c: bpe.encode_all(t.decode() for t in encoded(c)), path, pattern)(text)


def decode_column(token_bytes: Column, path: str, pattern: str) -> Column:
    return _binary_udf(lambda bpe, c: [bpe.decode(t or b"") for t in c.to_pylist()], path, pattern)(token_bytes)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``token_bytes`` and ``n_tokens``."""
    return docs.withColumn("token_bytes", encode_column(F.col(text), path, pattern)).withColumn(
        "n_tokens", (F.octet_length("token_bytes") / 4).cast("long"))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes that the ids stand for."""
    return tokens.withColumn("decoded", decode_column(F.col("token_bytes"), path, pattern))
