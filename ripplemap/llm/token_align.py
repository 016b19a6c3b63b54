"""Alignment of two tokenizers over the same bytes, and how often their ids meet.

A is a byte-level BPE of a blank and the text, B a piece model (sentencepiece) of the text,
which adds the blank itself. A's file is one of the tokenizers library with the common
byte-level pattern and ids in merge order, so its vocabulary serves as ranks for tiktoken,
which gives the same ids in a fifth of the time. Tokens are byte ranges. In each
Arrow batch, ``pandas.merge_asof``, keyed by document, gives for each token's start the other
side's token that covers it; both directions together are the overlaps. Overlapping tokens
with equal ends close a group. Every A token of a group is linked to every B token of it.

``link_statistics`` counts, over the whole corpus, the documents in which a pair of ids is
linked. Texts are tokenized once and their ids written. Pairs are counted in each task before
the shuffle. The most frequent ones, at most ``HOT_PAIRS``, are broadcast as sorted numbers;
the rest are rare, so no key is hot, and a join brings their counts to the documents that
hold them.

Defined results: a null or empty text, and one whose tokens do not spell it, has no tokens;
ties for an id's best pair all count; repeated rows are documents of their own; an empty table
gives an empty result; columns with names of the results, or with two underscores in front,
are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import cut, encoded, pieces

#: Pairs that are broadcast, 17 bytes each.
HOT_PAIRS = 1_000_000
#: Links of one group that are listed singly; a larger group is counted by its distinct ids.
LISTED_LINKS = 4_096
#: Pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1_000_000
SPACE = "▁"
# Fixed value: how the tokenizers library's byte-level step cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STATISTICS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_RESULT = ("struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_best:bigint,count_sum:bigint,"
           "groups_sha256:string,rare:array<struct<a:int,b:int,times:bigint>>>")
_ALIGNED = ("struct<a_ids:array<int>,b_ids:array<int>,overlaps:array<struct<a:int,b:int>>,"
            "groups:array<struct<a_end:int,b_end:int>>>")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Names:
    """What each id of a vocabulary spells."""

    def __init__(self, names: list[bytes]):
        self.size = np.array([len(x) for x in names], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names), np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other; ``ends`` are their ends there."""
        size = self.size[ids]
        return self.data[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Aligned:
    """Tokens and groups of some texts, all in one row of bytes; ``n`` is the number of texts."""

    n: int
    ids: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]
    overlaps: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]  # of each group the last token of either side


class Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        byte_of = byte_level()
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in Tokenizer.from_file(a_path).get_vocab(
            with_added_tokens=False).items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_names = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            a_names[i] = entry
        listed = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_names = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                   for i, p in enumerate(listed)]
        self.sides = _Names(a_names), _Names(b_names)
        self.bits = max(len(a_names), len(b_names)).bit_length()
        self.width = 2 if self.bits <= 16 else 4
        self.kind = f"<u{self.width}"
        self.numbers = [[np.array([b"%d%s" % (i, mark) for i in range(len(s.size))], object)
                         for mark in (b",", end)] for s, end in zip(self.sides, (b"|", b";"))]

    def _tokens(self, data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For either side, ids of all texts and how many each has; ``data`` begin with the blank."""
        texts = [t.decode() for t in data]
        for found in ([self.a.encode_to_numpy(t, disallowed_special=()) for t in texts],
                      self.b.encode([t[1:] for t in texts], num_threads=1)):
            count = np.array([len(x) for x in found], np.int64)
            yield np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in found)]), count

    def tokenize(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of each text by A and by B; none where either side's do not spell it."""
        data = [b" " + t for t in texts if t]
        sizes = np.array([len(t) for t in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        sides, right = [], np.ones(len(data), bool)
        for names, (ids, count) in zip(self.sides, self._tokens(data)):
            doc, size = np.repeat(np.arange(len(data)), count), names.size[ids]
            own = np.bincount(doc, size, len(data)).astype(np.int64) == sizes
            fits = own[doc]
            wrong = np.flatnonzero(names.spell(ids[fits], np.cumsum(size[fits])) != flat[np.repeat(own, sizes)])
            if len(wrong):
                own[np.flatnonzero(own)[np.searchsorted(np.cumsum(sizes[own]), wrong, "right")]] = False
            right &= own
            ends = np.cumsum(count)
            sides.append((ids.astype(self.kind).tobytes(), ((ends - count) * self.width).tolist(), (ends * self.width).tolist()))
        spelt, number = right.tolist(), iter(range(len(data)))
        places = [next(number) if t else -1 for t in texts]
        a, b = ([ids[begin[k]:end[k]] if k >= 0 and spelt[k] else b"" for k in places] for ids, begin, end in sides)
        return a, b

    def align(self, *packed: Sequence[bytes]) -> Aligned:
        """Align texts given as their packed ids by A and by B."""
        n = len(packed[0])
        ids, docs, ends = [], [], []
        for names, rows in zip(self.sides, packed):
            i = np.frombuffer(b"".join(rows), self.kind).astype(np.int64)
            ids.append(i)
            docs.append(np.repeat(np.arange(n), [len(x) // self.width for x in rows]))
            ends.append(np.cumsum(names.size[i]))
        if not len(ids[0]):
            nothing = np.empty(0, np.int64)
            return Aligned(n, *((nothing,) * 2,) * 4)
        frames = [pd.DataFrame({"at": np.concatenate(([0], e[:-1])), "doc": d, "token": np.arange(len(e))})
                  for e, d in zip(ends, docs)]
        b_of_a, a_of_b = (
            pd.merge_asof(x, y, on="at", by="doc", suffixes=("", "_over"))["token_over"].to_numpy().astype(np.int64)
            for x, y in (frames, frames[::-1]))
        a, b = np.arange(len(b_of_a)), np.arange(len(a_of_b))
        over = np.concatenate((a, a_of_b)), np.concatenate((b_of_a, b))
        equal = ends[0][over[0]] == ends[1][over[1]]
        last = []
        for side, tokens in zip(over, (a, b)):
            flags = np.zeros(len(tokens), bool)
            flags[side[equal]] = True
            last.append(np.flatnonzero(flags))
        return Aligned(n, tuple(ids), tuple(docs), over, tuple(last))

    def links(self, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (text, A id, B id) and how many links each stands for."""
        first = [np.concatenate(([0], x[:-1] + 1)) if len(x) else x for x in found.last]
        size = [x + 1 - f for x, f in zip(found.last, first)]
        doc = found.doc[0][found.last[0]]
        product = size[0] * size[1]
        keys, times = [], []
        # groups whose links are listed, some millions at a time
        listed = np.flatnonzero(product <= LISTED_LINKS)
        for chosen in np.split(listed, np.flatnonzero(np.diff(np.cumsum(product[listed]) >> 21)) + 1):
            n = product[chosen]
            group = np.repeat(chosen, n)
            within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            of_b = size[1][group]
            x = found.ids[0][first[0][group] + within // of_b]
            y = found.ids[1][first[1][group] + within % of_b]
            k, t = np.unique(self._key(doc[group], x, y), return_counts=True)
            keys.append(k)
            times.append(t)
        for g in np.flatnonzero(product > LISTED_LINKS).tolist():
            (x, nx), (y, ny) = (np.unique(i[f[g]:f[g] + s[g]], return_counts=True)
                                for i, f, s in zip(found.ids, first, size))
            keys.append(self._key(doc[g], x[:, None], y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
        if len(keys) == 1:
            return keys[0], times[0].astype(np.int64)
        return summed(np.concatenate(keys), np.concatenate(times).astype(np.int64))

    def _key(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((np.asarray(doc, np.int64) << self.bits | a) << self.bits) | b

    def digests(self, found: Aligned) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; '' without tokens."""
        out = np.empty(sum(map(len, found.ids)), object)
        group = [np.searchsorted(x, np.arange(len(i)), "left") for x, i in zip(found.last, found.ids)]
        # an A token stands behind the B tokens of the groups before, a B token behind all of its group's A tokens
        before = np.concatenate(([0], found.last[1] + 1))[group[0]]
        through = (found.last[0] + 1)[group[1]]
        for side, shift in ((0, before), (1, through)):
            ids, last = found.ids[side], np.zeros(len(found.ids[side]), bool)
            last[found.last[side]] = True
            out[np.arange(len(ids)) + shift] = np.where(last, self.numbers[side][1][ids], self.numbers[side][0][ids])
        ends = sum(np.searchsorted(d, np.arange(found.n + 1), "left") for d in found.doc)
        return [hashlib.sha256(b"".join(out[i:j].tolist())[:-1]).hexdigest() if j > i else ""
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair for all tasks of a Python worker, which so share the kept parts."""
    return Tokenizers(a_path, b_path)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def with_tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text", name: str = "__t") -> DataFrame:
    """Add a struct of the packed ids of each text, ``a`` and ``b``."""
    def over(column: pa.Array) -> pa.Array:
        sides = [], []
        for _, texts in pieces(encoded(column)):
            for side, rows in zip(sides, tokenizers(a_path, b_path).tokenize(texts)):
                side.extend(rows)
        return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in sides], ["a", "b"])

    return docs.withColumn(name, F.arrow_udf(over, "struct<a:binary,b:binary>")(F.col(text)))


def _aligned(both: Tokenizers, a: pa.Array, b: pa.Array) -> Iterator[Aligned]:
    of_b = b.to_pylist()
    for first, rows in pieces(a.to_pylist()):
        yield both.align(rows, of_b[first:first + len(rows)])


def _count_pairs(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): documents of this task in which a pair of ids is linked, some pairs several times."""
    both, held, waiting = tokenizers(*paths), (np.empty(0, np.int64),) * 2, []
    mask = (1 << 2 * both.bits) - 1

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate((x, *y)) for x, y in zip(held, zip(*waiting)))) if waiting else held

    def passed_on(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 100_000):
            part = pairs[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part >> both.bits, pa.int32()), pa.array(part & ((1 << both.bits) - 1), pa.int32()),
                 pa.array(n[at:at + 100_000])], ["a", "b", "n"])

    for batch in batches:
        for found in _aligned(both, *batch.columns):
            keys, _ = both.links(found)
            pairs, n = np.unique(keys & mask, return_counts=True)
            waiting.append((pairs, n))
            if sum(len(x) for x, _ in waiting) > HELD_PAIRS:
                held, waiting = merged(), []
                if len(held[0]) > HELD_PAIRS:
                    yield from passed_on(*held)
                    held = (np.empty(0, np.int64),) * 2
    yield from passed_on(*merged())


def _level(n: str):
    """Binary digits of a count."""
    return F.length(F.bin(n))


def pair_counts(tokens: DataFrame, a_path: str, b_path: str, name: str = "__t") -> DataFrame:
    """(a, b, n, best): documents in which two ids are linked, and whether no B id has more for a.

    ``tokens`` is the written outcome of ``with_tokens``.
    """
    counts = cut(tokens.select(f"{name}.a", f"{name}.b").mapInArrow(
        lambda batches: _count_pairs(batches, (a_path, b_path)), "a int, b int, n long").groupBy("a", "b").agg(
        F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of a vocabulary
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_level(counts: DataFrame, limit: int) -> tuple[int, bool]:
    """The least number of binary digits that at most ``limit`` counts have, and whether some have less."""
    of_level = dict(counts.groupBy(_level("n")).count().collect())
    level, total = 64, 0
    while level > 1 and total + of_level.get(level - 1, 0) <= limit:
        level -= 1
        total += of_level.get(level, 0)
    return level, any(x < level for x in of_level)


def link_statistics(docs: DataFrame, a_path: str, b_path: str, text: str = "text",
                    hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """All columns but the text, with ``STATISTICS`` of each document."""
    _refuse(docs, text, STATISTICS)
    columns = [c for c in docs.columns if c != text]
    tokens = cut(with_tokens(docs, a_path, b_path, text).select(*columns, "__t"), "aligned-ids")
    counts = pair_counts(tokens, a_path, b_path)
    level, some_rare = _hot_level(counts, hot_pairs)
    hot = counts.filter(_level("n") >= level).toArrow()
    a, b, n, best = (hot[c].to_numpy() for c in ("a", "b", "n", "best"))
    held = docs.sparkSession.sparkContext.broadcast((a, b, n, best))
    state: list = []

    def known() -> tuple:
        if not state:
            both = tokenizers(a_path, b_path)
            a, b, n, best = held.value
            pairs = a.astype(np.int64) << both.bits | b
            order = np.argsort(pairs)
            state.extend((both, pairs[order], n[order], best[order]))
        return tuple(state)

    def over(a: pa.Array, b: pa.Array) -> pa.Array:
        both, pairs, n, best = known()
        rows = [_statistics(both, pairs, n, best, found) for found in _aligned(both, a, b)]
        return pa.concat_arrays(rows) if rows else pa.array([], _arrow_result())

    scored = tokens.withColumn("__r", F.arrow_udf(over, _RESULT)("__t.a", "__t.b")).select(*columns, "__r")
    if not some_rare:
        return scored.select(*columns, *(F.col("__r")[c].alias(c) for c in STATISTICS))
    stored = cut(scored.withColumn("__row", F.monotonically_increasing_id()), "link-statistics")
    met = stored.select("__row", F.explode("__r.rare").alias("p")).select("__row", "p.*")
    rare = met.join(counts.filter(_level("n") < level), ["a", "b"]).groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"),
        F.sum(F.col("n") * F.col("times")).alias("__sum"))
    more = {"n_best": "__best", "count_sum": "__sum"}
    return stored.join(rare, "__row", "left").select(*columns, *(
        (F.col("__r")[c] + F.coalesce(F.col(more[c]), F.lit(0)) if c in more else F.col("__r")[c]).alias(c)
        for c in STATISTICS))


def _arrow_result() -> pa.StructType:
    rare = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])
    return pa.struct([*((c, pa.int64()) for c in STATISTICS[:-1]), ("groups_sha256", pa.string()), ("rare", pa.list_(rare))])


def _statistics(both: Tokenizers, pairs: np.ndarray, n: np.ndarray, best: np.ndarray, found: Aligned) -> pa.Array:
    docs = np.arange(found.n + 1)
    keys, times = both.links(found)
    own = keys & ((1 << 2 * both.bits) - 1)
    bounds = np.searchsorted(keys >> 2 * both.bits, docs)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])

    at = np.searchsorted(pairs, own)
    at[at == len(pairs)] = 0
    is_hot = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
    count = np.where(is_hot, n[at], 0) if len(pairs) else np.zeros(len(own), np.int64)
    top = is_hot & best[at] if len(pairs) else is_hot
    rare, mask = np.flatnonzero(~is_hot), (1 << both.bits) - 1
    listed = pa.StructArray.from_arrays(
        [pa.array(own[rare] >> both.bits, pa.int32()), pa.array(own[rare] & mask, pa.int32()), pa.array(times[rare])],
        ["a", "b", "times"])
    ends = np.concatenate(([0], np.cumsum(~is_hot)))[bounds]
    columns = [*(np.diff(np.searchsorted(d, docs)) for d in found.doc),
               np.diff(np.searchsorted(found.doc[0][found.last[0]], docs)),
               per_doc(times), per_doc(np.where(top, times, 0)), per_doc(count * times)]
    return pa.StructArray.from_arrays(
        [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(both.digests(found), pa.string()),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)], fields=list(_arrow_result()))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Add ``a_ids``, ``b_ids``, ``overlaps`` (pairs of token numbers) and ``groups`` (ends in tokens)."""
    names = ("a_ids", "b_ids", "overlaps", "groups")
    _refuse(docs, "", names)

    def over(column: pa.Array) -> pa.Array:
        rows = []
        for _, texts in pieces(encoded(column)):
            both = tokenizers(a_path, b_path)
            found = both.align(*both.tokenize(texts))
            ends = [np.searchsorted(d, np.arange(found.n + 1)) for d in found.doc]
            of_group = np.searchsorted(found.doc[0][found.last[0]], np.arange(found.n + 1))
            met = np.unique(np.stack(found.overlaps, 1), axis=0)
            of_met = np.searchsorted(met[:, 0], ends[0])
            for t in range(found.n):
                (a, a_end), (b, b_end) = ((int(e[t]), int(e[t + 1])) for e in ends)
                g = slice(of_group[t], of_group[t + 1])
                rows.append({
                    "a_ids": found.ids[0][a:a_end].tolist(), "b_ids": found.ids[1][b:b_end].tolist(),
                    "overlaps": [{"a": x - a, "b": y - b} for x, y in met[of_met[t]:of_met[t + 1]].tolist()],
                    "groups": [{"a_end": x + 1 - a, "b_end": y + 1 - b}
                               for x, y in zip(found.last[0][g].tolist(), found.last[1][g].tolist())]})
        ints = pa.list_(pa.int32())
        pairs = [pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())])) for x, y in (("a", "b"), ("a_end", "b_end"))]
        return pa.array(rows, pa.struct(list(zip(names, (ints, ints, *pairs)))))

    return docs.withColumn("__r", F.arrow_udf(over, _ALIGNED)(F.col(text))).select(
        *docs.columns, *(F.col("__r")[c].alias(c) for c in names))


def _refuse(docs: DataFrame, text: str, names: tuple[str, ...]) -> None:
    if taken := [c for c in docs.columns if c != text and (c in names or c.startswith("__"))]:
        raise ValueError(f"these names are taken: {taken}")
