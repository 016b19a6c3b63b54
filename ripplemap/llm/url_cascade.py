"""URL filter: rules by host and path, then a Bloom filter cascade over listed hosts.

Alternate levels of the cascade hold the listed keys and the false positives of the
level before, over all keys that the corpus has; the last level has no false positive
left. So membership of every key of that universe is exact, and a page is judged by
reading bits, without a join on its host.

The cascade is split by a hash of the key into shards of at most ``shard_keys`` keys of
the universe. One shard reaches the pages as a scalar value of bounded size; more
shards are found by an equi-join on the shard number. Column functions only.

Defined results: null or malformed addresses have an empty host and path, fit no rule
and are not listed; an empty table gives an empty result; repeated rows are judged each
for itself; other columns are kept, and the operator's own column names must be free.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import cut

#: Bits for each key of a level, and positions that each key sets.
BITS_PER_KEY, HASHES = 8, 4
WORD = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule ``(verdict, host/path)`` that fits, or null."""
    name = verdict = None
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def _positions(key: Column, level: int, bits: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), bits) for i in range(HASHES)))


def _passes(key: Column, level: int, words: Column) -> Column:
    """Whether a level's bit array has all positions of the key."""
    bits = F.size(words).cast("long") * WORD
    found = [
        F.getbit(F.get(words, (p / WORD).cast("int")), F.pmod(p, F.lit(WORD)).cast("int")) == 1
        for p in (F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), bits) for i in range(HASHES))
    ]
    return reduce(lambda a, b: a & b, found)


def _bit_arrays(keys: DataFrame, level: int) -> DataFrame:
    """(shard, words) of one level for rows (shard, key); bits are or-ed before the shuffle."""
    sized = keys.groupBy("shard").agg(F.ceil(F.count("*") * BITS_PER_KEY / WORD).alias("size"))
    set_bits = keys.join(sized, "shard").select(
        "shard", F.explode(_positions(F.col("key"), level, F.col("size") * WORD)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(WORD)).cast("int"))
    unset = sized.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("word"))
    words = set_bits.select("shard", F.floor(F.col("at") / WORD).alias("word"), bit.alias("w")).unionByName(
        unset.withColumn("w", F.lit(0).cast("long"))).groupBy("shard", "word").agg(F.bit_or("w").alias("w"))
    return words.groupBy("shard").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "w"))), lambda x: x["w"]).alias("words"))


def build_cascade(universe: DataFrame, shard_keys: int = 1_000_000) -> tuple[DataFrame, int]:
    """(shard, levels) for rows (key, listed), one per key, and the number of shards.

    ``levels`` is an array of bit arrays. A level is written before the next one reads
    it; each is smaller than the one before by the filter's rate of false positives, and
    levels end when no shard has a false positive.
    """
    shards = max(1, -(-universe.count() // shard_keys))
    keys = cut(universe.select(
        F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(shards)).cast("int").alias("shard"), "key", "listed"),
        "cascade-keys")
    spark, levels = universe.sparkSession, []
    inside, outside = keys.filter("listed"), keys.filter("NOT listed")
    while True:
        held = inside.select("shard", "key")
        if held.isEmpty():
            break
        levels.append(cut(_bit_arrays(held, len(levels)), "cascade-level"))
        wrong = outside.join(levels[-1], "shard").filter(
            _passes(F.col("key"), len(levels) - 1, F.col("words"))).select("shard", "key")
        inside, outside = cut(wrong, "cascade-wrong"), held
    empty = spark.createDataFrame([], "shard int, level int, words array<bigint>")
    rows = reduce(DataFrame.unionByName,
                  (df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)), empty)
    cascade = rows.groupBy("shard").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "words"))), lambda x: x["words"]).alias("levels"))
    return cut(cascade, "cascade"), shards


def _is_listed(key: Column, levels: Column, depth: int) -> Column:
    """The first level that a key fails decides: failed by an even level, it is not listed."""
    listed = F.lit(depth % 2 == 1)
    for level in reversed(range(depth)):
        words = F.get(levels, F.lit(level))
        here = F.size(levels) > level
        listed = F.when(here & _passes(key, level, words), listed).when(
            here, F.lit(level % 2 == 1)).otherwise(F.lit(level % 2 == 1))
    return listed


def mark_listed(rows: DataFrame, key: Column, cascade: DataFrame, shards: int, name: str = "listed") -> DataFrame:
    """Add whether the key of each row is listed, read from the cascade's bits."""
    depth = cascade.agg(F.max(F.size("levels"))).first()[0] or 0
    if depth == 0:
        return rows.withColumn(name, F.lit(False))
    if shards == 1:
        levels = cascade.select("levels").scalar()
        return rows.withColumn(name, _is_listed(key, levels, depth))
    shard = F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")
    held = cascade.select(F.col("shard").alias("__shard"), F.col("levels").alias("__levels"))
    joined = rows.withColumn("__shard", shard).join(held, "__shard", "left")
    marked = F.coalesce(_is_listed(key, F.col("__levels"), depth), F.lit(False))
    return joined.withColumn(name, marked).drop("__shard", "__levels")


def marked_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """(key, listed) for hosts (key), one each: whether the host or a domain above it is in ``domains`` (domain)."""
    labels = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = hosts.select("key", F.explode(above).alias("domain")).join(
        domains.select("domain").distinct(), "domain").select("key").distinct()
    return hosts.join(hits.withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], domains: Sequence[str] | DataFrame,
                url: str = "url", shard_keys: int = 1_000_000) -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``domains`` list hosts with all their subdomains; a page that no rule fits is blocked
    when its host is listed. A list of any length is a table with a column ``domain``.
    """
    named = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    hosts = named.select(F.col("host").alias("key")).distinct()
    if isinstance(domains, DataFrame):
        universe = marked_hosts(hosts, domains)
    else:
        of_list = reduce(lambda a, b: a | b, ((F.col("key") == d) | F.col("key").endswith("." + d) for d in domains),
                         F.lit(False))
        universe = hosts.withColumn("listed", of_list)
    cascade, shards = build_cascade(universe, shard_keys)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = mark_listed(named, F.col("host"), cascade, shards, "__listed")
    return marked.withColumns({
        "rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")),
    }).drop("__listed")
