"""The corpus operators with production parameters: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.llm import (
    bpe, decontaminate, host_quality, language, line_dedup, prefix_trie, ring_shards, simhash_bk, suffix_dedup,
    superkmer, token_align, token_files, url_cascade,
)
from ripplemap.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENS, BYTE_TOKENS, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
MARKS = "!#$%&*,.:;?)"
SHARDS = 40
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Domains listed by the URL filter, with all their subdomains.
LISTED_DOMAINS = (
    "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net",
)


def query(run: Query) -> Query:
    _REGISTRY[run.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@query
def op1_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op2_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    tokens = bpe.decode(bpe.encode(_documents(spark, sf_dir), path, pattern), path, pattern)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_host_quality(spark, sf_dir):
    judged = host_quality.quality(_documents(spark, sf_dir, "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_ring_shards(spark, sf_dir):
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = _documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = ring_shards.assign_shards(keys, ["text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_simhash_bk(spark, sf_dir):
    grouped = simhash_bk.near_duplicates(_documents(spark, sf_dir))
    return grouped.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("repeats"))


@query
def op7_language(spark, sf_dir):
    docs = _documents(spark, sf_dir, "lang").withColumn("held_out", language.held_out())
    dictionaries = language.train(docs.filter("NOT held_out"))
    return language.identify(docs, dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.drop_lines(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_superkmer(spark, sf_dir):
    return superkmer.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_url_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.filter_urls(pages, URL_RULES, LISTED_DOMAINS).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op10_url_cascade_listed(spark, sf_dir):
    """The same with a list from the pages: domains (hosts without www, m or blog) with a hyphen in their name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    domain = F.regexp_replace(url_cascade.url_host(F.col("url")), r"^(www|m|blog)\.", "")
    listed = pages.select(domain.alias("domain")).filter(F.substring_index("domain", ".", 1).contains("-")).distinct()
    return url_cascade.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


@query
def op11_orc_tokens(spark, sf_dir):
    folder = shared_path(spark, "token-files")
    token_files.write_tokens(
        _documents(spark, sf_dir), folder, public_tokenizers.path(WORD_TOKENS), end=(1,), by_words=True, marks=MARKS)
    return token_files.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))


@query
def op12_token_align(spark, sf_dir):
    aligned = token_align.link_statistics(
        _documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENS), public_tokenizers.path(PIECES))
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
