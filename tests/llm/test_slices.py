"""What small inputs do not reach by themselves: further slices, shards and grid cells, and plain classification."""

import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ripplemap.llm import decontaminate, language, line_dedup, simhash_bk, url_cascade
from tests.llm import brute


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def odd(spark, odd_dir):
    return spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def items(spark, odd_dir):
    return spark.read.parquet(f"{odd_dir}/benchmark.parquet").select("item_id", "text")


def test_decontamination_in_several_slices(odd, items):
    found = decontaminate.contamination(odd, items, slice_pairs=3).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long"),
        F.sha2(F.concat_ws(",", "items"), 256), "contaminated").collect()
    assert ordered(found) == ordered(brute.op1(list(map(tuple, odd.collect())), list(map(tuple, items.collect()))))


def test_removed_spans_leave_no_hit_and_clean_texts_alone(odd, items):
    marked = {(r["doc_id"], r["text"]) for r in decontaminate.contamination(odd, items).filter("NOT contaminated").collect()}
    cleaned = decontaminate.decontaminate(odd, items, action="spans")
    assert decontaminate.contamination(cleaned, items).filter("contaminated").count() == 0
    after = cleaned.collect()
    assert len(after) == odd.count() and marked <= {tuple(r) for r in after}


def test_line_dedup_in_several_slices(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    lines = [f"frequent line {i} " + "x" * rng.randint(30, 60) for i in range(15)] + ["short"] + [
        f"rare line {i} " + "y" * 40 for i in range(5)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame([*docs, (None, lines[0]), (3, None)], "doc_id long, text string")
    found = line_dedup.drop_lines(df, slice_keys=4).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert ordered(found) == ordered(brute.op8(list(map(tuple, df.collect()))))


def test_keys_with_equal_first_halves_lie_beside_the_perfect_hash(spark):
    counts = [(5, 1, 6, 10), (5, 2, 7, None), (9, 3, 5, 4)]
    frequent = spark.createDataFrame(counts, "high long, low long, docs long, last long")
    parts = [(r["shard"], bytes(r["data"])) for r in line_dedup.build_index(frequent, 1).collect()]
    index = line_dedup.Index(1, parts)
    high, low, ids = (np.array(x) for x in ([5, 5, 5, 5, 9, 9], [1, 2, 7, 1, 3, 3], [10, 3, 3, 4, 4, 5]))
    dropped = index.dropped(high.astype(np.uint64), low.astype(np.uint64), ids, np.zeros(6, bool))
    assert dropped.tolist() == [False, True, False, True, False, True]


@pytest.mark.parametrize("nodes", [2, 5, simhash_bk.SHARD_NODES])
def test_simhash_links_in_a_grid_of_cells(spark, nodes):
    rng = random.Random(6)
    values = {0, 1, 2**64 - 1}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            values.add(value)
            for _ in range(rng.randint(1, 5)):
                value ^= 1 << rng.randrange(64)
    values = sorted(values)
    group = {v: {v} for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for v in group[b]:
                    group[v] = group[a]
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    pairs = simhash_bk.links(spark.createDataFrame(signed, "fp long"), 3, nodes)
    found = {v: {v} for v in values}
    for a, b in pairs.collect():
        a, b = a % 2**64, b % 2**64
        if found[a] is not found[b]:
            found[a] |= found[b]
            for v in found[b]:
                found[v] = found[a]
    assert found == group and any(len(g) > 3 for g in group.values())


def test_url_cascade_in_several_shards(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://www.h', id, '.net/x') AS url")
    domains = spark.range(0, 3000, 3).selectExpr("concat('h', id, '.net') AS domain")
    got = url_cascade.filter_urls(pages, (), domains, shard_keys=400).select("page_id", "verdict").collect()
    assert len(got) == 3000 and all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def plain_language(text, dictionaries, margin):
    """Name, score and rejection from fresh compressors, one block of 2,000 bytes after another."""
    text = text or ""
    if not dictionaries or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    words = re.sub(rb"[^A-Za-z\x80-\xff]+", b" ", text.encode()).lower().split(b" ")
    data = b" " + b" ".join(w for w in words if w) + b" "
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    sizes = []
    for content in dictionaries.values():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
        sizes.append(sum(len(tool.compress(data[i:i + 2000])) for i in range(0, len(data), 2000)))
    least = min(sizes)
    rest = sorted(sizes)[1:]
    score = 1 - least / rest[0] if rest else 1.0
    return list(dictionaries)[sizes.index(least)], score, bool(rest) and score < margin


def test_language_equals_plain_compression(spark, odd):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = language.train(known.filter(~language.held_out()))
    assert len(dictionaries) > 1
    docs = known.select("doc_id", "text").unionByName(odd)
    found = language.identify(docs, dictionaries).collect()
    for r in found:
        name, score, rejected = plain_language(r["text"], dictionaries, 0.005)
        assert (r["lang_pred"], r["rejected"]) == (name, rejected) and r["score"] == pytest.approx(score, abs=1e-9)


def test_language_ties_go_to_the_first_and_are_rejected(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "12 ."), (3, None)], "doc_id long, text string")
    same = {"aa": b" some words ", "bb": b" some words "}
    tied, *others = language.identify(docs, same).orderBy("doc_id").collect()
    assert (tied["lang_pred"], tied["score"], tied["rejected"]) == ("aa", 0.0, True)
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in others)
    only = language.identify(docs, {"aa": b" some words "}).orderBy("doc_id").first()
    assert (only["lang_pred"], only["score"], only["rejected"]) == ("aa", 1.0, False)
    assert language.identify(docs, {}).filter("lang_pred = 'und' AND rejected").count() == 3
