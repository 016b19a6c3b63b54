"""Token alignment against plain definitions, in one pass and with rare pairs joined."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from ripplemap.llm import token_align
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return lambda docs: sorted(brute.op12(docs, a, b, token_align.byte_level()), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_query_equals_plain_python(spark, odd_dir, plain, which):
    folder = odd_dir if which == "odd" else SMALL
    assert rows(entry_points.queries()["op12_token_align"](spark, folder)) == plain(texts(spark, folder))


ODD = ["<|endoftext|> and <s> <0x0A>", " lead", "trail ", "  two  blanks  ", "a\n b\n\n  c\t d \r\n", "a▁b c", " ", "   ", "\n",
       "\x00\x01 é ́e ﬁ", "中文 한국어 🙂🙂‍🙂 İstanbul", "don't we'll 'S 12345 1 2", "x\x1c y\x85 z  w", "=" * 500, "ab" * 300,
       "​ ﻿ x", "});\r\n\r\n }\r"]


def odd_docs():
    rng, alphabet = random.Random(6), list("ab cd  \n\t\r.'s,é中 ▁\x1c\x85🙂<|>0") + ["  ", " 's", "the "]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return list(enumerate([None, "", *ODD, *made, *ODD[:3]]))


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_any_share_of_rare_pairs_gives_the_same(spark, plain, hot):
    docs = spark.createDataFrame(odd_docs(), "doc_id long, text string").repartition(3)
    assert rows(token_align.link_statistics(docs, A, B, hot_pairs=hot)) == plain(odd_docs())


def test_links_by_distinct_ids_and_counts_in_pieces(spark, monkeypatch):
    both, docs = token_align.Tokenizers(A, B), odd_docs()
    of = lambda text: tuple(x.tolist() for x in both.links(both.align(*both.tokenize([(text or "").encode()]))))
    listed = [of(t) for _, t in docs]
    # every group is counted by its distinct ids, pairs are passed on at once
    for name, value in (("LISTED_LINKS", 0), ("HELD_PAIRS", 5)):
        monkeypatch.setattr(token_align, name, value)
    assert [of(t) for _, t in docs] == listed
    counts = {}
    for keys, _ in listed:
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x, pa.binary()) for x in both.tokenize([(t or "").encode() for _, t in docs])], ["a", "b"])
    got = {}
    for out in token_align._count_pairs(iter([batch, batch]), (A, B)):
        for a, b, n in zip(*(c.to_pylist() for c in out.columns)):
            key = (a << both.bits) | b
            got[key] = got.get(key, 0) + n
    assert got == {k: 2 * n for k, n in counts.items()}


def test_overlaps_and_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievably good 12345"), (2, None), (3, "a▁b")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_align.align(docs, A, B).collect()}
    assert found[2]["a_ids"] == [] == found[3]["groups"]
    row = found[1]
    a = Tokenizer.from_file(A).encode(" unbelievably good 12345", add_special_tokens=False)
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    assert row["a_ids"] == a.ids and row["b_ids"] == b.encode("unbelievably good 12345")
    sizes = [[y - x for x, y in a.offsets], [len(b.id_to_piece(i).encode().replace("▁".encode(), b" ")) for i in row["b_ids"]]]
    at = [[sum(s[:i]) for i in range(len(s) + 1)] for s in sizes]
    expected = [(i, j) for i in range(len(sizes[0])) for j in range(len(sizes[1]))
                if max(at[0][i], at[1][j]) < min(at[0][i + 1], at[1][j + 1])]
    assert [(o["a"], o["b"]) for o in row["overlaps"]] == expected
    assert [(at[0][g["a_end"]], at[1][g["b_end"]]) for g in row["groups"]] == [
        (e, e) for e in sorted(set(at[0][1:]) & set(at[1][1:]))]


def test_ids_are_those_of_the_tokenizers_library():
    rng, known = random.Random(12), Tokenizer.from_file(A)
    known.encode_special_tokens = True
    both = token_align.Tokenizers(A, B)
    alphabet = [chr(rng.randrange(0x20, 0x3000)) for _ in range(400)] + [chr(rng.choice((0x1F600, 0x10400, 0x20000)) + rng.randrange(80))
                for _ in range(60)] + list("  \n\t'sdmtlrev0123456789") * 8
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(800)] + [t for t in ODD]
    (ids, count), _ = both._tokens([(" " + t).encode() for t in texts])
    expected = [known.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_taken_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for name in ("n_links", "__r"):
        with pytest.raises(ValueError):
            token_align.link_statistics(docs.withColumn(name, F.lit(1)), A, B)
    with pytest.raises(ValueError):
        token_align.align(docs.withColumn("groups", F.lit(1)), A, B)
