"""Token files: equal to the library on whole texts, in order, pruned by metadata."""

import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from ripplemap.llm import token_files
from tests.llm import brute
from tests.test_plans import plan

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def several_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain(docs):
    """(doc_id, start, n_tokens, crc) by the library, text by text."""
    known, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(brute.packed(ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "small"])
def test_query_equals_the_library(spark, odd_dir, several_parts, which):
    folder = odd_dir if which == "odd" else SMALL
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = entry_points.queries()["op11_orc_tokens"](spark, folder)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == plain(docs)


ODD = ["<|endoftext|> <|startoftext|>x", "a<|endoftext|>b c d", "ΑΣ ΑΣ.", "é ́e İ", "x\x1cy\x85z",
       "don't WE'LL 1234 ...!!", "w" * 5000 + " " + "Ab" * 40, "<|ENDOFTEXT|> x", "Wow... it's, e.g., (so) good!!) né&&& É, e\u0301, x÷. 5. a.'", "\x00 ﻿", "한국어 中文 🙂🙂", "a▁b"]


def ids_of(encode, texts):
    ids, sizes = encode(pa.array(texts, pa.string()))
    return ids.tolist(), sizes.tolist()


def test_words_one_by_one_give_the_ids_of_whole_texts():
    by_words, whole = token_files.Encoder(PATH, True, "!#$%&*,.:;?)"), token_files.Encoder(PATH, False)
    texts = ODD + [" ".join(ODD), "\n".join(reversed(ODD)), "", " \t\x0b lead and trail \r\n"]
    assert ids_of(by_words, texts) == ids_of(whole, texts) and ids_of(by_words, texts[::-1]) == ids_of(whole, texts[::-1])
    assert ids_of(by_words, []) == ([], []) and ids_of(by_words, ["", " "]) == ([], [0, 0])


def test_kept_words_are_bounded_and_ids_stay_right(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
    by_words, whole = (token_files.Encoder(PATH, b) for b in (True, False))
    for i in range(30):
        texts = [f"word{i} again some more{i % 3} and w{i * i}", "again and " + "z" * 60]
        assert ids_of(by_words, texts) == ids_of(whole, texts)
        assert len(by_words.young) <= 5 + 12


def test_files_are_in_order_with_stripes_and_filters(spark, tmp_path, several_parts):
    docs = spark.range(4000).select((F.col("id") * 7 % 4001).alias("doc_id"), F.expr(
        "array_join(transform(sequence(1, 40), x -> concat('w', pmod(hash(id, x), 5000))), ' ')").alias("text"))
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, PATH, by_words=True, stripe_bytes=1 << 16, index_rows=1000)
    parts = [r.asDict() for r in token_files.read_parts(spark, folder).orderBy("part").collect()]
    assert len(parts) > 1 and sum(p["n_docs"] for p in parts) == 4000
    for before, after in zip(parts, parts[1:]):
        assert before["last_id"] < after["first_id"] and before["offset"] + before["n_tokens"] == after["offset"]
    files = sorted((tmp_path / "tokens" / "tokens").glob("*.orc"))
    assert len(files) == len(parts)
    stripes = [pyarrow.orc.ORCFile(f) for f in files]
    assert sum(f.nstripes for f in stripes) > len(files)
    ids = [i for f in stripes for i in f.read(["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids) and len(ids) == 4000
    everything = {r["doc_id"]: r["start"] for r in token_files.read_tokens(spark, folder).collect()}
    some = token_files.read_tokens(spark, folder, [5, 77, 999_999])
    assert "PushedFilters: [In(doc_id, [5,77" in plan(some)
    assert {r["doc_id"]: r["start"] for r in some.collect()} == {i: everything[i] for i in (5, 77)}


def test_other_columns_may_have_any_names(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b", 1), (1, "a", 2)], "key long, body string, part long").withColumn("ids", F.lit(0))
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, PATH, id_column="key", text="body", end=(7, 8))
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids"][-2:]) for r in token_files.read_tokens(spark, folder).collect()]
    assert sorted(found) == [(1, 0, 3, [7, 8]), (2, 3, 3, [7, 8])]
