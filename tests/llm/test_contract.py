"""The ten queries against plain Python (or SQL) on odd rows and on the smallest tables."""

import zlib
from base64 import b64decode

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op5_simhash_bk": ("doc_id", "fingerprint", "component_id"),
    "op6_suffix_dedup": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op9_superkmer": ("doc_id", "n_words", "n_removed", "kept_sha256"),
    "op8_line_dedup": ("doc_id", "n_lines", "n_dropped", "kept_sha256"),
}
BRUTE = {"op5_simhash_bk": brute.op5, "op6_suffix_dedup": brute.op6, "op8_line_dedup": brute.op8,
         "op9_superkmer": brute.op9}


@pytest.fixture(params=["odd", "small"])
def folder(request, odd_dir):
    return odd_dir if request.param == "odd" else SMALL


@pytest.fixture
def docs(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", BRUTE)
def test_query_equals_brute_force(answer, folder, docs, name):
    assert answer(name, folder, *COLUMNS[name]) == ordered(BRUTE[name](docs))


def test_decontamination(spark, answer, folder, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    name = "op1_decontaminate"
    assert answer(name, folder, *COLUMNS[name]) == ordered(brute.op1(docs, items))


def test_bpe_equals_tiktoken(answer, folder, docs):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc, text in docs:
        ids = known.encode_ordinary(text or "")
        expected.append((doc, len(ids), brute.sha(brute.packed(ids)), brute.sha(text or "")))
    assert answer("op2_byte_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(expected)


def test_quality_counts(answer, folder, docs):
    got = answer("op3_host_quality", folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "base_failed")
    expected = []
    for doc, text in docs:
        counts = brute.op3_counts(text)
        expected.append((doc, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    assert got == ordered(expected)


def test_shards_keep_every_row_and_are_even(answer, folder, docs):
    got = answer("op4_ring_shards", folder, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    expected = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs]
    assert ordered(r[:3] for r in got) == ordered(expected)
    slots = {}
    for row in got:
        assert row[3] == "rows" and row[6] is None and 0 <= row[4] < 40
        slots.setdefault(row[4], []).append(row[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, ())) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_language(answer, folder, docs):
    got = answer("op7_language", folder, "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(docs)
    assert all(0 <= score <= 1 for *_, score in got)
    assert {(d, h) for d, h, *_ in got} == {
        (d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in docs}
    letters = {d: any(c.isalpha() for c in t or "") for d, t in docs if d is not None}
    assert all(pred == "und" for d, _, pred, _ in got if d in letters and d != 6 and not letters[d])


def test_language_held_out_accuracy(spark, answer):
    got = answer("op7_language", "/root/testdata/sf0.01", "doc_id", "held_out", "lang_pred")
    known = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    right = [known[d] == pred for d, held, pred in got if held]
    assert sum(right) / len(right) > 0.97


@pytest.mark.parametrize("name", ["op3_host_quality", "op10_url_cascade"])
def test_odd_rows_equal_sql(spark, odd_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd_dir}/{table}.parquet/*.parquet'")
    df = entry_points.queries()[name](spark, odd_dir)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry_points.oracle_sql()[name]}) q").fetchall()
    assert ordered(tuple(r) for r in df.collect()) == ordered(found)


@pytest.mark.parametrize("name", [n for n in entry_points.queries() if n.startswith("op")])
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    df = entry_points.queries()[name](spark, empty_dir)
    assert df.collect() == [] and len(df.columns) > 2
