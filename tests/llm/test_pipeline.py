"""The pipeline's stages on odd rows, and end to end against plain Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplemap.llm import language
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def expected(rows, dictionaries, items):
    """(doc_id, text) that the stages before the last keep, for rows (doc_id, text)."""
    held = tuple(dictionaries.items())
    docs = [(d, t) for d, t in rows if not language.classify((t or "").encode(), held, 0.005)[2]]
    lines = {}
    for d, t in docs:
        for k in {x.strip(brute.BLANK).translate(brute.LOWER) for x in (t or "").split("\n")}:
            lines.setdefault(k, []).append(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in lines.items() if len(k) >= 40 and len(v) >= 5}
    docs = [(d, "\n".join(x for x in (t or "").split("\n") if last.get(
        key := x.strip(brute.BLANK).translate(brute.LOWER), d) == d or key not in last)) for d, t in docs]
    first = {}
    for (d, t), (_, _, group) in zip(docs, brute.op5(docs)):
        if d is not None and d == group:
            first.setdefault(group, (d, t))
    docs = list(first.values())
    return [x for x, (*_, hit) in zip(docs, brute.op1(docs, items)) if not hit]


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    dictionaries = language.train(docs.filter(~language.held_out()))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = expected(rows, dictionaries, items)
    batch = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == batch
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, _ in kept)
    assert all(r["round_trip"] and len(r["token_bytes"]) == 4 * r["n_tokens"] for r in found)
    assert 0 < len(found) < len(rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_whatever_their_names(spark, odd_dir, stage):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    wide = docs.withColumns({n: F.lit(n) for n in ("fp", "rejected", "digest", "n_lines", "component", "__marks")})
    out = stage(spark, wide, odd_dir)
    assert out.columns == wide.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count()
    assert all(r[n] == n for r in rows for n in ("fp", "rejected", "digest", "n_lines", "component", "__marks"))


def test_near_dedup_keeps_one_of_rows_that_differ_in_other_columns(spark, odd_dir):
    text = "one two three four five"
    rows = [(1, text, "en", None, 1), (1, text, None, "en", 1), (1, text, "en", None, 1), (None, text, "de", "a", 2),
            (2, "quite another text about something else", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [[tuple(r) for r in corpus_pipeline.near_deduplication(spark, d, odd_dir).collect()]
            for d in (docs, docs.repartition(3))]
    assert sorted(kept[0]) == sorted(kept[1]) and sorted(r[0] for r in kept[0]) == [1, 2]


def test_stages_take_empty_tables(spark, empty_dir):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty_dir).collect() == []
