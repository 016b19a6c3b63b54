"""Substring dedup against plain Python: shared and hot minimisers, and the sort of a bucket."""

import random

import pytest
from pyspark.sql import functions as F

from ripplemap.llm import superkmer
from tests.llm import brute

SIZE, K = 12, 4


@pytest.fixture(scope="module")
def texts():
    """A passage that many texts share, other shared ones, repeats within a text, copies, nulls, a null id."""
    rng = random.Random(3)

    def some(n):
        return " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))

    everywhere, shared = some(30), [some(rng.randint(10, 40)) for _ in range(8)]
    found = [" ".join((some(rng.randint(0, 15)), everywhere, some(9), rng.choice(shared), some(5))) for _ in range(70)]
    found += [some(40) + "\n" + s + "\t " + s for s in shared] + ["a " * 100, "a " * 60 + "b " * 30, "", None, "a"]
    rows = [(i * 2 + 1, t) for i, t in enumerate(found)] + [(2, found[5]), (1, found[0]), (None, found[9]), (500, found[-9])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1, 3, 20, superkmer.HOT])
def test_every_bound_of_hot_minimisers_equals_brute_force(spark, texts, hot):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = superkmer.remove_repeats(docs, size=SIZE, k=K, hot=hot).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    expected = brute.op9(texts, SIZE)
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert sum(r[2] > 0 for r in expected) > 50


def test_first_of_equal_windows_has_the_least_id(spark):
    strings = [(7, b"k1", b"a b c d", 5, 9), (7, b"k2", b"b c d e", 2, 2), (7, b"k3", b"c d e", 4, 4),
               (8, b"k4", b"a b c", 1, 1), (9, b"k5", b"x y z z", 1, 3)]
    df = spark.createDataFrame(strings, "bucket long, key binary, packed binary, low long, high long")
    got = {bytes(r["key"]): r["least"] for r in superkmer.least_ids(df, 3).collect()}
    # k2 holds its own least ids only, and k4 is alone in its bucket
    assert got == {b"k1": [5, 2], b"k3": [2], b"k5": [1, 1]}
