import random

import pytest

import __spark_entry__ as entry_points

WORDS = "Alpha beta Gamma delta épsilon zeta eta THETA iota kappa lambda mu nu xi omikron pi rho".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(5)
    shared, line = prose(rng, 80), "  A line of more than forty characters that many documents Have\t"
    texts = [None, "", " \n\t ", "one", "Two words", "...", "12 34\x1c56\x0b78 9", prose(rng, 6000), "x " * 300]
    texts += [prose(rng, rng.randint(1, 150)) for _ in range(12)]
    texts += [prose(rng, 30) + "\n" + line.upper() + "\n" + prose(rng, 5) + "\n" + line for _ in range(6)]
    texts += [prose(rng, 40) + " " + shared + "\n" + prose(rng, 40) for _ in range(5)] + [shared, shared + "!"]
    texts += [texts[7], texts[9], texts[9], texts[10] + " tail", "Ünï çødé " * 120, "aaaa" * 400]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("s1", None, "s2", "s1")[i % 4], i) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[8], None, None, None), (None, texts[9], "en", "s1", 1), (6, "same id, other text", "en", "s1", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_dir(spark, odd_docs, tmp_path_factory):
    """A folder of tables like the test tables, with the odd documents."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    shared = odd_docs[27][1].split(" ")
    items = [(1, " ".join(shared[50:70])), (2, "Two words"), (10, None), (11, ""), (12, "omikron"),
             (None, "one"), (1, " ".join(shared[50:70])), (3, "... 12 34")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x=://q", "http://example.org/en/12#f",
            "http://example.org?en/1", "ftp://x.com/fr/", "http://ADS-track.example.com/de/9",
            "http://m.ads-track.example.com/q\n/w", "http://badads-track.example.com", "http://free-bets.example.net/",
            "http://com/de/", "http://org", "http://a.com/de/1"]
    pages = [(i, u, "<p>") for i, u in enumerate(urls * 2)] + [(None, "http://h.net/x", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(
        f"{folder}/conversations.parquet")
    return str(folder)


def odd_conversations():
    """Copies of one conversation, shared beginnings, a long one, nulls, tied and repeated turns, gaps in the ids."""
    rng = random.Random(8)
    turn = lambda c, t, x: (c, t, "user" if t % 2 else "assistant", x)
    rows = [turn(100, t, f"line {t} " * (t + 1)) for t in range(7)]
    rows += [turn(c, t, "same" if t < 3 else f"own {c} {t}") for c in range(101, 140) for t in range(rng.randint(1, 8))]
    rows += [turn(c, t, "copy") for c in range(300, 360) for t in range(4)]
    rows += [turn(c, 0, "only turn") for c in range(405, 420)]  # their family's first is missing
    rows += [turn(200, t, f"deep {t}") for t in range(150)] + [turn(207, t, "long tail é🙂") for t in range(60)]
    rows += [(-5, None, None, None), (-5, 3, "user", None), (-5, None, "user", "x"), (0, 1, "user", "tied"), (0, 1, "user", "tied too"),
             (0, 1, "user", "tied"), (None, 0, "user", "no id"), (7, None, None, ""), (7, None, None, "")]
    return rows


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def answer(spark):
    """Rows of a registered query, its first columns, as sorted tuples."""
    def run(name, sf_dir, *columns):
        df = entry_points.queries()[name](spark, sf_dir)
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    return run
