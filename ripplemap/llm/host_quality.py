"""Quality rules with a host verdict.

Each document gets counts over its whole text and fails or passes the base rules. For each
host (a column) failures are counted; the hosts' failure rates give an empirical beta
prior (method of moments, hosts weighted by their documents), each host's rate is shrunk
towards it, and a document is kept if it passes itself and its host's shrunk rate is not
over the limit. Only counts are shuffled, never texts; hosts are pre-aggregated, and the
verdicts come back through a salted join, so one host may hold any share of the rows.

Defined results: null or empty texts have no word and fail; a null host is a host of its
own; repeated rows count each; an empty table gives an empty result; the operator's own
column names must be free, other columns are kept by ``with_stats``.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import cut, encoded
from ripplemap.operators.skew import SALTS, join_back, key_rows, with_salt

SYMBOLS = "#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that the text has at least twice."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(at, end)
            end = at + size
    return total


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes split at ASCII white space only
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(b"".join(words).decode()), sum(text.count(c.encode()) for c in SYMBOLS),
        len(lines) - len(set(lines)), _repeated_words(words),
    )


def stats_column(text: Column) -> Column:
    def over(column: pa.Array) -> pa.Array:
        columns = list(zip(*map(text_counts, encoded(column)))) or [()] * len(NAMES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return F.arrow_udf(over, f"struct<{','.join(n + ':bigint' for n in NAMES)}>")(text)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each whole text."""
    return docs.withColumn("__stats", stats_column(F.col(text))).select(
        *docs.columns, *(F.col("__stats")[n].alias(n) for n in NAMES))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def shrunk_rates(hosts: DataFrame, bad: str = "bad", n: str = "n") -> DataFrame:
    """Add ``rate``: (bad + a) / (n + a + b), with a beta(a, b) fitted to all hosts.

    Moments of the host rates, weighted by documents, give mean m and variance v between
    hosts, less what sampling adds; a + b = m (1 - m) / v - 1, kept within 1 and 1,000,000.
    """
    rate = F.col(bad) / F.col(n)
    sums = hosts.agg(
        F.sum(n).alias("docs"), F.sum(bad).alias("bads"), F.count("*").alias("hosts"),
        F.sum(F.col(n) * rate * rate).alias("squares"))
    m = F.col("bads") / F.col("docs")
    between = F.col("squares") / F.col("docs") - m * m
    sampling = m * (1 - m) * F.col("hosts") / F.col("docs")
    v = F.greatest(between - sampling, F.lit(1e-9))
    strength = F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6))
    prior = sums.select(F.struct(m.alias("m"), strength.alias("s")).alias("p")).scalar()
    with_prior = hosts.withColumn("__p", prior)
    a = F.col("__p")["m"] * F.col("__p")["s"]
    return with_prior.withColumn("rate", (F.col(bad) + a) / (F.col(n) + F.col("__p")["s"])).drop("__p")


def judge_hosts(stats: DataFrame, host: str = "source", id_column: str = "doc_id",
                limit: float = 0.5) -> DataFrame:
    """``base_failed``, ``host_rate`` and ``kept`` for rows with the counts of ``with_stats``.

    ``stats`` is read twice (rates, then rows), so give a written table.
    """
    marked = with_salt(stats.withColumn("base_failed", base_failed()), [id_column])
    keyed = marked.withColumn("__host", F.struct(host))
    hosts = key_rows(keyed, ["__host"], F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    rated = shrunk_rates(hosts).select("__host", SALTS, F.col("rate").alias("host_rate"))
    judged = join_back(keyed, rated, ["__host"]).drop("__host")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))


def quality(docs: DataFrame, host: str = "source", id_column: str = "doc_id", text: str = "text",
            limit: float = 0.5) -> DataFrame:
    """Counts and verdicts of all documents; the counts are written once, without texts."""
    stats = cut(with_stats(docs, text).drop(text), "host-quality")
    return judge_hosts(stats, host, id_column, limit)
