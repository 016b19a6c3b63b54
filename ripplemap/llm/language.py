"""Language ID by compression with a zstandard raw-content dictionary for each language.

Texts are reduced to words: A-Z lower-cased, any other ASCII that is no letter a blank. A
dictionary is labelled text of one language, end to end. A document is compressed with
every dictionary, in blocks so that each part of a long text meets the dictionary and not
mainly itself; the language with the least total wins. ``score`` is how much less it took
than the runner-up, as a share of the runner-up (0 to 1); below ``min_margin`` the
prediction is marked ``rejected``.

Training reads a bounded, documented sample: for each language the documents with the
least hash of their id in each of ``SAMPLES`` parts, and of those ``SAMPLE_CHARS``
characters. So dictionaries have the same size for any corpus. Labels are used for
nothing else; prediction sees whole texts and only texts.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected;
without any labelled text everything is ``und``; ties go to the
language with more labelled documents and, having no margin, are rejected;
repeated rows and empty tables are fine; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import encoded

#: The bound of the training sample: pieces for each language, and characters of each.
SAMPLES, SAMPLE_CHARS = 48, 2_000
#: Bytes compressed at a time. Short, so that a dictionary's share stays visible.
BLOCK = 2_000
LEVEL, MIN_MATCH = 3, 3
#: Languages that training accepts; more means that the label column is something else.
MAX_LANGUAGES = 500
UNDETERMINED = "und"
RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """Words with one blank before, between and behind."""
    return b" %b " % b" ".join(text.translate(_PLAIN).split())


def train(labelled: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows, the most frequent language first."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.lit(7), id_column, text).alias("hash"))
    part = F.pmod(F.xxhash64(F.lit(8), "hash"), F.lit(SAMPLES))
    least = rows.groupBy("lang", part.alias("part")).agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    found = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang}")
    chosen = least.select("lang", "hash")  # at most languages x SAMPLES rows, so broadcast
    sample = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(
        F.max(F.substring("text", 1, SAMPLE_CHARS)).alias("piece"))
    out: dict[str, list[str]] = {row["lang"]: [] for row in found}
    for row in sample.orderBy("lang", "hash").collect():
        out[row["lang"]].append(row["piece"])
    return {name: b"".join(plain(t.encode()) for t in found) for name, found in out.items() if found}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, Callable[[bytes], bytes]]]:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
    out = []
    for name, data in dictionaries:
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=parameters)
        out.append((name, zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress))
    return out


def classify(text: bytes, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float) -> tuple[str, float, bool]:
    if not dictionaries or not _LETTER.search(text.decode()):
        return UNDETERMINED, 0.0, True
    text, sizes = plain(text), []
    for place, (name, compress) in enumerate(_compressors(dictionaries)):
        size = sum(len(compress(text[i:i + BLOCK])) for i in range(0, len(text), BLOCK))
        sizes.append((size, place, name))
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][2], 1.0, False
    score = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][2], score, score < min_margin


def language_column(text: Column, dictionaries: dict[str, bytes], min_margin: float) -> Column:
    held = tuple(dictionaries.items())

    def over(column: pa.Array) -> pa.Array:
        found = [classify(t, held, min_margin) for t in encoded(column)]
        names, scores, rejected = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"])

    return F.arrow_udf(over, RESULT)(text)


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from training, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.005) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``."""
    return docs.withColumn("__lang", language_column(F.col(text), dictionaries, min_margin)).select(
        *docs.columns, *(F.col("__lang")[n].alias(n) for n in ("lang_pred", "score", "rejected")))
