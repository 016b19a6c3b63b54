"""The shared rank queue gives each pre-token the merges that it has alone."""

import random
import struct
from pathlib import Path

import public_tokenizers
import pytest

from ripplemap.llm import bpe

PARTS = ["a", "aa", "ab", "the", "ing", "é", "ß", "  ", "\n", "zz", "0", "!", "tion", "中"]


@pytest.fixture(scope="module")
def data():
    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


def test_shared_queue_equals_own_queues(data):
    ranks, rng = bpe.read_ranks(data), random.Random(3)
    pieces = ["".join(rng.choices(PARTS, k=rng.randint(1, 12))).encode() for _ in range(3000)]
    pieces += [b"a", b"a" * 40, pieces[0], pieces[0]]
    alone = [struct.pack(f"<{len(ids)}I", *ids) for ids in (bpe.merge_bytes(p, ranks) for p in pieces)]
    assert bpe.merge_many(pieces, bpe.PairRanks(ranks)) == alone


def test_blocks_and_generations_do_not_change_ids(data, monkeypatch):
    rng = random.Random(4)
    texts = ["", "a" * 3000] + [" ".join("".join(rng.choices(PARTS, k=4)) for _ in range(200)) for _ in range(20)]
    whole = bpe.ByteBpe(data, public_tokenizers.PATTERN).encode_all(texts)
    for name, value in (("AWAITED", 70), ("SHARED", 5), ("KEPT_TOKENS", 50), ("BLOCK", 30), ("LONG_CHARS", 100)):
        monkeypatch.setattr(bpe, name, value)
    coder = bpe.ByteBpe(data, public_tokenizers.PATTERN)
    assert coder.encode_all(texts) == whole
    assert [coder.decode(ids).decode() for ids in whole] == texts
