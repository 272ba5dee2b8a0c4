"""The contract's 400 bytes: a repeated passage of over 50 words goes from that length on, not by its words."""

from __future__ import annotations

import random

import pytest

from sparkloom.llm import suffix_dedup
from tests.llm import brute


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))


@pytest.mark.parametrize("size", [399, 400])
def test_passage_of_over_fifty_words(spark, size):
    passage = prose(60, 1)[:size]
    assert len(passage) == size and len(passage.split()) > 50
    # The bytes next to the copies differ, so that no repeat is longer than the passage.
    docs = [(1, prose(40, 2) + "1" + passage + "1" + prose(30, 3)), (2, prose(20, 4) + "2" + passage + "2" + prose(50, 5)), (3, prose(120, 6))]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_digests(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute.suffix(docs)
    assert {i: r[1] for i, r in got.items()} == ({1: 400, 2: 400, 3: 0} if size == 400 else {1: 0, 2: 0, 3: 0})
