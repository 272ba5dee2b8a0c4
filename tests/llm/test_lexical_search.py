"""Ranked lexical search against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from sparkloom.llm import lexical_search
from tests.conftest import rows

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


def search(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS item", "2 AS bag", "3 AS row", "'x' AS score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank")
    return rows(lexical_search.ranked_search(d, i, **more))


@pytest.mark.parametrize("cells,block", [(2 << 20, 4 << 20), (50, 100), (1, 1)])
def test_equals_plain_version(spark, monkeypatch, cells, block):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    r = random.Random(block)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(300)] + ["Äß", "日本"]
    text = lambda: r.choice(" -_\n").join(r.choice(vocabulary) for _ in range(r.randint(0, 30)))
    docs = [(i, text()) for i in range(200)]
    docs += [(1000 - i, docs[3][1]) for i in range(60)] + [(2000 + i, docs[i % 9][1].upper()) for i in range(40)]
    items = [(i, text()) for i in range(6)]
    assert search(spark, docs, items, k=7, block_bytes=block) == plain(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;!"), (4, "ab"), (4, "ab"), (None, "AB"), (5, "ab cd " * 40_000), (6, "\x00ab\x7fcd`ef"), (7, "É é İ ı K k"), (8, "x" * 200_000), (9, "日本 語")]
    items = [(1, "ab"), (1, "ab"), (2, None), (3, "cd cd ab zz"), (None, "é K"), (4, "日本"), (5, "...")]
    assert search(spark, docs, items) == plain(docs, items)
    assert search(spark, docs, items, k=1) == plain(docs, items, 1)


def test_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None)], [(1, "a")]) == []
