"""Exact top-k search against a plain version."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import topk_search
from tests.conftest import rows


def plain(vectors, k, scale=256, every=50):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), c is None, c or 0) for b, (c, w) in enumerate(good) if b != a)
            out += [(q, r, None if null else c, -s) for r, (s, null, c) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


def search(spark, vectors, k=5, every=50, kind="float", **more):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").repartition(3).selectExpr("*", "1 AS row", "'x' AS score", "2 AS p0", "3 AS rank")
    return rows(topk_search.top_k(df, F.col("vec_id") % every == 0, k=k, **more))


@pytest.mark.parametrize("lists,block", [(2, 1 << 24), (1, 2000), (7, 3000)])
def test_equals_plain_version(spark, lists, block):
    r = random.Random(lists)
    centers = [[r.gauss(0, 0.2) for _ in range(10)] for _ in range(4)]
    vectors = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centers)]) for i in range(400)]
    vectors = [(i, [float(f"{x:.4f}") for x in v]) for i, v in vectors]
    assert search(spark, vectors, every=20, kind="double", lists=lists, block_bytes=block) == plain(vectors, 5, every=20)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    same = [0.5, -0.25, 1.0]
    vectors = [(i, same) for i in range(120)] + [(50, same), (50, [2.0, 0.0, 0.0]), (None, same), (200, None), (250, [None, 1.0, 1.0]), (300, [float("nan"), 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0])]
    vectors += [(400, [-1.0, -1.0, -1.0]), (450, []), (451, [3.0]), (500, [0.0, 0.0, 0.0]), (550, [1e13, -1e12, 0.0])]
    assert search(spark, vectors, kind="double") == plain(vectors, 5)
    assert search(spark, vectors, kind="double", block_bytes=1, k=1) == plain(vectors, 1)


def test_few_rows_and_none(spark):
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (1, [1.0]), (50, [-1.0])]) == plain([(0, [1.0]), (1, [1.0]), (50, [-1.0])], 5)
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert search(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    assert search(spark, [(0, None)]) == []
    empty = topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and rows(empty) == []
