"""Equal vectors: the smallest ids win, whatever the batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import vectors


def test_copies_of_a_vector(spark):
    r = np.random.default_rng(5)
    one = r.normal(size=8).astype("f4").tolist()
    data = [(i, "s", one if i % 3 == 2 else r.normal(size=8).astype("f4").tolist()) for i in range(3000)]
    rec = spark.createDataFrame(data, "entry_id bigint, section_id string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, one)], "query_id bigint, embedding array<float>")
    score = {i: round(float(np.dot(np.array(v, "f8"), np.array(one, "f8"))), 6) for i, _, v in data}
    want = sorted(score, key=lambda i: (-score[i], i))[:60]
    assert [x.entry_id for x in vectors.knn(rec, q, 60).orderBy("rank").collect()] == want
    assert [x.entry_id for x in vectors.knn(rec, q, 10, euclid=True).orderBy("rank").collect()] == list(range(2, 32, 3))
    named = rec.withColumn("entry_id", F.format_string("%05d", "entry_id"))
    assert [x.entry_id for x in vectors.knn(named, q, 10, euclid=True).orderBy("rank").collect()] == [f"{i:05d}" for i in range(2, 32, 3)]


def test_ties_after_rounding(spark):
    rec = spark.createDataFrame([(9, None, [1.0, 1e-9]), (10, None, [1.0, 2e-9]), (2, None, [1.0, 0.0]), (3, None, [0.5, 0.0])], "entry_id bigint, section_id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id bigint, embedding array<double>")
    assert [x.entry_id for x in vectors.knn(rec, q, 1).collect()] == [2]


def test_round_is_sparks(spark):
    xs = [0.0000005, 1.0000005, 0.1234565, -0.1234565, 2.5e-7, 1e12 + 0.5, 0.9999995, float("inf"), -0.0, 1 / 3]
    xs += [(i + 0.5) / 1e6 for i in range(500)]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    assert vectors.round6(np.array(xs)).tolist() == got


def test_blocks_of_queries_give_the_same_hits(spark, monkeypatch):
    r = np.random.default_rng(6)
    vector = lambda: r.normal(size=8).astype("f4").tolist()
    one = vector()
    data = [(i, "s", one if i % 3 == 0 else vector()) for i in range(300)] + [(7, None, None), (8, "t", [1.0, 2.0])] + [(5, "u", one)] * 40
    rec = spark.createDataFrame(data, "entry_id bigint, section_id string, embedding array<float>")
    q = spark.createDataFrame([(1, one), *[(i, vector()) for i in range(2, 30)], (99, None)], "query_id bigint, embedding array<float>")
    result = lambda df: sorted((x.query_id, x.rank, x.entry_id, x.score) for x in df.collect())
    for euclid in (False, True):
        want = result(vectors.knn(rec, q, 12, euclid))
        assert len(want) == 29 * 12
        with monkeypatch.context() as m:
            m.setattr(vectors, "QUERY_BYTES", 512)
            m.setattr(vectors, "PART_RECORDS", 70)
            assert result(vectors.knn(rec, q, 12, euclid)) == want
