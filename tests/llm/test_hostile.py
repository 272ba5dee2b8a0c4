"""Every operator and stage on rows that are null, empty, blank, repeated, very long or without white space, under null
ids and beside columns with clashing names, and on empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe_codec, exact_dedup, lexical_search, license_scan, ngram_join, packing, periodic_runs, quality_rules, substring_dedup, suffix_dedup, token_counts
from tests.conftest import rows
from tests.llm.brute import sha

LONG = "日本語の文章" * 3000
PROSE = " ".join(f"word{i % 37} and{i % 11}" for i in range(120))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, PROSE), (5, PROSE), (None, PROSE), (None, None), (6, "x" * 60_000), (7, LONG), (8, PROSE + " tail"), (9, "a\x00b\x85c")]
CLASHING = ["1 AS id", "'x' AS _id", "2 AS length", "array(1) AS spans", "3 AS k", "4 AS row", "5 AS _hit", "6 AS score", "7 AS piece", "'de' AS lang", "8L AS n_chars", "9 AS n", "10 AS bag", "11 AS _w"]
IDS = sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))

OPERATORS = {
    "op1": bpe_codec.digests, "op2": license_scan.license_scan, "op3": ngram_join.similar_documents, "op4": lambda df: quality_rules.quality_rules(df, df.sparkSession.createDataFrame([(5,)], "doc_id long")),
    "op7": exact_dedup.exact_groups, "op8": substring_dedup.window_digests, "op9": token_counts.token_counts, "op10": suffix_dedup.suffix_digests, "op11": periodic_runs.run_digests,
}


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).selectExpr("*", *CLASHING)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(hostile, name):
    got = OPERATORS[name](hostile).collect()
    ids = [i for n, i in enumerate(IDS) if name != "op3" or i != 5 or n == IDS.index(5)]  # in op3 equal rows are one document
    assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0)) == ids
    same = {tuple(str(v) for k, v in r.asDict().items() if k not in ("kept", "keep_id")) for r in got if r["doc_id"] == 5}
    assert len(same) == 1
    assert OPERATORS[name](hostile.limit(0)).isEmpty()


def test_pieces_cover_each_row(hostile):
    got = packing.best_fit_packing(hostile)
    per = {(r.doc_id, r.piece): r.n for r in got.groupBy("doc_id", "piece").agg(F.count("*").alias("n")).collect()}
    assert per[1, 0] == per[2, 0] == per[4, 0] == 1 and per[5, 0] == 2 and per[None, 0] == 2
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 2048 OR n <> end").isEmpty()
    assert packing.best_fit_packing(hostile.limit(0)).isEmpty()


def test_search(hostile):
    items = hostile.sparkSession.createDataFrame([(1, "word1 and1"), (2, None)], "item_id long, text string")
    assert [i for _, _, i, _ in rows(lexical_search.ranked_search(hostile, items), "item_id", "rank", "doc_id", "score")] == [5, 5, 8, None]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(hostile, tmp_path, name, stage):
    spark = hostile.sparkSession
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, hostile, str(tmp_path))
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    want = {"quality_rules": {5: 2, None: 1, 8: 1}, "exact_dedup": {5: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1}, "suffix_array_dedup": {i: IDS.count(i) for i in IDS}}.get(name, {})
    assert {i: ids.count(i) for i in want} == want
    if name != "best_fit_packing":
        assert got.columns == hostile.columns
    if name == "suffix_array_dedup":
        assert all(sha((r.text or "").encode()) == sha(b"") for r in got.filter("doc_id = 5").collect())
    assert stage(spark, hostile.limit(0), str(tmp_path)).isEmpty()
