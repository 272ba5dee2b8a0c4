"""Repeated rows and rows without an id: one row of a group stays in the stages that remove copies."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from sparkloom.llm import exact_dedup, ngram_join
from tests.llm.test_llm_small import BASE, prose

ROWS = [
    (7, BASE, "en"), (7, BASE, "en"), (7, BASE.replace(" ", "\n"), "de"), (9, BASE, "en"),
    (None, prose(80, 21), "en"), (None, prose(80, 21), "en"), (None, prose(80, 21), "fr"),
    (None, prose(80, 22), "en"), (3, prose(80, 22), "en"), (4, prose(80, 23), "en"), (5, prose(80, 24), "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


def test_exact_keeps_one_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for max_bits in (1 << 28, 1 << 15):
        got = exact_dedup.exact_groups(df, max_bits=max_bits).collect()
        assert len(got) == len(ROWS)
        groups = Counter(r.text_sha256 for r in got)
        assert all(r.group_size == groups[r.text_sha256] for r in got)
        assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        assert sorted((r.doc_id for r in got if r.kept), key=str) == [3, 4, 5, 7, None]
    stay = exact_dedup.exact_dedup(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == [3, 4, 5, 7, None]


def test_near_keeps_one_row(spark):
    near = prose(80, 21) + " one more"
    df = spark.createDataFrame([*ROWS, (None, near, "en"), (6, "", "en"), (6, "", "en"), (8, "", "en")], SCHEMA).repartition(3)
    stay = ngram_join.near_dedup(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == [3, 4, 5, 6, 7, 8, None]


def test_a_repeated_document_keeps_its_text(spark):
    df = spark.createDataFrame([(i, t, x, len(t)) for i, t, x in ROWS if i], "doc_id bigint, text string, lang string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = corpus_pipeline.stored(stage(spark, df, ""))
    kept = {r.doc_id: r.text for r in df.collect()}
    assert sorted(kept) == [3, 4, 5, 7] and df.count() == 4
    assert kept[7].split() == BASE.split() and kept[3] == prose(80, 22)
