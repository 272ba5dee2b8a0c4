"""The pipeline, stage by stage, against plain versions; and the numbered queries with SQL against DuckDB."""

from __future__ import annotations

import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm.queries import ORACLES, QUERIES
from sparkloom.llm.tokens import vocabulary
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def cut(text: str, everywhere: dict[bytes, int], length: int = corpus_pipeline.REPEAT_BYTES) -> str:
    data = text.encode()
    gone = bytearray(len(data))
    for x in range(len(data) - length + 1):
        if everywhere[data[x : x + length]] > 1:
            gone[x : x + length] = b"\1" * length
    return bytes(c for c, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA))
        out[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in out["quality_rules"].collect()}
    assert kept
    norm = lambda t: t.translate(dict.fromkeys(map(ord, " \t\n\v\f\r")))
    best: dict[str, tuple] = {}
    for i, t in kept.items():
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t), i))
    kept = {i: kept[i] for _, i in best.values()}
    assert {r.doc_id: r.text for r in out["exact_dedup"].collect()} == kept
    kept = {i: kept[i] for i, (_, c) in brute.jaccard(list(kept.items())).items() if c == i}
    assert {r.doc_id: r.text for r in out["ngram_jaccard_join"].collect()} == kept
    seen: dict[bytes, int] = {}
    for t in kept.values():
        b = t.encode()
        n = corpus_pipeline.REPEAT_BYTES
        for x in range(len(b) - n + 1):
            seen[b[x : x + n]] = seen.get(b[x : x + n], 0) + 1
    kept = {i: cut(t, seen) for i, t in kept.items()}
    got = out["suffix_array_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == kept and all(r.n_chars == len(r.text) for r in got)
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = set()
    for i, t in kept.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(i, k, k * 2048, len(ids[k * 2048 : k * 2048 + 2048]), zlib.crc32(ids[k * 2048 : k * 2048 + 2048].tobytes())) for k in range(-(-len(ids) // 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out["best_fit_packing"].collect()} == want


def test_passages_of_over_50_words_go(spark):
    """A passage of 51 to 70 words in two to nine documents goes from all of them, and what stands around it stays."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.choice((2, 3, 4, 5, 6, 7, 8, 9))))
    own = lambda n: " ".join(word() for _ in range(n))
    data, want = [], {}
    for n in range(51, 71):
        passage = own(n)
        for _ in range(r.randint(2, 9)):
            before, after = own(r.randint(20, 80)), own(r.randint(20, 80))
            want[len(data)] = (before, passage, after)
            data.append((len(data), f"{before} {passage} {after}", "en", "s", 0))
    clean = [(1000 + i, own(200), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(data + clean, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    for i, (before, passage, after) in want.items():
        # By chance the letters next to a passage may be equal too.
        assert got[i].startswith(before[:-9]) and got[i].endswith(after[9:])
        assert len(got[i]) <= len(before) + len(after) + 2 and passage not in got[i]
    assert all(got[i] == text for i, text, *_ in clean)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
