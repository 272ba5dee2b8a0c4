"""Periodic runs against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from sparkloom.llm import periodic_runs
from tests.conftest import rows
from tests.llm.brute import sha


def plain_lyndon(w, i):
    longest = 1
    for e in range(i + 1, len(w) + 1):
        s = w[i:e]
        if all(s < s[k:] for k in range(1, len(s))):
            longest = e - i
    return longest


def plain_runs(w, least=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            x = w[i : i + length]
            if length >= max(least, periods * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(" ".join(kept).encode()))


def test_lyndon_array():
    r = random.Random(1)
    for _ in range(400):
        w = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 24))]
        assert periodic_runs.lyndon_array(w) == [plain_lyndon(w, i) for i in range(len(w))]


def periodic_words(r, n):
    w = []
    while len(w) < n:
        w += [str(r.randrange(4)) for _ in range(r.randint(1, 9))] * r.choice((1, 1, 3, 9))
    return w


def test_runs_of_a_group_of_texts():
    r = random.Random(2)
    texts = [periodic_words(r, r.randint(0, 150)) for _ in range(300)]
    assert periodic_runs.text_runs(texts) == [plain_runs(w) for w in texts]


TEXTS = [None, "", " \n ", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 8 + "a", "A a " * 30, "x", "日本 語 " * 20, "a b " * 25, "once " + "up on a time " * 9 + "end " * 30]


def test_digests(spark):
    r = random.Random(3)
    docs = list(enumerate(TEXTS)) + [(i, " ".join(periodic_words(r, r.randint(1, 200)))) for i in range(20, 120)]
    docs += docs[:7]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS id", "'x' AS start", "2 AS collapsed")
    assert rows(periodic_runs.run_digests(df)) == sorted(map(lambda d: plain(*d), docs), key=lambda t: tuple((x is not None, str(x)) for x in t))
    assert sum(1 for d in docs if zlib.crc32(str(d[0]).encode()) % 10 == 0) > 5


def test_null_ids_other_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a " * 30), ("k", "b c " * 20)], "doc_id string, text string")
    assert [r[:6] for r in rows(periodic_runs.run_digests(df, tails=False))] == [(None, 1, 0, 30, 1, 30000), ("k", 1, 0, 40, 2, 20000)]
    assert rows(periodic_runs.run_digests(df.limit(0))) == []
    assert rows(periodic_runs.find_runs(df)) == [(None, 0, 30, 1), ("k", 0, 40, 2)]
    assert rows(periodic_runs.collapse(df)) == [(None, "a"), ("k", "b c")]


@pytest.mark.parametrize("group", [1, 50, 10**9])
def test_groups_of_rows(monkeypatch, group):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", group)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a " * 40, None, "b " * 30])], ["id", "text"])
    out = [(i, len(w)) for ids, texts in periodic_runs._in_groups(iter([batch, batch.slice(0, 0)]), False) for i, w in zip(ids.to_pylist(), texts, strict=True)]
    assert out == [(1, 40), (2, 0), (3, 30)]


def test_one_long_text():
    words = ("to be or not " * 30_000).split()
    assert periodic_runs.text_runs([words]) == [[(0, 120_000, 4)]]
