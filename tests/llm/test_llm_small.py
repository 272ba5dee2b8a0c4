"""Operators on small hostile fixtures, against plain versions or the packages that define the results."""

from __future__ import annotations

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import bpe_codec, components, exact_dedup, license_scan, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filter
from sparkloom.llm.tokens import byte_bpe, vocabulary, word_bpe
from tests.conftest import rows
from tests.llm import brute

os.environ["TOKENIZERS_PARALLELISM"] = "false"
R = random.Random(7)
WORDS = ["the", "of", "raft", "and", "Log", "entry", "é", "x1", "tion", "ß", "日本", "a.b"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


BASE, SHARED = prose(300, 1), prose(90, 2)
TEXTS = [
    None, "", "   \n\t ", "one", "one two three four", "One Two three FOUR", BASE, BASE, BASE + " extra tail words here now", BASE.replace("raft", "craft", 2), prose(200, 3) + " " + SHARED, SHARED + " " + prose(220, 4),
    prose(40, 5) + "\n" + SHARED + "\n" + prose(30, 6), "same " * 500, "ab" * 900, " ".join(["x y z"] * 200), BASE.replace(" ", "\n"), prose(6000, 8), "<|endoftext|> a <|startoftext|>", "a\x00b \x1c c  d", "é " * 300,
]
DOCS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "kept", 1) for i, t in DOCS], "doc_id bigint, text string, k string, kept string, keep_id int").repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_suffix_dedup(spark, docs):
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_digests(docs).collect()}
    assert got == brute.suffix(DOCS)
    cut = suffix_dedup.suffix_dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    assert suffix_dedup.suffix_digests(empty(spark)).count() == 0


def test_suffix_groups_that_are_split(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_digests(docs).collect()} == brute.suffix(DOCS)


def test_suffix_two_lengths(spark, docs):
    """The longer strings, found inside the spans of shorter ones."""
    want, wide = brute.suffix(DOCS, 400), brute.suffix(DOCS, 120)
    got = suffix_dedup.suffix_digests(docs, shorter=120).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: (*w, wide[i][1]) for i, w in want.items()}
    with pytest.raises(ValueError):
        suffix_dedup.suffix_digests(docs, length=50)


def _pairwise(members, needed):
    """The windows that each member shares with another one, compared one by one."""
    out = []
    for i, (before, after) in enumerate(members):
        others = [m for j, m in enumerate(members) if j != i]
        able = lambda b, a, d: d <= len(b) and needed - d <= len(a)
        at = [d for d in range(needed + 1) if able(before, after, d) and any(able(b, a, d) and b[len(b) - d :] == before[len(before) - d :] and a[: needed - d] == after[: needed - d] for b, a in others)]
        out.append((min(at), max(at)) if at else None)
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 12), st.lists(st.tuples(st.text("ab", max_size=12), st.text("ab", max_size=12)), min_size=2, max_size=12))
def test_neighbours_decide_windows(needed, members):
    members = [(b[-needed:].encode(), a[:needed].encode()) for b, a in members]
    assert suffix_dedup.resolve(members, needed) == _pairwise(members, needed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(c % 2 + 97 for c in b)), min_size=1, max_size=12))
def test_deep_shallow_order(strings):
    order = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in suffix_dedup.blind_trie(strings, list(range(len(strings))))] == sorted(strings)


def test_window_dedup(spark, docs):
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.window_digests(docs).collect()}
    assert got == brute.windows13(DOCS)
    assert substring_dedup.window_digests(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=13, max_size=90))
def test_equal_windows_have_equal_symbols(numbers):
    names = np.array([n * 0x9E3779B97F4A7C15 % (1 << 64) for n in numbers], np.uint64)
    keys = substring_dedup.window_symbols(names)
    seen: dict[tuple, int] = {}
    for x in range(len(numbers) - 12):
        assert seen.setdefault(tuple(numbers[x : x + 13]), int(keys[x])) == int(keys[x])


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    assert got == brute.jaccard(DOCS)
    assert ngram_join.similar_documents(empty(spark)).count() == 0
    stay = ngram_join.near_dedup(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [i for i, (_, c) in sorted(brute.jaccard(DOCS).items()) if c == i]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", " ", "\n", "\x0b", "\x85", "\xa0", "é", "日", "x" * 70, "y" * 8]), max_size=25).map("".join), min_size=1, max_size=8))
def test_shingle_hashes(texts):
    """Equal sets have equal hashes, others others, also in a part of an Arrow array."""
    got = list(ngram_join.shingle_sets(pa.array(["x", *texts, ""]).slice(1, len(texts))))
    seen: dict[bytes, frozenset] = {}
    for t, s in zip(texts, got, strict=True):
        want = frozenset(brute.shingles(t))
        assert len(s) == len(want) and seen.setdefault(s.tobytes(), want) == want


def family(n: int, edits: int, size: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text with some words changed, of several sizes, and tiny sets at the limit."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"e{r.randint(0, 10**6)}"
        out.append((seed * 1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("common", "group"), [(200, 3000), (2, 4)])
def test_jaccard_families(spark, monkeypatch, common, group):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", group)
    data = family(40, 4, 120, 1) + family(30, 2, 40, 2) + family(20, 1, 13, 3) + family(20, 1, 9, 4) + family(10, 12, 600, 5)
    passage = " ".join(f"p{i}" for i in range(70))
    data += [(9000 + i, passage + " " + prose(60, 100 + i)) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard(data)


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 11), (7, 7)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(40)]
    got = dict(rows(components.components(spark.createDataFrame(links, "u bigint, v bigint"))))
    assert [got[x] for x in (1, 2, 3, 4, 10, 12, 129, 240)] == [1, 1, 1, 1, 10, 10, 100, 200]


def test_exact(spark, docs):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
    want = {}
    for i, t in DOCS:
        same = [(-len(u or ""), j) for j, u in DOCS if norm(u) == norm(t)]
        want[i] = (min(same)[1], len(same), min(same)[1] == i, hashlib.sha256(norm(t).encode()).hexdigest())
    for max_bits in (1 << 28, 1 << 15):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, max_bits=max_bits).collect()}
        assert got == want
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == [i for i, w in sorted(want.items()) if w[2]]
    hot = spark.createDataFrame([(i, "same text") for i in range(500)] + [(1000 + i, f"text {i // 2}") for i in range(500)], "doc_id bigint, text string")
    assert exact_dedup.exact_dedup(hot).count() == 251


def test_codec_and_counts(spark, docs):
    from tokenizers import Tokenizer

    lib, words = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coded = {r[0]: tuple(r[1:]) for r in bpe_codec.digests(docs).collect()}
    counted = {r[0]: r for r in token_counts.token_counts(docs).collect()}
    for i, t in DOCS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert coded[i] == (len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha(text.encode())), i
        n = len(words.encode(t or "", add_special_tokens=False).ids)
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len((t or "").encode()), n, n > 2048), i
    trip = bpe_codec.decode(bpe_codec.encode(docs))
    assert {r.doc_id: r.text for r in trip.collect()} == {i: t or "" for i, t in DOCS}
    long = next(t for _, t in DOCS if t and len(t) > 30_000)
    fit = counted[[t for _, t in DOCS].index(long)].chars_in_limit
    assert len(words.encode(long[:fit], add_special_tokens=False).ids) <= 2048 < len(words.encode(long[: fit + 40], add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e'1.é日 \n\t\x00\x1c\xa0ΣİA<|>\u0301\u1100\u1161"), max_size=80))
def test_encoders_equal_the_package(text):
    from tokenizers import Tokenizer

    global _LIBS
    if "_LIBS" not in globals():
        _LIBS = [Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    assert np.frombuffer(word_bpe(vocabulary("word_bpe_49k.json")).encode(text), "<u4").tolist() == _LIBS[0].encode(text, add_special_tokens=False).ids
    assert bpe_codec.ChunkCodec(byte_bpe(vocabulary("byte_bpe_50k.json"))).encode(text * 9) == _LIBS[1].encode(text * 9, add_special_tokens=False).ids
    table = token_counts.PrefixTable(word_bpe(vocabulary("word_bpe_49k.json")), text)
    for i in range(len(text) + 1):
        assert table.at(i) == len(_LIBS[0].encode(text[:i], add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["'ll've'r!!'s'", "x<|endoftext|>y<|endoft", "naïveÜBERgrößenΣίσυφος", "国际化与本地化的日本語カタカナ한국어" * 20, "Ab0/+=" * 60, "cafe\u0301" * 30, "\u1100\u1161\u11a8" * 20])
def test_counts_of_all_prefixes(text):
    """Words without white space: each prefix, and the prefix that fits, against the package."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    table = token_counts.PrefixTable(word_bpe(vocabulary("word_bpe_49k.json")), text)
    want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert [table.at(i) for i in range(len(text) + 1)] == want
    places = {0, len(text), *word_bpe(vocabulary("word_bpe_49k.json")).prefix_counts(text)[0]}
    for limit in (0, 1, 2, 5, 17, 1000):
        assert table.fitting(limit) == max(i for i in places if want[i] <= limit)


def test_long_texts_without_white_space(spark):
    r = random.Random(5)
    han = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(200_000))
    data = [(1, han), (1, han), (2, "a" * 500_000), (None, None), (3, "x" * 70 + " " + "\t\n" * 1000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in data], "doc_id bigint, text string, n_tokens int, n_bytes int")
    begun = time.monotonic()
    got = sorted(rows(token_counts.token_counts(df)), key=str)
    assert time.monotonic() - begun < 60
    assert len(got) == 5 and [g for g in got if g[0] is None] == [(None, 0, 0, False, 0)]
    for i, n_bytes, n, over, fit in got:
        if i in (1, 2):
            text = dict(data)[i]
            table = token_counts.PrefixTable(word_bpe(vocabulary("word_bpe_49k.json")), text[:20_000])
            assert over and n > 2048 and n_bytes == len(text.encode()) and table.at(fit) <= 2048 < table.at(fit + 1)
    assert token_counts.token_counts(empty(spark)).count() == 0 and bpe_codec.digests(empty(spark)).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.best_fit_packing(docs).collect()
    by_doc: dict[int, list] = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in DOCS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            assert (r.start, r.length, r.ids_crc32) == (r.piece * 2048, len(ids[r.start : r.start + 2048]), zlib.crc32(ids[r.start : r.start + 2048].tobytes()))
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.best_fit_packing(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 50), max_size=30))
def test_plan_places_every_piece(histogram):
    got: dict[int, int] = {}
    for lengths, n in packing.plan(histogram, 100):
        assert sum(lengths) <= 100 and sum(3 * x > 100 for x in lengths) <= 2
        for x in lengths:
            got[x] = got.get(x, 0) + n
    assert got == {k: v for k, v in histogram.items() if v}


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(6,), (7,), (99,)], "doc_id bigint")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted).collect()}
    for i, t in DOCS:
        w = brute.words(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = set()
        for k, x in enumerate(windows):
            if windows.count(x) > 1:
                hit.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed), i
        assert not (r.kept and failed)
    assert got[6].kept and got[6].score == got[7].score
    assert quality_rules.quality_rules(empty(spark), trusted).count() == 0
    none = quality_rules.quality_rules(docs, trusted.limit(0))
    assert none.filter("score <> 0").count() == 0 and none.filter("kept = base_failed").count() == 0


def test_quality_scores_by_hand(spark):
    """The log ratios, from xxhash and plain counts."""
    import math

    import xxhash

    texts = [(i, prose(30, i)) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality_rules.quality_rules(df, df.filter("doc_id < 3").select("doc_id")).collect()}

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def grams(t: str) -> list[int]:
        w = t.split()
        h = lambda s, seed: xxhash.xxh64_intdigest(s.encode(), seed)
        return [signed(h(a, 42)) % 8192 for a in w] + [signed(h(b, h(a, 42))) % 8192 for a, b in zip(w, w[1:], strict=False)]

    target, raw = [0] * 8192, [0] * 8192
    for i, t in texts:
        for g in grams(t):
            raw[g] += 1
            target[g] += i < 3
    p = [(b + 1) / (sum(raw) + 8192) for b in raw]
    weight = [round(1e6 * math.log((a + 200_000 * q) / (sum(target) + 200_000) / q)) for a, q in zip(target, p, strict=True)]
    assert got == {i: sum(weight[g] for g in grams(t)) for i, t in texts}


def test_licenses(spark):
    data = [(1, "x y. Released under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (3, None), (4, "nothing"), (4, "nothing")]
    got = rows(license_scan.license_scan(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id", "n_known", "licenses")
    assert got == [(1, 1, "MIT"), (2, 2, "Apache-2.0|Apache-2.0-header"), (3, 0, ""), (4, 0, ""), (4, 0, "")]
    assert license_scan.license_scan(empty(spark)).count() == 0


def test_urls(spark):
    urls = ["http://A.example.NET/en/x?y", "https://x.net/", "http://net", "http://net?/", "http://xnet/", "http://example.com/de/1", "http://example.com/den", "http://a.org/fr/", None, "no scheme", "http://", "http://b.net:80/", "x://y.net/z://w.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.url_filter(df)
    assert [(r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [
        ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"),
    ]
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, rule string")
    assert rows(url_filter.url_filter_join(df, rules)) == rows(got)
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert url_filter.url_filter(df, []).filter("verdict = 'block'").count() == 0
    assert url_filter.url_filter(df.withColumn("host", F.lit("z"))).columns == ["page_id", "host", "path", "rule", "verdict"]
