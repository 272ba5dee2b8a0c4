"""URL rules in a sorted digest array.

The rules' 64-bit xxhash keys are a sorted array that each Python worker memory-maps. Every URL asks for a few keys
(each suffix of its host, with each rule-path length of its path) by vectorised binary search; a hit is confirmed
against the stored full string, so a digest collision can't decide.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): host and path. The longest rule that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Lists up to this many bytes travel with the tasks; longer ones take url_filter_join().
MAX_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit keys, with the strings they stand for; made once, mapped by each worker."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        pairs = sorted((xxhash.xxh64_intdigest(r.encode()), r, v) for r, v in {r: v for v, r in rules}.items())
        self.keys = np.array([p[0] for p in pairs], dtype="<u8").tobytes()
        self.strings = [p[1] for p in pairs]
        self.verdicts = [p[2] for p in pairs]
        self.lengths = sorted({len(r) - r.index("/") for r in self.strings})
        if len(self.keys) + sum(map(len, self.strings)) > MAX_BYTES:
            raise ValueError("the rules exceed MAX_BYTES; use url_filter_join()")

    def mapped(self) -> np.ndarray:
        if not self.keys:
            return np.empty(0, "<u8")
        with tempfile.TemporaryFile() as f:  # the map keeps the file's bytes after its name and handle are gone
            f.write(self.keys)
            f.flush()
            return np.memmap(f, dtype="<u8", mode="r")


def _probe(frames: Iterator[pd.DataFrame], digests: DigestArray) -> Iterator[pd.DataFrame]:
    keys = digests.mapped()
    for frame in frames:
        row, asked = [], []
        for i, (host, path) in enumerate(zip(frame["host"], frame["path"], strict=True)):
            heads = [path[:n] for n in digests.lengths if len(path) >= n]
            at = 0 if host and heads else -1
            while at >= 0:
                for head in heads:
                    row.append(i)
                    asked.append(host[at:] + head)
                dot = host.find(".", at)
                at = dot + 1 if dot >= 0 else -1
        best: list[int] = [-1] * len(frame)
        if asked and len(keys):
            hashed = np.fromiter((xxhash.xxh64_intdigest(a.encode()) for a in asked), dtype="<u8", count=len(asked))
            place = np.searchsorted(keys, hashed)
            for k in np.flatnonzero((place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == hashed)):
                p = int(place[k])
                while p < len(keys) and keys[p] == hashed[k]:
                    if digests.strings[p] == asked[k] and (best[row[k]] < 0 or len(asked[k]) > len(digests.strings[best[row[k]]])):
                        best[row[k]] = p
                    p += 1
        frame["rule"] = [digests.strings[p] if p >= 0 else None for p in best]
        frame["verdict"] = [digests.verdicts[p] if p >= 0 else "allow" for p in best]
        yield frame


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of df: id_col, host, path, rule, verdict.

    A rule (host, then a path from its first slash) fits its host and all subdomains when the URL's path starts with
    the rule's; the longest decides, and a URL that none fits is allowed (its rule is null). A null URL, or one
    without ://, has an empty host and path and is allowed. Repeated rows give repeated results, an empty table gives
    an empty result, other columns are ignored. URLs may have any length.
    """
    digests = DigestArray(rules)
    rows = df.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(lambda frames: _probe(frames, digests), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def url_filter_join(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As url_filter(), for rule tables (verdict, rule) of any size; it needs ids that don't repeat."""
    split = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("_rh"), F.expr("substring(rule, instr(rule, '/'))").alias("_rp"))
    rows = df.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rows.select("*", F.explode(suffixes).alias("_rh")).join(split, "_rh").filter(F.startswith("path", "_rp") & (F.col("host") != ""))
    best = fits.groupBy(id_col).agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("_best"))
    return rows.join(best, id_col, "left").select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


_VALUES = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in RULES)
SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(v, rule, rh, rp) AS (VALUES {_VALUES}),
m AS (
  SELECT h.page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM h JOIN r ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY 1
)
SELECT h.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
