"""Best-fit packing with large-item matching, on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the histogram of all pieces has at most that many entries whatever the
input. The plan is made on it: lengths above a third of the capacity stand in a sequence at most twice and are matched
greedily, the longest partner that fits first; shorter ones go, longest first, into the smallest gap that holds them.
Equal decisions are taken for many pieces at once. Spark then numbers the pieces of each length and looks up the place
that the plan has for each number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stored
from sparkloom.llm.tokens import vocabulary, word_bpe

CAPACITY = 2048
#: Groups in which pieces of one length are numbered side by side, for so many pieces each.
GROUP_ROWS = 50_000


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece of a row of df: id_col, piece, start, length, ids_crc32. A text's ids, then id 0, are cut only when
    there are more than capacity. A null text is empty: one piece of the one id 0."""
    path = path or vocabulary("word_bpe_49k.json")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences), for so many pieces of each length."""
    left = {size: n for size, n in histogram.items() if n}
    bins: dict[tuple[int, tuple[int, ...]], int] = {}  # (gap, lengths) -> number
    gaps: list[tuple[int, tuple[int, ...]]] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        key = (capacity - sum(lengths), lengths)
        if key in bins:
            bins[key] += n
        else:
            bins[key] = n
            insort(gaps, key)

    def take(key: tuple[int, tuple[int, ...]], n: int) -> None:
        bins[key] -= n
        if not bins[key]:
            del bins[key]
            del gaps[bisect_left(gaps, key)]

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left.get(a):
            partners = large[: bisect_left(large, capacity - a + 1)]
            b = next((b for b in reversed(partners) if left.get(b, 0) > (b == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            left[a] -= n
            if b is not None:
                left[b] -= n
            put((a,) if b is None else (a, b), n)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, (s, ()))
            if at < len(gaps):
                key = gaps[at]
                n = min(bins[key], left[s])
                take(key, n)
                put((*key[1], s), n)
            else:
                full = capacity // s
                n = left[s] // full
                if n:
                    put((s,) * full, n)
                    left[s] -= n * full
                    continue
                put((s,) * left[s], 1)
                n = left[s]
            left[s] -= n
    return [(lengths, n) for (_, lengths), n in sorted(bins.items())]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number after the last, first sequence, offset): pieces of a length are taken in the
    order of their numbers, and a run of them stands in consecutive sequences."""
    out, used, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for size in lengths:
            first = used.get(size, 0)
            out.append((size, first, first + n, sequence, offset))
            used[size] = first + n
            offset += size
        sequence += n
    return out


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(); each sequence holds at most capacity tokens, without gaps.

    The plan has one entry for each distinct set of lengths, of which the histogram bounds the number; pieces are
    numbered within groups of bounded size, so a length that a third of all pieces have is spread over many groups.
    """
    cut = stored(cut)
    spark, total = cut.sparkSession, cut.count()
    groups = max(1, total // GROUP_ROWS)
    dealt = cut.withColumn("_g", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)))
    counts = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "_g").orderBy(id_col, "piece")
    numbered = dealt.withColumn("_i", F.row_number().over(inside) - 1).join(counts, ["length", "_g"])
    numbered = numbered.withColumn("_rank", F.col("_before") + F.col("_i"))

    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = np.array(sorted(slots(plan(histogram, capacity))) or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)
    places = spark.createDataFrame(pa.table({n: table[:, i] for i, n in enumerate(("_len", "_from", "_to", "_seq", "offset"))}))
    met = numbered.join(F.broadcast(places), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return met.select(*cut.columns, (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. See pieces() and pack().

    Rows are taken to have distinct ids; repeated rows and rows with null ids are packed once each, in any order.
    A null text is one piece of one token; a text without white space may have any length. An empty table gives an
    empty result, other columns are ignored.
    """
    return pack(pieces(df, id_col, text_col, capacity, path), id_col, capacity)
