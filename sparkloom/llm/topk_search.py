"""Exact top-k inner product search by a three-phase uniform threshold.

Vectors of whole numbers are cut into lists of components; a score is the sum of its lists' scores, and each list is a
column of its own, so that a task reads one list of its rows. For a block of queries at a time:

1. The lists' local best are gathered and scored exactly. The k-th best is a safe cutoff: who scores less than it,
   divided by the number of lists, in every list can't be among the k best.
2. The cutoff is sent to all tasks, and all entries that reach it are collected and summed. What a list didn't give
   scores less than the cutoff there, which bounds each candidate from above; candidates given by all lists raise
   the bar for the others.
3. The candidates left are scored exactly.

Equal vectors score alike and ties go to smaller ids, so of a class of equal vectors only the k + 1 smallest take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import discard, stored

#: Lists that the components are cut into. More lists let more pass: of 51,000 vectors of 64 components 0.06 reach the
#: cutoff of two lists, 0.4 that of four.
LISTS = 2
#: A local list gathers so many times k: the more, the nearer the cutoff comes to the k-th best score.
DEPTH = 2
#: Bytes of the queries that are handled at once: what is sent to the tasks.
BLOCK_BYTES = 16 << 20
#: Scores that a task holds at once.
CELLS = 4 << 20
_NONE = -(1 << 62)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: as doubles where these are exact, else in 64 bits."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return q.astype(np.float64) @ x.T.astype(np.float64) if top < 1 << 53 else q @ x.T


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each line with their rows, in any order."""
    if scores.shape[1] <= k:
        return scores, rows
    at = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(rows, at, 1)


class _Block:
    """Queries with sorted row numbers, sent to tasks."""

    def __init__(self, rows: np.ndarray, ids: pa.Array, vectors: np.ndarray, width: int):
        self.rows, self.ids, self.vectors, self.width = rows, ids, vectors, width

    def scored(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, rows, scores) of some queries at a time against a batch (row, list `at`); a query's own row
        scores _NONE."""
        rows = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(len(rows), self.width)
        step = max(1, CELLS // max(1, len(rows)))
        for q in range(0, len(self.rows), step):
            part = self.rows[q : q + step]
            scores = _products(self.vectors[q : q + step, at * self.width : (at + 1) * self.width], x)
            order = np.argsort(rows)
            near = order[np.minimum(np.searchsorted(rows, part, sorter=order), len(rows) - 1)]
            own = np.flatnonzero(rows[near] == part)
            scores[own, near[own]] = _NONE
            yield q, rows, scores


def _local_best(block: _Block, at: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.rows)
        scores, rows = np.full((n, k), _NONE, np.int64), np.full((n, k), -1, np.int64)
        for batch in batches:
            for q, own, s in block.scored(batch, at) if batch.num_rows else ():
                s, r = _best(s, np.broadcast_to(own, s.shape), k)
                both = np.hstack([scores[q : q + len(s)], s.astype(np.int64)]), np.hstack([rows[q : q + len(s)], r])
                scores[q : q + len(s)], rows[q : q + len(s)] = _best(*both, k)
        q, c = np.nonzero(scores > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.full(len(q), at, np.int32)), pa.array(rows[q, c]), pa.array(scores[q, c])], ["q", "list", "row", "s"])

    return run


def _sufficient(block: _Block, at: int, cutoffs: np.ndarray):
    """Entries of a list that reach their query's cutoff; e is by how much they exceed the greatest score that doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, own, s in block.scored(batch, at) if batch.num_rows else ():
                cut = cutoffs[q : q + len(s)]
                i, c = np.nonzero((s >= cut[:, None]) & (s > _NONE))
                excess = s[i, c].astype(np.int64) - (cut[i] - 1)
                yield pa.RecordBatch.from_arrays([pa.array((q + i).astype(np.int32)), pa.array(own[c]), pa.array(excess)], ["q", "row", "e"])

    return run


def _exact(block: _Block):
    """Scores of pairs (q, row, id, the lists of row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            lists = [c.flatten().to_numpy().reshape(len(q), block.width) for c in batch.columns[3:]]
            score = (block.vectors[q] * np.hstack(lists)).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], block.ids.take(batch.column(0)), pa.array(score)], ["q", "row", "id", "query", "score"])

    return run


def _cut(df: DataFrame, by: list[str], order: list[Column], k: int, exactly: bool = False) -> DataFrame:
    """The first k rows (or only the k-th) of each group; Spark cuts before the shuffle too."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") == k if exactly else F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = LISTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of df where is_query holds: query_id, rank (from 1), vec_id, score of its k best other rows by the inner
    product of floor(scale * component); all, if fewer; ties go to the smaller id.

    Vectors that are null or hold null or non-finite components take no part. A shorter vector counts as filled up
    with zeros. Components beyond 64 bits are cut to them, and sums wrap there. Repeated ids are different rows: each
    can be a query, and each can be found by the other; null ids come last in ties. An empty table, or one without
    queries, gives an empty result; other columns are ignored. Queries are handled in blocks of block_bytes, each of
    which reads the table; the rows found are as many as the threshold lets through, whatever their number."""
    spark = df.sparkSession
    x = F.col(vec_col)
    finite = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf")))
    own = df.filter(F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(x, lambda a: F.floor(F.lit(float(scale)) * a.cast("double"))).alias("v"))
    size = own.agg(F.max(F.size("v"))).first()[0] or 0
    lists = max(1, min(lists, size))
    width = -(-size // lists)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * lists) - F.size("v")))
    parts = [f"p{j}" for j in range(lists)]
    base = stored(own.select(F.monotonically_increasing_id().alias("row"), "id", "is_query", filled.alias("v")).select("row", "id", "is_query", *[F.slice("v", j * width + 1, width).alias(p) for j, p in enumerate(parts)]))
    order = [F.col("id").asc_nulls_last(), F.col("row")]
    found = stored(_cut(base.withColumn("h", F.xxhash64(*parts)), ["h", *parts], order, k + 1).select("row", "id", *parts))

    queries = base.filter("is_query")
    blocks = max(1, -(-queries.count() * (8 * size + 64) // block_bytes))
    out = []
    for b in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").toArrow()
        if not held.num_rows:
            continue
        vectors = np.hstack([held.column(p).combine_chunks().flatten().to_numpy().reshape(held.num_rows, width) for p in parts])
        block = _Block(held.column("row").to_numpy(), held.column("id").combine_chunks(), vectors, width)
        out.append(_search(found, block, parts, k))
    discard(base)
    discard(found)
    kind = base.schema["id"].dataType.simpleString()
    if not out:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score bigint")
    result = spark.read.schema(out[0].schema).parquet(*[o._stored_at for o in out])
    return result.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _search(found: DataFrame, block: _Block, parts: list[str], k: int) -> DataFrame:
    """Stored rows (query, rank, id, score) of a block."""
    n, kind = len(block.rows), found.schema["id"].dataType.simpleString()

    def of_lists(make, schema: str) -> DataFrame:
        each = [found.select("row", p).mapInArrow(make(j), schema) for j, p in enumerate(parts)]
        all_lists = each[0]
        for other in each[1:]:
            all_lists = all_lists.unionByName(other)
        return all_lists

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(found, "row").select("q", "row", "id", *parts)
        return rows.mapInArrow(_exact(block), f"q int, row bigint, id {kind}, query {kind}, score bigint")

    local = of_lists(lambda j: _local_best(block, j, DEPTH * k), "q int, list int, row bigint, s bigint")
    best = _cut(local, ["q", "list"], [F.desc("s"), F.col("row")], DEPTH * k).select("q", "row").distinct()
    bar = np.full(n, _NONE, np.int64)
    for r in _cut(scored(best), ["q"], [F.desc("score"), F.col("row")], k, exactly=True).select("q", "score").collect():  # a number for each query of the block
        bar[r["q"]] = r["score"]
    cutoffs = np.where(bar == _NONE, _NONE + 1, -(-bar // len(parts)))

    entries = of_lists(lambda j: _sufficient(block, j, cutoffs), "q int, row bigint, e bigint")
    candidates = stored(entries.groupBy("q", "row").agg(F.sum("e").alias("e"), F.count("*").alias("given")))
    whole = _cut(candidates.filter(F.col("given") == len(parts)), ["q"], [F.desc("e"), F.col("row")], k, exactly=True).select("q", F.col("e").alias("least"))
    left = candidates.join(whole, "q", "left").filter(F.col("least").isNull() | (F.col("e") >= F.col("least"))).select("q", "row")
    result = _cut(scored(left), ["q"], [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")], k)
    out = stored(result.select("query", "rank", "id", "score"))
    discard(candidates)
    return out


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
