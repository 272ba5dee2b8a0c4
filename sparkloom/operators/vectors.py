"""Exact vector search over Parquet vector tables, and their refresh."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that travel with the tasks; more are searched in blocks of about so many.
QUERY_BYTES = 32 << 20
#: Records of a part that meets a block of queries.
PART_RECORDS = 100_000
#: Scores, and components of records, that a task holds at once as numbers.
BLOCK_CELLS = 1 << 20
#: Partial hits that a block of queries may have in a part, where they are gathered.
BLOCK_HITS = 4_000_000


def l2_normalize(v: Column) -> Column:
    """V1: a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, (x / norm).cast("float")).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    """V2 as an expression; vectors of different lengths have no score."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def round6(x: np.ndarray) -> np.ndarray:
    """As Spark's round(x, 6): half up on the decimal form; only numbers near a half need it in full."""
    scaled = np.where(np.abs(x) < 2**32, np.abs(x) * 1e6, 0)
    out = np.where(np.abs(x) < 2**32, np.copysign(np.floor(scaled + 0.5) / 1e6, x), x)
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-9 + scaled * 1e-15), strict=True):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _best(names: list, matrix: np.ndarray, batch: pa.RecordBatch, k: int, euclid: bool) -> Iterator[pa.RecordBatch]:
    """Per query, the k best entries of each slice of a batch of records, in the order of the result. Records and queries
    meet in blocks of BLOCK_CELLS, so that what a task holds doesn't grow with the number of queries."""
    dims = matrix.shape[1] if len(names) else 0
    lengths = batch.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == dims)
    if not len(fits) or not dims:
        return
    for at in range(0, len(fits), rows := max(1, BLOCK_CELLS // dims)):
        part = batch.take(pa.array(fits[at : at + rows]))
        entries = pc.rank(part.column("entry_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
        once = len(np.unique(entries)) == len(entries)
        x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        for q in range(0, len(names), some := max(1, BLOCK_CELLS // len(x))):
            yield _best_of_block(names[q : q + some], matrix[q : q + some], part, x, entries, once, k, euclid)


def _best_of_block(names: list, matrix: np.ndarray, part: pa.RecordBatch, x: np.ndarray, entries: np.ndarray, once: bool, k: int, euclid: bool) -> pa.RecordBatch:
    """The hits of some queries in some records, whose scores are held at once; once: entries stand in one record each."""
    scores = matrix @ x.T
    if euclid:
        scores = 1 / (1 + np.sqrt(np.maximum(0, (matrix**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * scores)))
    rounded = round6(scores)
    # In the order of the result: no number counts as the largest.
    keys = np.where(np.isnan(rounded), -np.inf, -rounded)
    found = []
    for q, row in enumerate(keys):
        # The best record of each entry, then the first k entries in the order of the result: an entry that the
        # whole needs has fewer than k before it in any batch.
        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if once and 0 < k < len(row) else np.arange(len(row))
        order = near[np.lexsort((-scores[q, near], entries[near], row[near]))]
        found.append(order[:k] if once else order[np.sort(np.unique(entries[order], return_index=True)[1])][:k])
    best = np.concatenate(found)
    asked = np.repeat(np.arange(len(names)), [len(f) for f in found])
    ids = part.take(pa.array(best))
    return pa.RecordBatch.from_arrays([pa.array([names[q] for q in asked], pa.int64()), ids.column("entry_id"), ids.column("section_id"), pa.array(rounded[asked, best])], ["query_id", "entry_id", "section_id", "score"])


def _hit_type(records: DataFrame) -> str:
    return f"query_id bigint, entry_id {records.schema['entry_id'].dataType.simpleString()}, section_id string, score double"


def _search(records: DataFrame, queries: DataFrame, k: int, euclid: bool) -> DataFrame:
    """Partial hits of a query set of QUERY_BYTES at most, which travels with the tasks."""
    rows = queries.collect()
    names, matrix = [q[0] for q in rows], np.array([q[1] for q in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _best(names, matrix, batch, k, euclid)

    return records.mapInArrow(run, _hit_type(records))


def _search_blocks(records: DataFrame, queries: DataFrame, blocks: int, k: int, euclid: bool) -> DataFrame:
    """Partial hits of any number of queries: parts of the records meet blocks of queries as groups of a cogroup, both
    of bounded size. Equal records count once, so that no part holds a large group of copies."""
    once = records.dropDuplicates()
    parts = max(1, -(-once.count() // PART_RECORDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = once.withColumn("_part", F.pmod(F.xxhash64(*once.columns), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))

    kind = _hit_type(records)

    def run(part: pa.Table, block: pa.Table) -> Iterator[pa.RecordBatch]:
        names = block.column("query_id").to_pylist()
        matrix = np.array(block.column("embedding").to_pylist(), dtype=np.float64)
        for batch in part.combine_chunks().to_batches(max_chunksize=10_000):
            yield from _best(names, matrix, batch, k, euclid)

    def table(part: pa.Table, block: pa.Table) -> pa.Table:
        none = part.select(["entry_id", "section_id"]).slice(0, 0)
        empty = pa.table({"query_id": pa.array([], pa.int64()), "entry_id": none["entry_id"], "section_id": none["section_id"], "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *[pa.Table.from_batches([b]) for b in run(part, block)]])

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(table, kind)


def knn(records: DataFrame, queries: DataFrame, k: int, euclid: bool = False) -> DataFrame:
    """V3, V4: (query_id, entry_id, section_id, score, rank): each entry by its best record, the k best entries by
    score, then id. records: entry_id, section_id, embedding; queries: query_id, embedding.

    Queries of at most QUERY_BYTES travel with the tasks; more are dealt in blocks on Spark and don't pass the driver.
    What shuffles to the end is a partial top k of each batch, in the order of the result. Queries whose length isn't
    the commonest one's, or null, have no hits.
    """
    usual = queries.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).filter("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    n, dims = (usual["n"], usual["dims"]) if usual else (0, 1)
    asked = queries.filter(F.size("embedding") == dims).select("query_id", "embedding")
    rows = records.select("entry_id", "section_id", "embedding")
    blocks = -(-n * dims * 8 // QUERY_BYTES)
    slices = PART_RECORDS // min(10_000, max(1, BLOCK_CELLS // dims))
    hits = _search(rows, asked, k, euclid) if blocks <= 1 else _search_blocks(rows, asked, max(blocks, -(-n * k * slices // BLOCK_HITS)), k, euclid)
    best = hits.withColumn("score", F.round("score", 6)).groupBy("query_id", "entry_id").agg(F.max_by("section_id", "score").alias("section_id"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def live_hits(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """V5: hits of live entries (a column entry_id), with their ranks as they were."""
    return hits.join(entries.select("entry_id"), "entry_id", "left_semi")


def best_section(asked: DataFrame, records: DataFrame, queries: DataFrame) -> DataFrame:
    """V6: per asked (query_id, entry_id), its section record with the highest dot product."""
    rows = asked.join(records.filter("section_id IS NOT NULL"), "entry_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    scored = rows.withColumn("score", F.round(dot(F.col("embedding"), F.col("_q")), 6)).filter("score IS NOT NULL")
    return scored.groupBy("query_id", "entry_id").agg(F.max_by("section_id", "score").alias("section_id"), F.max("score").alias("score"))


def section_backfill(hits: DataFrame, found: DataFrame, least: float = 0.45) -> DataFrame:
    """V7: hits without a section get the best one when its score is least or more."""
    f = found.select("query_id", "entry_id", F.col("section_id").alias("_s"), F.col("score").alias("_score"))
    return hits.join(f, ["query_id", "entry_id"], "left").withColumn("section_id", F.coalesce("section_id", F.when(F.col("_score") >= least, F.col("_s")))).drop("_s", "_score")


def refresh(records: DataFrame, changed: DataFrame, provider: str, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """V8: (the next records, those still to compute). changed: record_id, entry_id, section_id, text_hash; a vector of
    the same text, provider, model and dims is used again. records also have text_hash, provider, model, dims,
    embedding."""
    stay = records.join(changed.select("entry_id").distinct(), "entry_id", "left_anti")
    same = records.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims) & (F.size("embedding") > 0))
    known = same.groupBy("text_hash").agg(F.min_by("embedding", "record_id").alias("embedding"))
    filled = changed.join(known, "text_hash", "left").withColumns({"provider": F.lit(provider), "model": F.lit(model), "dims": F.lit(dims)})
    return stay.unionByName(filled.filter("embedding IS NOT NULL").select(stay.columns)), filled.filter("embedding IS NULL").drop("embedding")


def pending(requested: DataFrame, done: DataFrame) -> DataFrame:
    """V9."""
    return requested.join(done.select("record_id"), "record_id", "left_anti")


def cached_queries(queries: DataFrame, cache: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """Queries (query_id, query) with their cached vectors, null where one must be made; key is the cache's."""
    key = F.sha2(F.concat_ws("|", F.lit(provider), F.lit(model), F.lit(str(dims)), "query"), 256)
    return queries.withColumn("key", key).join(cache.filter(F.size("embedding") > 0).select("key", "embedding"), "key", "left")


def manifest(records: DataFrame, version: int = 1) -> DataFrame:
    """One row per (provider, model, dims) with counts."""
    return records.groupBy("provider", "model", "dims").agg(F.count("*").alias("records"), F.count_distinct("entry_id").alias("entries")).withColumn("version", F.lit(version))


def write_table(records: DataFrame, path: str, version: int = 1) -> DataFrame:
    """Writes the records by model, then their manifest, which makes them count; returns it."""
    records.write.partitionBy("provider", "model", "dims").parquet(f"{path}/records")
    written = records.sparkSession.read.schema(records.schema).parquet(f"{path}/records")
    manifest(written, version).write.json(f"{path}/manifest")
    return read_manifest(records.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("provider string, model string, dims int, records bigint, entries bigint, version int").json(f"{path}/manifest")


def read_table(spark: SparkSession, path: str, version: int, provider: str | None, model: str, dims: int) -> DataFrame:
    """The records that compatible() lets be used; only their folders are read, none if the manifest has no such."""
    usable = compatible(read_manifest(spark, path), version, provider, model, dims).filter("compatible").select("provider", "model", "dims")
    return spark.read.parquet(f"{path}/records").join(F.broadcast(usable), ["provider", "model", "dims"], "left_semi")  # a row for each model


def compatible(manifest_: DataFrame, version: int, provider: str | None, model: str, dims: int) -> DataFrame:
    """The manifest's rows with a boolean `compatible`; a provider counts only where one is recorded."""
    same = (F.col("version") == version) & (F.col("model") == model) & (F.col("dims") == dims)
    return manifest_.withColumn("compatible", same & (F.col("provider").isNull() | F.lit(provider).isNull() | (F.col("provider") == F.lit(provider))))
