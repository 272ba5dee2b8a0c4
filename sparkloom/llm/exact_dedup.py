"""Exact deduplication by two-pass Bloom filtering.

Pass one counts, per cell of a Bloom filter of bounded size, how many rows set it; only cells set by two rows or
more stay. Pass two probes each row: a row of which some cell was set once is certainly unique and passes straight
through. Only the others shuffle, by the digest of their text, and are settled exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE, filter_blocks, filter_cells, filter_table, stored, with_hit


def _judged(df: DataFrame, id_col: str, text_col: str, keep: list[str], max_bits: int) -> DataFrame:
    """Columns _id, _sha, _keep, _size, _stays and _c0.. for the columns of keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, WHITE, "")
    total = df.count()
    blocks = filter_blocks(total, max_bits=max_bits)

    cells = df.select(F.explode(filter_cells(F.xxhash64(norm), blocks)).alias("cell"))
    repeated = cells.groupBy("cell").count().filter("count >= 2")
    bitmaps = stored(filter_table(repeated))

    rows = df.select(
        F.col(id_col).alias("_id"), F.length(text).alias("_n"), F.sha2(norm, 256).alias("_sha"), F.xxhash64(norm).alias("_f"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)],
    )
    probed = with_hit(rows, "_f", bitmaps, blocks, "_hit")

    # Possible repeats are written once with a number for each row, so that of equal rows one can be chosen.
    hits = stored(probed.filter("_hit").drop("_hit").withColumn("_row", F.monotonically_increasing_id()))
    order = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = stored(
        hits.groupBy("_sha").agg(F.min(order).alias("best"), F.count("*").alias("_size"))
        .filter("_size >= 2").select("_sha", F.col("best.id").alias("_keep"), F.col("best.row").alias("_first"), "_size")
    )
    # A group with a thousandth of the rows or more: there are at most a thousand, so they are broadcast, and none of
    # the groups left can fill a shuffle partition.
    hot = groups.filter(F.col("_size") * 1000 >= total)
    cold = groups.filter(F.col("_size") * 1000 < total)
    marked = hits.join(F.broadcast(hot), "_sha", "left")
    settled = marked.filter("_size IS NOT NULL").unionByName(marked.filter("_size IS NULL").drop("_keep", "_first", "_size").join(cold, "_sha", "left"))
    single = F.col("_size").isNull()
    columns = ["_id", "_sha", *[f"_c{i}" for i in range(len(keep))]]
    settled = settled.select(
        *columns, F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
        (single | (F.col("_row") == F.col("_first"))).alias("_stays"),
    )
    through = probed.filter("NOT _hit").select(*columns, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_stays"))
    return through.unionByName(settled)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the row with the
    most code points stays, then the smallest id (a null id is larger than all). Of rows that are equal in both, any one
    stays: kept is true for exactly one row of a group, and all of them count in group_size. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    out = _judged(df.select(id_col, text_col), id_col, text_col, [], max_bits)
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_stays").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """The rows of df that stay, with its columns; see exact_groups()."""
    out = _judged(df, id_col, text_col, df.columns, max_bits).filter("_stays")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
