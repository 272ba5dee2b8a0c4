"""Ranked lexical search with bag deduplication.

Documents are restricted to the terms of the items. Those that keep the same bag, that is the same counts of the same
terms, and have the same length factor m score alike for every item. They are found by a hash and verified by their
bags; a class is scored once, and its members follow in the order of their ids. Of a class only the k smallest ids can
be among the k best, and a class that k others precede has no member there.

Items are handled in blocks whose texts have a bounded size, so that the vocabulary sent to the tasks is bounded; each
block reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import discard, stored

#: Bytes of the items' texts that are handled at once.
BLOCK_BYTES = 4 << 20
#: Scores, or looks into items, that a task holds at once.
CELLS = 2 << 20
#: Digits, letters and all that isn't ASCII make terms; A-Z become a-z.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Items:
    """Some items: their terms, numbered, and for each the items that hold it, with how often."""

    def __init__(self, rows: list[int], texts: list[str | None]):
        self.rows = np.array(rows, np.int64)
        counts = [Counter(terms(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        pairs = sorted((self.number[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.begin = np.searchsorted(term, np.arange(len(self.number) + 1))


def _bags(items: _Items):
    """(id, n, bag): the text's number of terms, and its terms of the items with their counts, as pairs of int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.number
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                counts = Counter(found)
                bag = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                sizes.append(len(found))
                bags.append(np.array(bag, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["id", "n", "bag"])

    return run


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every pair in a column of bags."""
    sizes = np.array([len(b) // 8 for b in column.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, 2)
    return np.repeat(np.arange(len(sizes)), sizes), flat[:, 0], flat[:, 1].astype(np.int64)


def _holders(n_terms: int):
    """Documents that hold each term, counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["t", "df"])

    return run


def _class_scores(items: _Items, weights: np.ndarray, k: int):
    """The k best classes of a task for each item, from (row, id, m, bag)."""
    n_items = len(items.rows)
    looks = np.diff(items.begin)

    def scores(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A line of scores for each document."""
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        each = looks[term]
        at = np.arange(int(each.sum())) + np.repeat(items.begin[term] - (np.cumsum(each) - each), each)
        out = np.zeros((len(m), n_items), np.int64)
        np.add.at(out.ravel(), np.repeat(doc * n_items, each) + items.item[at], np.repeat(part, each) * items.times[at])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(n_items, np.int64)
        best: pa.Table | None = None
        for batch in batches:
            doc, term, tf = _pairs(batch.column(3))
            m = batch.column(2).to_numpy()
            cost = np.bincount(doc, looks[term] if len(term) else None, minlength=len(m)) + n_items
            cuts = np.unique(np.searchsorted(np.cumsum(cost), np.arange(0, cost.sum() + CELLS, CELLS), side="right"))
            edges = np.unique([0, *cuts, len(m)])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lo, hi = np.searchsorted(doc, [a, b])
                s = scores(doc[lo:hi] - a, term[lo:hi], tf[lo:hi], m[a:b])
                if b - a > k:
                    least = np.maximum(least, np.partition(s, b - a - k, axis=0)[b - a - k])
                d, i = np.nonzero(s >= least)
                rows = batch.slice(a, b - a).take(pa.array(d))
                new = pa.table({"item": items.rows[i], "score": s[d, i], "id": rows.column(1), "row": rows.column(0)})
                best, least = _first(new if best is None else pa.concat_tables([best, new]), k, items.rows, least)
        if best is not None:
            yield from best.to_batches()

    return run


def _first(table: pa.Table, k: int, items: np.ndarray, least: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The k first of each item by score, then id, then row, and the least scores that can still come among them."""
    table = table.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending"), ("row", "ascending")])
    item = table.column("item").to_numpy()
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    last = np.flatnonzero(rank == k - 1)
    least[np.searchsorted(items, item[last])] = table.column("score").to_numpy()[last]
    return table.filter(pa.array(rank < k)), least


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of items: item_col, rank (from 1), id_col, score of the k best rows of docs with a score above 0.

    Equal scores rank by ascending id; a null id comes last. Null and empty texts have no terms: such a document is no
    result and isn't counted, such an item has no results. Repeated rows are documents, or items, of their own. Empty
    tables give an empty result; other columns are ignored. A text may have any length and is one task's."""
    spark = docs.sparkSession
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = []
    for b in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").toArrow()
        if held.num_rows:
            out.append(_search(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), _Items(held.column("item").to_pylist(), held.column("text").to_pylist()), k))
    item_kind, kind = asked.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    if not out:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score bigint")
    result = spark.read.schema(out[0].schema).parquet(*[o._stored_at for o in out]).join(asked.drop("text"), "item")
    return result.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search(docs: DataFrame, items: _Items, k: int) -> DataFrame:
    """Stored rows (item, rank, id, score) of a block of items."""
    kind = docs.schema["id"].dataType.simpleString()
    bags = stored(docs.mapInArrow(_bags(items), f"id {kind}, n bigint, bag binary").filter("n > 0").withColumn("row", F.monotonically_increasing_id()))
    count, length = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.number), np.int64)
    for r in bags.select("bag").mapInArrow(_holders(len(df)), "t int, df bigint").groupBy("t").agg(F.sum("df").alias("df")).collect():  # a number for each term of the block
        df[r["t"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    m = F.lit(100 - 25) + F.expr(f"(25 * n * {count}L) div {max(1, length)}L")
    order = [F.col("id").asc_nulls_last(), F.col("row")]
    same = Window.partitionBy("h", "m", "bag").orderBy(*order)
    ranked = bags.filter(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("bag", "m"))
    members = ranked.withColumn("place", F.row_number().over(same)).withColumn("class", F.first("row").over(same.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("place") <= k)
    members = stored(members.select("class", "place", "id", "row", "m", F.when(F.col("place") == 1, F.col("bag")).alias("bag")))
    best = members.filter("place = 1").select("row", "id", "m", "bag").mapInArrow(_class_scores(items, weights, k), f"item bigint, score bigint, id {kind}, row bigint")
    first = Window.partitionBy("item").orderBy(F.desc("score"), *order)
    classes = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item", "score", F.col("row").alias("class"))
    expanded = classes.join(members.select("class", "id", "row"), "class")
    out = stored(expanded.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item", "rank", "id", "score"))
    discard(bags)
    discard(members)
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS words FROM lengths),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
items AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY ALL
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, total WHERE t IN (SELECT t FROM items) GROUP BY t
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * docs) // words AS BIGINT))))) AS BIGINT) AS score
  FROM items JOIN tf USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
