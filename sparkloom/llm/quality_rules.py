"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials are counted over them: the raw
corpus (every document) and the trusted target (documents labelled good, at most `target_rows` of them). A document's
score is the sum of its n-grams' log ratios in whole micro-nats, so sums are exact and the verdict does not depend on
the order of evaluation; the threshold is per n-gram. All of it is built-in expressions on one row, but for the one
aggregation over buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE

#: Buckets of the hashed n-grams; what is sent to executors is one number for each.
BUCKETS = 8192
#: Labelled rows used as the target, those with the smallest hashes of their ids.
TARGET_ROWS = 20_000
#: Micro-nats an n-gram below which a document is dropped, for a target without a prior.
THRESHOLD = -50_000
#: Added to each bucket's count in the raw corpus.
SMOOTHING = 1.0
#: N-grams of the raw corpus, in its proportions, that are added to the target: a small target says little. Scores shrink
#: by the target's share of the sum, and the threshold shrinks alike, so that a small target can drop documents too.
PRIOR = 200_000
#: Micro-nats an n-gram by which the threshold is lower for a target of one n-gram; it falls as a standard error does,
#: with the square root of the target's n-grams. From about 700 of them on a document can fall below.
MARGIN = 25_000_000
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    one = F.transform(w, lambda a: F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"))
    two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def _repeated(windows: Column) -> Column:
    """Words covered by 5-word windows whose hash stands twice or more in windows."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(5), x - acc["last"])).alias("n"))
        return F.aggregate(starts, first, step)["n"]

    def twice(pairs: Column) -> Column:
        near = lambda x, i, k: F.coalesce(F.get(pairs, i + k)["h"] == x["h"], F.lit(False))
        return F.filter(pairs, lambda x, i: near(x, i, -1) | near(x, i, 1))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(F.transform(_let(pairs, twice), lambda x: x["i"]))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(starts))


def bucket_weights(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, target_rows: int, threshold: int) -> tuple[list[int], int]:
    """Micro-nats for each bucket and for the threshold; zeros without trusted rows. trusted: a column id_col."""
    key = F.col(id_col)
    chosen = trusted.select(id_col).dropna().distinct().orderBy(F.xxhash64(key), key).limit(target_rows).select(key.alias("_t"))
    rows = df.select(id_col, words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    marked = rows.join(F.broadcast(chosen), F.col(id_col) == F.col("_t"), "left").select(F.col("_t").isNotNull().cast("long").alias("t"), "_w")
    grams = marked.select("t", F.explode(ngram_buckets(F.col("_w"), buckets)).alias("bucket"))
    counts = {r["bucket"]: (r["t"], r["c"]) for r in grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("c")).collect()}
    total_t, total_c = sum(t for t, _ in counts.values()), sum(c for _, c in counts.values())
    if not total_t:
        return [0] * buckets, 0
    import math

    def weight(t: int, c: int) -> int:
        raw = (c + SMOOTHING) / (total_c + SMOOTHING * buckets)
        return round(1e6 * math.log((t + PRIOR * raw) / (total_t + PRIOR) / raw))

    return [weight(*counts.get(b, (0, 0))) for b in range(buckets)], round((threshold - MARGIN / math.sqrt(total_t)) * total_t / (total_t + PRIOR))


def quality_rules(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, keep: list[str] | None = None
) -> DataFrame:
    """Per row of df: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    score is the sum of micro-nats over the n-grams; kept is false for base_failed rows and for rows whose score is
    under the threshold, for a target of its size (PRIOR, MARGIN), times their n-grams. A null or empty text has no words
    and fails the base rules; texts may have any length. Without trusted rows every score is 0. Repeated rows are judged alike, an empty table gives an empty result, and other columns are
    ignored; with keep, the rows that stay are returned with those columns instead.
    """
    weights, least = bucket_weights(df, trusted, id_col, text_col, buckets, target_rows, threshold)
    text = F.col("_text")
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate([id_col, *(keep or [])])])
    rows = rows.withColumn("_w", words(text))
    n = F.size("_w")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.lit(5))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    rows = rows.withColumns({"_win": windows, "_lines": lines, "_g": ngram_buckets(F.col("_w"), buckets)})
    table = F.from_json(F.lit(str(weights)), "array<bigint>")
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeated(F.col("_win")).cast("long"),
        "_n": F.size("_g").cast("long"),
        "score": F.aggregate("_g", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b)),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least * F.col("_n")))
    if keep:
        # Pushed below the projections, the filter would compute their arrays anew for each use; a column that isn't
        # deterministic keeps it above them.
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        return rows.filter("kept AND _row >= 0").select(*[F.col(f"_c{i + 1}").alias(c) for i, c in enumerate(keep)])
    return rows.select(F.col("_c0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
