"""Counts, rollups, budgets, log summaries, corpus and throughput reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import logs
from sparkloom.operators.windows import row_numbers


def count_by(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """A1: rows per value; with values, one row for each of them, zero when there are none."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    if values is None:
        return counts
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def tag_counts(tags: DataFrame, entry_tags: DataFrame, tag: str = "tag_id") -> DataFrame:
    """A2: entries per tag, zero when unused."""
    counts = entry_tags.groupBy(tag).agg(F.count("*").alias("doc_count"))
    return tags.join(counts, tag, "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def eligible_tags(entry_tags: DataFrame, low: int = 2, high: int = 40, tag: str = "tag", entry: str = "entry") -> DataFrame:
    """A4: tags worn by low to high distinct entries."""
    return entry_tags.groupBy(tag).agg(F.count_distinct(entry).alias("fanout")).filter(F.col("fanout").between(low, high))


def session_rollup(rows: DataFrame, session: str, sums: Sequence[str], cost: str | None = None) -> DataFrame:
    """A5: turns and sums per session; the cost stays DECIMAL(12,6)."""
    parts = [F.sum(c).alias(c) for c in sums] + ([F.sum(F.col(cost).cast("decimal(12,6)")).cast("decimal(12,6)").alias(cost)] if cost else [])
    return rows.groupBy(session).agg(F.count("*").alias("turns"), *parts)


def cache_summary(calls: DataFrame, prompt: str = "prompt_tokens", cached: str = "cached_tokens", kept: str = "prefix_preserved") -> DataFrame:
    """Tokens and hit ratio, overall and by whether the prefix was preserved (true, false, unknown); a ratio is at
    most 1 and null over nothing."""
    state = F.when(F.col(kept), "preserved").when(~F.col(kept), "broken").otherwise("unknown")
    rolled = calls.withColumn("prefix", state).rollup("prefix").agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(cached).alias("cached_tokens"))
    ratio = F.least(F.try_divide(F.col("cached_tokens"), F.col("prompt_tokens")), F.lit(1.0))
    return rolled.withColumn("prefix", F.coalesce("prefix", F.lit("all"))).withColumn("ratio", F.round(ratio, 6))


def slo_status(value: Column, samples: Column, target: float, least: int) -> Column:
    """A7."""
    return F.when((samples < least) | value.isNull(), "insufficient_data").when(value >= target, "met").otherwise("breached")


def rolling_sum(events: DataFrame, key: str, at: str, value: str, seconds: int = 86400, out: str = "spent") -> DataFrame:
    """Sum over the trailing seconds up to each event."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn(out, F.sum(value).over(w))


def sessions_due(notes: DataFrame, session: str, at: str, least: int, cutoff) -> DataFrame:
    """Sessions with so many rows, the newest not after cutoff."""
    return notes.groupBy(session).agg(F.count("*").alias("n"), F.max(at).alias("newest")).filter((F.col("n") >= least) & (F.col("newest") <= cutoff))


def capacity(files: DataFrame, size: str = "size_bytes") -> DataFrame:
    """A11."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def log_summary(lines: DataFrame, by: Sequence[str] = ("file",), line: str = "text", no: str = "n") -> DataFrame:
    """Per file and level (OTHER: none), lines and the first and last times in file order."""
    ts = logs.detect_timestamp(F.col(line))
    rows = lines.withColumn("level", F.coalesce(logs.detect_level(F.col(line)), F.lit("OTHER"))).withColumn("_ts", ts)
    first, last = F.min_by("_ts", F.when(F.col("_ts").isNotNull(), F.col(no))), F.max_by("_ts", F.when(F.col("_ts").isNotNull(), F.col(no)))
    return rows.groupBy(*by, "level").agg(F.count("*").alias("lines"), first.alias("first_ts"), last.alias("last_ts"))


def count_pattern(lines: DataFrame, pattern: str, by: Sequence[str] = ("file",), line: str = "text") -> DataFrame:
    """Matching lines and their percentage, 4 decimals."""
    hit = F.count_if(logs.matches(F.col(line), pattern))
    return lines.groupBy(*by).agg(hit.alias("matches"), F.count("*").alias("lines"), F.round(100.0 * hit / F.count("*"), 4).alias("percent"))


def top_values(lines: DataFrame, pattern: str, group: int = 1, k: int = 20, by: Sequence[str] = ("file",), line: str = "text", no: str = "n") -> DataFrame:
    """The k most common captures per file, ties in the order they were first seen, with unique and total."""
    seen = lines.select(*by, no, F.posexplode(F.regexp_extract_all(line, F.lit(pattern), F.lit(group))).alias("pos", "value"))
    counts = seen.groupBy(*by, "value").agg(F.count("*").alias("n"), F.min(F.struct(no, "pos")).alias("_first"))
    whole = Window.partitionBy(*by)
    ranked = counts.withColumns({"unique": F.count("*").over(whole), "total": F.sum("n").over(whole), "rank": F.row_number().over(whole.orderBy(F.desc("n"), "_first"))})
    return ranked.filter(F.col("rank") <= k).drop("_first")


def time_distribution(lines: DataFrame, group: str = "day", by: Sequence[str] = ("file",), line: str = "text", limit: int | None = None) -> DataFrame:
    """Lines per day or hour, the first `limit` buckets of each file."""
    counts = lines.withColumn("bucket", logs.time_bucket(F.col(line), group)).filter("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    if limit is None:
        return counts
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("bucket"))).filter(F.col("_r") <= limit).drop("_r")


def mentions(notes: DataFrame, ids: str = "entry_ids", note: str = "note", least: int = 2, k: int | None = None) -> DataFrame:
    """Entries mentioned by `least` notes or more, with the notes, the most mentioned first."""
    out = notes.select(F.explode(F.array_distinct(ids)).alias("entry"), F.col(note).alias("_note")).groupBy("entry").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_list("_note")).alias("notes")).filter(F.col("mentions") >= least)
    return out if k is None else out.orderBy(F.desc("mentions"), "entry").limit(k)


def table_coverage(rows: DataFrame, sheet: str, cap: int) -> DataFrame:
    """Per sheet and overall (sheet null) total rows, indexed rows and whether that is part; rows of nulls only
    don't count."""
    data = [c for c in rows.columns if c != sheet]
    some = rows.filter(F.coalesce(*[F.col(c).cast("string") for c in data]).isNotNull()).groupBy(sheet).agg(F.count("*").alias("total_rows"))
    each = some.withColumn("indexed_rows", F.least("total_rows", F.lit(cap)))
    return each.rollup(sheet).agg(F.sum("total_rows").alias("total_rows"), F.sum("indexed_rows").alias("indexed_rows")).withColumn("partial", F.col("indexed_rows") < F.col("total_rows"))


def text_coverage(total: Column, indexed: Column, decoded: Column) -> Column:
    """Struct of counts and the reasons why it is part."""
    reasons = F.array_compact(F.array(F.when(indexed < total, "size_limit"), F.when(~decoded, "undecodable")))
    return F.struct(total.alias("total"), indexed.alias("indexed"), (F.size(reasons) > 0).alias("partial"), reasons.alias("reasons"))


def stage_totals(usage: DataFrame, key: str, stages: str) -> DataFrame:
    """Per key, a map of summed stage durations."""
    each = usage.select(key, F.explode(stages).alias("stage", "s")).groupBy(key, "stage").agg(F.sum("s").alias("s"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias(stages))


def direct_counts(catalogs: DataFrame, entries: DataFrame, catalog: str = "catalog_id") -> DataFrame:
    """A3: live catalogs with the number of their own live entries, 0 where there are none; nothing of their subtrees."""
    n = entries.filter("deleted_at IS NULL").groupBy(F.col(catalog).alias("id")).agg(F.count("*").alias("entries"))
    return catalogs.filter("deleted_at IS NULL").join(n, "id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a column each, per group of by. Groups may have any size: their values
    are numbered by row_numbers(), and only the rows beside the wanted places are gathered. Nulls don't count."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    sizes = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg((F.count("*") - 1).alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] or [F.col("_last") >= 0]  # one row without groups
    placed = row_numbers(rows, list(by), ["_v"], "_r").join(sizes if by else F.broadcast(sizes), same)
    at = [F.col("_last") * q for q in wanted.values()]
    near = [(F.col("_r") - 1 == f(x)) for x in at for f in (F.floor, F.ceil)]
    beside = placed.filter(reduce(lambda x, y: x | y, near))
    value_at = lambda place: F.max(F.when(F.col("_r") - 1 == place, F.col("_v")))
    low_high = [(value_at(F.floor(x)), value_at(F.ceil(x)), F.max(x - F.floor(x))) for x in at]
    return beside.groupBy(*by).agg(*[(low + (high - low) * part).alias(name) for name, (low, high, part) in zip(wanted, low_high, strict=True)])


def with_quantiles(report: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """report with the columns of quantiles(); groups without values get nulls."""
    if not by:
        return report.join(F.broadcast(found), F.lit(True), "left")  # a row each
    other = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in found.columns if c not in by])
    return report.join(other, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], "left").drop(*[f"_g{i}" for i in range(len(by))])


def chart(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Count, sum, mean, median, min, max, stdev of y."""
    out = df.groupBy(*x).agg(F.count(y).alias("count"), F.sum(y).alias("sum"), F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max"), F.stddev(y).alias("stdev"))
    return with_quantiles(out, quantiles(df, x, y, {"median": 0.5}), x)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, columns with types, rows of each table."""
    spark = next(iter(tables.values())).sparkSession
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit(", ".join(f"{c} {t}" for c, t in df.dtypes)).alias("columns"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if parts else spark.createDataFrame([], "name string, columns string, rows bigint")


def retention(df: DataFrame, at: str, cutoff) -> DataFrame:
    """A24."""
    return df.agg(F.min(at).alias("oldest"), F.count_if(F.col(at) < cutoff).alias("expired"), F.count("*").alias("rows"))


def throughput(tasks: DataFrame, now, kind: str = "kind") -> DataFrame:
    """Per kind and overall (kind null). tasks: kind, status, created_at, started_at, finished_at."""
    count = lambda s: F.count_if(F.col("status") == s)
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    seconds = at("finished_at") - at("started_at")
    return tasks.rollup(kind).agg(
        count("pending").alias("pending"), count("running").alias("running"), count("done").alias("done"), count("failed").alias("failed"),
        F.max(F.when(F.col("status") == "pending", F.unix_seconds(now) - at("created_at"))).alias("oldest_pending_s"),
        F.round(F.try_divide(count("done"), count("done") + count("failed")), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("status") == "done", seconds)), 6).alias("mean_s"),
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
