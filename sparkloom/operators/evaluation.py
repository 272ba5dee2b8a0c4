"""Retrieval metrics and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.aggregates import quantiles, with_quantiles


def score_queries(runs: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per query with relevant documents: first_rank, mrr, and hit, recall and ndcg at each k. runs: query_id,
    doc_id, rank; qrels: query_id, doc_id, rel."""
    rel = qrels.filter("rel > 0").select("query_id", "doc_id", "rel")
    gain = F.pow(F.lit(2.0), "rel") - 1
    hits = rel.join(runs.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    hits = hits.withColumn("_i", ideal)
    aggs = [F.count("*").alias("n_relevant"), F.min("rank").alias("first_rank")]
    for k in ks:
        found = F.count_if(F.col("rank") <= k)
        dcg = F.coalesce(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1))), F.lit(0.0))
        best = F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1)))
        aggs += [(found > 0).cast("int").alias(f"hit_{k}"), F.round(found / F.count("*"), 6).alias(f"recall_{k}"), F.round(F.try_divide(dcg, best), 6).alias(f"ndcg_{k}")]
    out = hits.groupBy("query_id").agg(*aggs)
    return out.withColumn("mrr", F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6))


def aggregate_metrics(scored: DataFrame, queries: DataFrame, runs: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: evaluated and skipped queries, means, and the rate of queries without any result."""
    got = runs.select("query_id").distinct().withColumn("_got", F.lit(1))
    rows = queries.select("query_id").join(scored, "query_id", "left").join(got, "query_id", "left")
    judged = F.col("n_relevant").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return rows.agg(
        F.count_if(judged).alias("evaluated"), F.count_if(~judged).alias("skipped"), mean("mrr"), *[mean(f"{m}_{k}") for k in ks for m in ("hit", "recall", "ndcg")],
        F.round(F.count_if(judged & F.col("_got").isNull()) / F.greatest(F.count_if(judged), F.lit(1)), 6).alias("zero_result_rate"),
    )


def ablation(metrics: DataFrame, baseline: str, columns: Sequence[str]) -> DataFrame:
    """Metrics (config, ...) with the difference to the baseline's."""
    base = metrics.filter(F.col("config") == baseline).select(*[F.col(c).alias(f"_{c}") for c in columns])
    joined = metrics.join(F.broadcast(base))  # one row
    return joined.withColumns({f"delta_{c}": F.round(F.col(c) - F.col(f"_{c}"), 6) for c in columns}).drop(*[f"_{c}" for c in columns])


def latency_report(requests: DataFrame, k: int = 3, by: Sequence[str] = (), seconds: float | None = None) -> DataFrame:
    """E5: latency percentiles with linear interpolation, error rate, hit and mrr over all requests. requests:
    latency_ms, first_rank, error."""
    ok = F.when(~F.col("error"), F.col("latency_ms"))
    n = F.count("*")
    report = requests.groupBy(*by).agg(
        n.alias("requests"), F.round(F.min(ok), 6).alias("min_ms"), F.round(F.max(ok), 6).alias("max_ms"), F.round(F.avg(ok), 6).alias("mean_ms"),
        F.round(F.count_if("error") / n, 6).alias("error_rate"), F.round(F.count_if(F.col("first_rank") <= k) / n, 6).alias("hit"),
        F.round(F.coalesce(F.sum(1.0 / F.col("first_rank")), F.lit(0.0)) / n, 6).alias("mrr"),
        (F.round(n / F.lit(seconds), 6) if seconds else F.lit(None).cast("double")).alias("rps"),
    )
    found = quantiles(requests.filter("NOT error"), by, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return with_quantiles(report, found, by).withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")})


def violations(report: DataFrame, p95_ms: float, hit: float, error_rate: float) -> DataFrame:
    """E5: the report with the thresholds that it misses and ok."""
    v = F.array_compact(F.array(F.when(F.col("p95_ms") > p95_ms, "p95_ms"), F.when(F.col("hit") < hit, "hit"), F.when(F.col("error_rate") > error_rate, "error_rate")))
    return report.withColumn("violations", v).withColumn("ok", F.size("violations") == 0)


def answer_summary(answers: DataFrame) -> DataFrame:
    """E6. answers: evidence_rank, cited, label, expected ARRAY, tokens."""
    rate = lambda test: F.round(F.avg(test.cast("int")), 6)
    labelled = F.when((F.size("expected") > 0) & F.col("label").isNotNull(), F.array_contains("expected", F.col("label")))
    return answers.agg(
        F.count("*").alias("answers"), rate(F.col("evidence_rank").isNotNull()).alias("evidence_hit"), rate(F.col("cited")).alias("citation_hit"), F.round(F.avg("evidence_rank"), 6).alias("mean_first_rank"),
        rate(labelled).alias("label_accuracy"), F.sum("tokens").alias("tokens"),
    )


def compare_summary(pairs: DataFrame) -> DataFrame:
    """A missing or unknown winner is a tie. pairs: winner (a, b, tie), error, timeout."""
    w = F.when(F.col("winner").isin("a", "b"), F.col("winner")).otherwise("tie")
    fine = ~F.coalesce(F.col("error"), F.lit(False))
    return pairs.agg(F.count("*").alias("pairs"), *[F.count_if(fine & (w == x)).alias(f"{x}_wins" if x != "tie" else "ties") for x in ("a", "b", "tie")], F.count_if(~fine).alias("errors"), F.count_if(F.coalesce("timeout", F.lit(False))).alias("timeouts"))


def expected_labels(queries: DataFrame, rel: DataFrame) -> DataFrame:
    """(query_id, labels) from metadata MAP<doc_id, ARRAY<STRUCT<label>>> of relevant documents."""
    each = queries.select("query_id", F.explode("metadata").alias("doc_id", "items")).join(rel.select("query_id", "doc_id"), ["query_id", "doc_id"])
    label = each.select("query_id", F.explode("items").alias("i")).select("query_id", F.upper(F.trim("i.label")).alias("l")).filter(F.col("l").isin("SUPPORT", "CONTRADICT", "INSUFFICIENT"))
    return label.groupBy("query_id").agg(F.array_sort(F.collect_set("l")).alias("labels"))
