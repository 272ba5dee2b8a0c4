"""Table maintenance: each operator gives the next version of a table, or the rows that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def demote(entries: DataFrame, notes: DataFrame, now: Column, age: int = 14, quiet: int = 30, states: tuple[str, ...] = ("active",), aged: str = "created_at", cap: int | None = 50) -> DataFrame:
    """M1: active entries of that age that no note (entry_ids, created_at) mentions of late, oldest first."""
    said = notes.filter(F.col("created_at") >= now - days(quiet)).select(F.explode("entry_ids").alias("id")).distinct()
    due = entries.filter(F.col("lifecycle").isin(*states) & (F.col(aged) <= now - days(age))).join(said, "id", "left_anti").orderBy(aged, "id")
    return due if cap is None else due.limit(cap)


def archive(entries: DataFrame, notes: DataFrame, now: Column, cap: int | None = 50) -> DataFrame:
    """M2."""
    return demote(entries, notes, now, 30, 90, ("demoted",), "updated_at", cap)


def apply_transitions(entries: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: (next entries, outcomes): a move (id, from_state, to_state) applies while the row is still in from_state."""
    joined = entries.join(moves, "id", "left")
    fits = F.col("lifecycle") == F.col("from_state")
    following = joined.withColumn("lifecycle", F.when(fits, F.col("to_state")).otherwise(F.col("lifecycle"))).select(entries.columns)
    return following, moves.join(entries.select("id", "lifecycle"), "id", "left").select("id", F.when(fits, "applied").otherwise("deferred").alias("outcome"))


def purge_due(entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """M4: (entries that stay, entries to purge)."""
    due = F.col("deleted_at").isNotNull() & (F.col("purge_after") < now)
    return entries.filter(~F.coalesce(due, F.lit(False))), entries.filter(due)


def prune(df: DataFrame, at: str, now: Column, retention_days: int) -> DataFrame:
    """M5: without rows strictly older than the cutoff; 0 turns it off."""
    return df if retention_days == 0 else df.filter(F.col(at) >= now - days(retention_days))


def merge_tags(tags: DataFrame, entry_tags: DataFrame, mapping: DataFrame, rounds: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M6: (tags, entry_tags, new alias rows) after mapping (from_id, to_id): within a facet only, chains followed to
    their root, each entry wearing a canonical tag once."""
    facet = tags.select("id", "facet")
    ok = mapping.join(facet.select(F.col("id").alias("from_id"), F.col("facet").alias("_ff")), "from_id").join(facet.select(F.col("id").alias("to_id"), F.col("facet").alias("_tf")), "to_id").filter("_ff = _tf AND from_id <> to_id").select("from_id", "to_id").checkpoint()
    for _ in range(rounds):
        longer = ok.alias("a").join(ok.alias("b"), F.col("a.to_id") == F.col("b.from_id"), "left").select(F.col("a.from_id").alias("from_id"), F.coalesce("b.to_id", "a.to_id").alias("to_id")).filter("from_id <> to_id").checkpoint()
        if longer.exceptAll(ok).isEmpty():
            break
        ok = longer
    repointed = entry_tags.join(ok.withColumnRenamed("from_id", "tag_id"), "tag_id", "left").withColumn("tag_id", F.coalesce("to_id", "tag_id")).select(entry_tags.columns).dropDuplicates(["entry_id", "tag_id"])
    marked = tags.join(ok.withColumnRenamed("from_id", "id"), "id", "left").withColumn("alias_of", F.coalesce("to_id", "alias_of")).select(tags.columns)
    aliases = ok.join(tags.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id").select("from_name", F.col("to_id").alias("to_tag_id"))
    return marked, repointed, aliases


def move_entries(entries: DataFrame, moves: DataFrame, column: str = "catalog_id") -> DataFrame:
    """M7: live entries of moves (id, target) get the target, null included."""
    m = moves.select("id", "target", F.lit(True).alias("_m"))
    changed = F.col("_m").isNotNull() & F.col("deleted_at").isNull()
    return entries.join(m, "id", "left").withColumn(column, F.when(changed, F.col("target")).otherwise(F.col(column))).select(entries.columns)


def delete_catalog(catalogs: DataFrame, entries: DataFrame, catalog, merge_into=None) -> tuple[DataFrame, DataFrame]:
    """M7: (catalogs, entries) without the catalog; children and entries go to merge_into, or the root when null."""
    if merge_into is not None and merge_into == catalog:
        raise ValueError("a catalog can't be merged into itself")
    to = F.lit(merge_into).cast(catalogs.schema["id"].dataType)
    kept = catalogs.filter(F.col("id") != catalog).withColumn("parent_id", F.when(F.col("parent_id") == catalog, to).otherwise(F.col("parent_id")))
    return kept, entries.withColumn("catalog_id", F.when(F.col("catalog_id") == catalog, to).otherwise(F.col("catalog_id")))


def would_cycle(closed: DataFrame, moves: DataFrame) -> DataFrame:
    """M8: moves (child, new_parent) with cycle: the parent is the child or below it."""
    below = closed.select(F.col("ancestor").alias("child"), F.col("id").alias("new_parent"), F.lit(True).alias("cycle"))
    return moves.join(below, ["child", "new_parent"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def supersede(notes: DataFrame, replaced: DataFrame) -> DataFrame:
    """M9: active notes of replaced (note_id, by_id) are superseded."""
    active = F.col("superseded_by_id").isNull() & F.col("invalidated_at").isNull()
    return notes.join(replaced, "note_id", "left").withColumn("superseded_by_id", F.when(active, F.col("by_id")).otherwise(F.col("superseded_by_id"))).select(notes.columns)


def due_without_recent(candidates: DataFrame, outcomes: DataFrame, now: Column, key: str, cap: int | None = None, order: str | None = None, hours: int = 24) -> DataFrame:
    """Candidates whose object had no outcome within the hours."""
    recent = outcomes.filter(F.col("completed_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))).select(key)
    out = candidates.join(recent, key, "left_anti")
    return out if cap is None else out.orderBy(order or key, key).limit(cap)


def cadence_due(tasks: DataFrame, cadence: DataFrame, now: Column) -> DataFrame:
    """Kinds (kind, seconds) with nothing in flight and the last finish longer ago."""
    busy = tasks.filter(F.col("status").isin("pending", "running")).select("kind")
    last = tasks.filter("status = 'done'").groupBy("kind").agg(F.max("finished_at").alias("last"))
    due = F.col("last").isNull() | (F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp")) >= F.col("seconds"))
    return cadence.join(busy, "kind", "left_anti").join(last, "kind", "left").filter(due)


def stale_running(tasks: DataFrame, now: Column) -> DataFrame:
    """M13."""
    return tasks.filter((F.col("status") == "running") & (F.col("lease_expires_at") < now)).orderBy("lease_expires_at", "id")


def merge_snapshots(remote: DataFrame, local: DataFrame, key: str, relations: tuple[str, str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Keyed union in which local rows win; relations keep rows with both ends in scope (a column id)."""
    out = local.unionByName(remote.join(local.select(key), key, "left_anti"))
    if relations and scope is not None:
        for end in relations:
            out = out.join(scope.select(F.col("id").alias(end)), end, "left_semi")
    return out
