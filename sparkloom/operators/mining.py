"""A table of tag-overlap pairs that is mined a page of entries at a time and kept up to date by deltas.

The table is a log in a shared folder. Each step mines some entries against the tags of all and writes the pairs that
touch them, the entries it covered, and last a commit that names both and the cursor; what isn't committed is never
read. A later step that covers an entry replaces all pairs of that entry, so a pair holds as long as no later step
covered one of its ends. Nothing is rewritten but by compact().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.operators.windows import row_numbers

#: Rows of a lookup side up to which it is broadcast; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Entries of a page up to which one task picks them; more are numbered where they stand.
PICKED_ROWS = 200_000


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def touching_pairs(entry_tags: DataFrame, entries: DataFrame, min_jaccard: float = 0.30, min_shared: int = 2, max_fanout: int = 40) -> DataFrame:
    """tag_overlap_pairs() of entry_tags (e, t; distinct), those that touch entries (a column e): (a, b, shared,
    jaccard, weight). The tags of all are scanned; only rows with a tag of these entries, and then the tags of the
    entries that share one, are shuffled."""
    entries = entries.select("e").distinct().checkpoint()
    own = entry_tags.join(_bounded(entries, entries.count()), "e", "left_semi").checkpoint()
    tags = own.select("t").distinct().checkpoint()
    worn = entry_tags.join(_bounded(tags, tags.count()), "t", "left_semi")
    fanout = worn.groupBy("t").agg(F.count("e").alias("f")).filter("f > 1").checkpoint()
    known = _bounded(fanout, fanout.count())
    rows = lambda df: df.join(known, "t").filter("e IS NOT NULL").select("e", "t", "f")
    met = graph.overlap_candidates(rows(own), rows(worn), min_jaccard, min_shared, max_fanout).checkpoint()
    ends = met.select(F.col("a").alias("e")).unionByName(met.select(F.col("b").alias("e"))).distinct().checkpoint()
    sets = entry_tags.join(_bounded(ends, ends.count()), "e", "left_semi").checkpoint()
    return graph.overlaps(met, sets, min_jaccard, min_shared)


def dirty_entries(entry_tags: DataFrame, changes: DataFrame, max_fanout: int = 40) -> DataFrame:
    """Entries (e) whose pairs a change may have touched. entry_tags: as it is after it; changes: e, t, added (else
    removed). These are the changed entries, and all that wear a tag that began or ceased to have 2 to max_fanout
    wearers: what a tag had before is what it has now without what was added and with what was removed."""
    moved = changes.groupBy("t").agg(F.sum(F.when(F.col("added"), 1).otherwise(-1)).alias("more")).checkpoint()
    known = _bounded(moved, moved.count())
    now = entry_tags.join(known.select("t"), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    fits = lambda c: c.between(2, max_fanout)
    n = F.coalesce("n", F.lit(0))
    turned = moved.join(now, "t", "left").filter(fits(n) != fits(n - F.col("more"))).select("t").checkpoint()
    wearers = entry_tags.join(_bounded(turned, turned.count()), "t", "left_semi").select("e")
    return changes.select("e").unionByName(wearers).distinct()


class PairTable:
    """The log. Tags are given with each step: entry_tags (e, t), of all live entries as they are now."""

    def __init__(self, spark: SparkSession, path: str, **limits):
        self.spark, self.path, self.limits = spark, path, limits
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda p: jvm.Path(p)
        self._files = jvm.FileContext.getFileContext(jvm.Path(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
        self._no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def commits(self) -> list[dict]:
        """Commits by version: version, path, cursor, complete, base; base: older ones don't count."""
        folder = self._at(f"{self.path}/commits")
        if not self._files.util().exists(folder):
            return []
        names = sorted(s.getPath().toString() for s in self._files.util().listStatus(folder) if s.getPath().getName().endswith(".json"))
        rows = self.spark.read.text(names, wholetext=True).collect() if names else []  # a line for each step since compact() or before
        found = sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["version"])
        last = max((i for i, c in enumerate(found) if c["base"]), default=0)
        return found[last:]

    def _commit(self, after: list[dict], pairs: DataFrame, covered: DataFrame, cursor, complete: bool, base: bool = False) -> dict:
        version = after[-1]["version"] + 1 if after else 1
        folder = f"{self.path}/steps/{uuid.uuid4().hex}"
        covered.write.parquet(f"{folder}/covered")
        pairs.write.parquet(f"{folder}/pairs")
        commit = {"version": version, "path": folder, "cursor": cursor, "complete": complete, "base": base}
        # The name of a version can be taken once: of two steps that began alike, one fails here and leaves no trace.
        draft, final = f"{folder}/commit", f"{self.path}/commits/{version:012d}.json"
        self.spark.createDataFrame([(json.dumps(commit),)], "value string").coalesce(1).write.text(draft)
        part = next(s.getPath() for s in self._files.util().listStatus(self._at(draft)) if s.getPath().getName().startswith("part-"))
        jvm = self.spark._jvm
        self._files.mkdir(self._at(f"{self.path}/commits"), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        self._files.rename(part, self._at(final), self._no_options)
        return commit

    def _read(self, commits: list[dict], what: str) -> DataFrame:
        out = None
        for c in commits:
            one = self.spark.read.parquet(f"{c['path']}/{what}")
            one = one if "v" in one.columns else one.withColumn("v", F.lit(c["version"]))
            out = one if out is None else out.unionByName(one)
        return out

    def pairs(self) -> DataFrame:
        """(a, b, shared, jaccard, weight) as of the last commit."""
        commits = self.commits()
        if not commits:
            raise ValueError(f"nothing is mined in {self.path}")
        return self._held(commits).drop("v")

    def _held(self, commits: list[dict]) -> DataFrame:
        last = self._last(commits)
        rows = self._read(commits, "pairs")
        for end in ("a", "b"):
            rows = rows.join(last.select(F.col("e").alias(end), F.col("v").alias("_last")), end, "left").filter(F.coalesce("_last", F.lit(0)) <= F.col("v")).drop("_last")
        return rows.select("a", "b", "shared", "jaccard", "weight", "v")

    def _last(self, commits: list[dict]) -> DataFrame:
        return self._read(commits, "covered").groupBy("e").agg(F.max("v").alias("v"))

    def next_page(self, entry_tags: DataFrame, size: int) -> dict:
        """Mines the next `size` entries after the cursor, in the order of their ids; after the last one it begins
        anew. The cursor is part of the commit."""
        commits = self.commits()
        cursor = commits[-1]["cursor"] if commits else None
        ahead = entry_tags.select("e") if cursor is None else entry_tags.select("e").filter(F.col("e") > F.lit(cursor))
        if size < PICKED_ROWS:
            page = ahead.distinct().orderBy("e").limit(size + 1)
        else:
            page = row_numbers(ahead.distinct(), [], ["e"]).filter(F.col("row") <= size + 1).select("e")
        page = page.checkpoint()  # size + 1 ids
        more = page.count() > size
        if more:
            past = page.agg(F.max("e")).first()[0]
            page = page.filter(F.col("e") < F.lit(past))
        last = page.agg(F.max("e")).first()[0]
        return self._commit(commits, touching_pairs(entry_tags, page, **self.limits), page, last if more else None, not more)

    def apply(self, entry_tags: DataFrame, changes: DataFrame) -> dict:
        """Mines again what changes (e, t, added) touched; the cursor stays where it is."""
        commits = self.commits()
        fanout = {k: v for k, v in self.limits.items() if k == "max_fanout"}
        dirty = dirty_entries(entry_tags, changes, **fanout).checkpoint()
        last = commits[-1] if commits else {"cursor": None, "complete": False}
        return self._commit(commits, touching_pairs(entry_tags, dirty, **self.limits), dirty, last["cursor"], last["complete"])

    def compact(self) -> dict:
        """One step in the place of all so far; pairs and entries keep their versions."""
        commits = self.commits()
        return self._commit(commits, self._held(commits), self._last(commits), commits[-1]["cursor"], commits[-1]["complete"], base=True)
