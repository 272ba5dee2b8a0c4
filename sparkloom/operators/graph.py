"""Relation mining and graph recommendation over edge tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.joins import symmetric

#: How far a source's note stands against another's; fixed values.
STRENGTH = {"cooccurrence": 10, "tag_overlap": 20, "citation": 30, "manual": 40}


#: A table of so many bytes is sent to all tasks.
SENT_BYTES = 8 << 20

#: Tags of an entry up to which it is found by two shared tags at once; a wider one by one.
TAG_PAIRS = 32


def _overlap_keys(rows: DataFrame, wide: bool, min_shared: int, min_jaccard: float, max_fanout: int) -> DataFrame:
    """(e, m, k1, k2) of rows (e, t, f): tags of which two entries that overlap enough have a pair in common. In the order
    of their fan-out, two entries that share o tags share their first two among the first m - o + 2 of each one's m,
    and the first is of bounded fan-out if any is. wide: (e, m, k1), for the first shared tag alone."""
    least = F.greatest(F.lit(max(1, min_shared)), F.ceil(F.round(F.lit(float(min_jaccard)) * F.col("m"), 9)))
    numbered = rows.withColumns({"i": F.row_number().over(Window.partitionBy("e").orderBy("f", "t")), "m": F.count("*").over(Window.partitionBy("e"))})
    if wide:
        some = numbered if min_shared < 2 else numbered.filter(F.col("m") >= min_jaccard * TAG_PAIRS)
        return some.filter((F.col("i") <= F.col("m") - least + 1) & (F.col("f") <= max_fanout)).select("e", "m", F.col("t").alias("k1"))
    head = numbered.filter((F.col("m") <= TAG_PAIRS) & (F.col("i") <= F.col("m") - least + 2))
    tags = head.groupBy("e", "m").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))  # TAG_PAIRS at most
    each = tags.select("e", "m", "s", F.posexplode("s").alias("p", "x")).filter(F.col("x.f") <= max_fanout)
    return each.select("e", "m", F.col("x.t").alias("k1"), F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("y")).select("e", "m", "k1", F.col("y.t").alias("k2"))


def overlap_candidates(own: DataFrame, other: DataFrame, min_jaccard: float, min_shared: int, max_fanout: int) -> DataFrame:
    """(a, b), a < b, distinct: the pairs of an entry of own and one of other that may overlap so much; rows (e, t, f), f the
    tag's fan-out from 2 on, other with all tags that entries of own have. Entries that share one tag and no second are
    not joined, unless one of them has over TAG_PAIRS tags or min_shared is 1: then the other has min_jaccard times as
    many at least."""
    def met(wide: bool, *on: str) -> DataFrame:
        mine = _overlap_keys(own, wide, min_shared, min_jaccard, max_fanout)
        theirs = _overlap_keys(other, wide, min_shared, min_jaccard, max_fanout)
        both = mine.withColumnsRenamed({"e": "x", "m": "mx"}).join(theirs.withColumnsRenamed({"e": "y", "m": "my"}), list(on))
        both = both.filter("x < y") if own is other else both.filter("x <> y")
        if wide and min_shared >= 2:
            both = both.filter(F.greatest("mx", "my") > TAG_PAIRS)
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    by_one = met(True, "k1")
    return (by_one if min_shared < 2 else met(False, "k1", "k2").unionByName(by_one)).distinct()


def overlaps(pairs: DataFrame, entry_tags: DataFrame, min_jaccard: float, min_shared: int) -> DataFrame:
    """(a, b, shared, jaccard, weight) of the pairs (a, b) that overlap so much; entry_tags (e, t), distinct, of both ends."""
    n = entry_tags.groupBy("e").agg(F.count("*").alias("n"))
    side = lambda x: entry_tags.select(F.col("e").alias(x), "t")
    shared = pairs.join(side("a"), "a").join(side("b"), ["b", "t"]).groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    sized = shared.join(n.select(F.col("e").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("e").alias("b"), F.col("n").alias("nb")), "b")
    out = sized.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).filter(F.col("jaccard") >= min_jaccard)
    return out.select("a", "b", "shared", "jaccard", F.greatest(F.lit(1), F.ceil(F.round(10 * F.col("jaccard"), 9))).cast("int").alias("weight"))


def tag_overlap_pairs(entry_tags: DataFrame, min_jaccard: float = 0.30, min_shared: int = 2, max_fanout: int = 40, entry: str = "entry", tag: str = "tag") -> DataFrame:
    """G1: (a, b, shared, jaccard, weight). A pair must share a tag of bounded fan-out; the overlap counts all tags."""
    et = entry_tags.select(F.col(entry).alias("e"), F.col(tag).alias("t")).distinct()
    rows = et.join(et.groupBy("t").agg(F.count("e").alias("f")).filter("f > 1"), "t").filter("e IS NOT NULL").select("e", "t", "f")
    return overlaps(overlap_candidates(rows, rows, min_jaccard, min_shared, max_fanout), et, min_jaccard, min_shared)


def array_pairs(ids: Column) -> Column:
    """Pairs (a, b), a < b, of an array's distinct values; no self-join. For arrays of a few hundred values."""
    s = F.array_sort(F.array_distinct(F.array_compact(ids)))
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


#: Ids of an array up to which its pairs are made in its row; more are dealt in blocks of so many.
PAIR_BLOCK = 128


def dealt_pairs(rows: DataFrame, ids: str, least: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(a, b), a < b, and the columns of keep: the pairs of each row's distinct ids. An array of over PAIR_BLOCK ids first loses those that stand
    in fewer than `least` rows, whose pairs can't stand in more; its pairs are then made from pairs of blocks, each a
    row of its own, so that many tasks share one array and no row grows with the square of it."""
    sorted_ids = F.array_sort(F.array_distinct(F.array_compact(ids)))
    keep = keep or []
    arrays = rows.select(*keep, F.monotonically_increasing_id().alias("_row"), sorted_ids.alias("_s")).filter(F.size("_s") > 1)
    narrow = arrays.filter(F.size("_s") <= PAIR_BLOCK).select(*keep, F.inline(array_pairs(F.col("_s"))))
    wide = arrays.filter(F.size("_s") > PAIR_BLOCK).checkpoint()  # so that row numbers hold; small but for wide arrays
    if wide.isEmpty():
        return narrow
    if least > 1:
        each = wide.select(*keep, "_row", F.explode("_s").alias("id"))
        held = each.select("id").distinct()
        counted = arrays.select(F.explode("_s").alias("id")).join(held, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        wide = each.join(counted.select("id"), "id", "left_semi").groupBy(*keep, "_row").agg(F.array_sort(F.collect_list("id")).alias("_s"))  # no longer than it was
    blocks = F.ceil(F.size("_s") / PAIR_BLOCK).cast("int")
    cut = wide.select(*keep, "_s", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_i"), blocks.alias("_n")).repartition("_i")
    part = lambda i: F.slice("_s", i * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK))
    both = cut.select(*keep, part(F.col("_i")).alias("x"), F.explode(F.sequence("_i", F.col("_n") - 1)).alias("_j"), "_s").select(*keep, "x", part(F.col("_j")).alias("y"))
    across = both.select(*keep, F.explode("x").alias("a"), "y").select(*keep, "a", F.explode("y").alias("b")).filter("a < b")
    return narrow.unionByName(across)


def cooccurrence_pairs(rows: DataFrame, ids: str = "entry_ids", least: int = 2, live: DataFrame | None = None, at: str | None = None, now: Column | None = None, days: int = 30) -> DataFrame:
    """(a, b, n) for pairs in `least` rows or more; with live (a column id), both ends must be there; with at
    (a column) and now, of rows of the last `days` days only."""
    if at is not None:
        rows = rows.filter(F.col(at) >= now - F.make_dt_interval(F.lit(days)))
    pairs = dealt_pairs(rows, ids, least).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if live is not None:
        pairs = pairs.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi")
    return pairs.select("a", "b", "n")


def upsert_relations(edges: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The next edge table (a, b, n, note, source, last): counts add up; note and source are replaced by a source
    at least as strong."""
    strength = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in STRENGTH.items()], F.lit(0))
    f = found.select("a", "b", F.col("n").alias("_n"), F.col("note").alias("_note"), F.col("source").alias("_source"))
    both = edges.join(f, ["a", "b"], "full_outer")
    newer = F.col("_n").isNotNull() & (F.col("source").isNull() | (strength(F.col("_source")) >= strength(F.col("source"))))
    return both.select(
        "a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.when(newer, F.col("_note")).otherwise(F.col("note")).alias("note"),
        F.when(newer, F.col("_source")).otherwise(F.col("source")).alias("source"), F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last")).alias("last"),
    )


def symmetric_edges(pairs: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(u, v, w) both ways, w at least 1, both ends live. pairs: a, b, n."""
    both = symmetric(pairs.select("a", "b", "n")).select(F.col("entry").alias("u"), F.col("other").alias("v"), F.greatest(F.lit(1), F.col("n")).cast("double").alias("w"))
    if live is not None:
        both = both.join(live.select(F.col("id").alias("u")), "u", "left_semi").join(live.select(F.col("id").alias("v")), "v", "left_semi")
    return both.select("u", "v", "w")


def random_walk(edges: DataFrame, seeds: DataFrame, steps: int = 6, alpha: float = 0.15, top_k: int | None = 8, direct: bool = False) -> DataFrame:
    """(seed, node, score): the expected share of visits of a walk of so many steps that goes back to its seed with
    probability alpha or at a dead end. Exact, all seeds at once: a step is one join with the edges and one sum.
    edges: u, v, w; seeds: seed. With direct, the weight of an edge from the seed is added."""
    out_w = edges.groupBy("u").agg(F.sum("w").alias("_total"))
    move = edges.join(out_w, "u").select("u", "v", (F.col("w") / F.col("_total")).alias("p"))
    at = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("mass"))
    visits = None
    for step in range(steps):
        moved = at.join(move, at["node"] == move["u"]).groupBy("seed", F.col("v").alias("node")).agg(((1 - alpha) * F.sum(F.col("mass") * F.col("p"))).alias("mass"))
        away = moved.filter("node <> seed")
        visits = away if visits is None else visits.unionByName(away)
        # All mass sums to 1: what isn't away from the seed is at it.
        home = seeds.select("seed").join(away.groupBy("seed").agg(F.sum("mass").alias("_a")), "seed", "left").select("seed", F.col("seed").alias("node"), (1 - F.coalesce("_a", F.lit(0.0))).alias("mass"))
        at = away.unionByName(home)
        if step % 2:
            at, visits = at.checkpoint(), visits.checkpoint()
    summed = visits.groupBy("seed", "node").agg(F.sum("mass").alias("e"))
    total = summed.groupBy("seed").agg(F.sum("e").alias("t"))
    scored = summed.join(total, "seed").select("seed", "node", (F.col("e") / F.col("t")).alias("score"))
    if direct:
        near = edges.select(F.col("u").alias("seed"), F.col("v").alias("node"), "w")
        scored = scored.join(near, ["seed", "node"], "left").select("seed", "node", (F.col("score") + F.coalesce("w", F.lit(0.0))).alias("score"))
    if top_k is None:
        return scored
    from sparkloom.operators.aggregates import top_per_group

    return top_per_group(scored, ["seed"], [F.desc("score"), F.asc("node")], top_k)


def vet_candidates(edges: DataFrame, now: Column, least: int = 2, ttl_days: int = 180, growth: float = 2.0, extra: int = 5, limit: int | None = None) -> DataFrame:
    """Edges never vetted, vetted too long ago, or grown since. edges: a, b, n, vetted, vetted_at, vetted_n."""
    due = F.col("vetted").isNull() | (F.col("vetted_at") < now - F.make_dt_interval(F.lit(ttl_days))) | (F.col("n") >= growth * F.col("vetted_n") + extra)
    out = edges.filter((F.col("n") >= least) & due).orderBy(F.desc("n"), "a", "b")
    return out if limit is None else out.limit(limit)


def _small(df: DataFrame, columns: list[str]) -> bool:
    """Whether these columns have SENT_BYTES or less."""
    size = df.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(32)))).first()[0]
    return (size or 0) <= SENT_BYTES


def frequent_tag_sets(entry_tags: DataFrame, least: int = 10, entry: str = "entry", tag: str = "tag", k: int = 3) -> DataFrame:
    """Sets of k tags (t1 < t2 < ...) that `least` entries or more wear, with their support.

    Entries that wear the same frequent tags are one row with their number. Level by level, a row with the first tags of
    a set has all tags that may come next in an array, so that no entry is joined with itself and only sums of what each
    task counted are shuffled. A set is tried only if the sets without its last, its last but one and its first tag are
    frequent, which is looked up in the table of frequent sets."""
    worn = entry_tags.select(F.col(entry).alias("e"), F.col(tag).alias("t1")).dropna().distinct().persist(StorageLevel.DISK_ONLY)
    frequent = worn.groupBy("t1").agg(F.count("*").alias("support")).filter(F.col("support") >= least).checkpoint()
    if k == 1:
        worn.unpersist()
        return frequent
    known = F.broadcast(frequent.select("t1")) if _small(frequent, ["t1"]) else frequent.select("t1")
    alike = worn.join(known, "t1", "left_semi").groupBy("e").agg(F.array_sort(F.collect_list("t1")).alias("s")).filter(F.size("s") >= k).groupBy("s").agg(F.count("*").alias("n"))
    # Dealt out by blocks of first tags, over a number of tasks that small rows don't lessen: few of them make many sets.
    cut = alike.select("n", "s", F.explode(F.sequence(F.lit(0), F.ceil(F.size("s") / PAIR_BLOCK).cast("int") - 1)).alias("_b"))
    cut = cut.repartition(int(worn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_b", "s").checkpoint()
    worn.unpersist()
    first = cut.select("n", "s", "_b", F.posexplode(F.slice("s", F.col("_b") * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK))).alias("_i", "t1"))
    rows = first.select("n", "t1", F.slice("s", F.col("_b") * PAIR_BLOCK + F.col("_i") + 2, F.size("s")).alias("rest"))
    for size in range(2, k + 1):
        t = [f"t{i}" for i in range(1, size + 1)]
        if size > 2:
            small = _small(frequent, t[:-1])
            after = frequent.groupBy(*t[:-2]).agg(F.collect_list(t[-2]).alias("after"))

            def sift(rows: DataFrame, by: list[str], need: int, after: DataFrame = after, small: bool = small) -> DataFrame:
                """Rows whose tags in `by` begin frequent sets, with what may come after them."""
                named = after.toDF(*by, "after")
                both = rows.join(F.broadcast(named) if small else named, by)
                return both.withColumn("rest", F.array_intersect("rest", "after")).drop("after").filter(F.size("rest") >= need)

            own = sift(rows, t[:-2], 2)
            longer = own.select("n", *t[:-2], "rest", F.posexplode("rest").alias("_i", t[-2]))
            rows = sift(longer.select("n", *t[:-1], F.slice("rest", F.col("_i") + 2, F.size("rest")).alias("rest")), t[1:-1], 1)
            rows = rows if small else rows.checkpoint()
        counted = rows.select("n", *t[:-1], F.explode("rest").alias(t[-1])).groupBy(*t).agg(F.sum("n").alias("support"))
        frequent = counted.filter(F.col("support") >= least).checkpoint()
    return frequent.select(*[f"t{i}" for i in range(1, k + 1)], "support")


def covered(tags: Column, view: Column) -> Column:
    """A view covers a cluster when it has max(1, floor(0.8 n)) of its tags; an empty cluster is covered, an empty
    view covers nothing."""
    need = F.greatest(F.lit(1), F.floor(F.size(tags) * 0.8).cast("int"))
    return (F.size(tags) == 0) | ((F.size(view) > 0) & (F.size(F.array_intersect(tags, view)) >= need))


def connected_components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, component), the smallest node reachable, by label propagation with a jump to the label's own label
    each round; lineage is cut by checkpoint()."""
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).unionByName(edges.select(F.col(v).alias("u"), F.col(u).alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label").checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m")).select(F.col("u").alias("node"), "m")
        new = labels.join(near, "node").select("node", F.least("label", "m").alias("label"))
        jump = new.join(new.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.least("label", "up").alias("label"))
        changed = jump.checkpoint()
        if changed.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty():
            return changed.withColumnRenamed("label", "component")
        labels = changed


def component_shared_tags(components: DataFrame, entry_tags: DataFrame, least_members: int = 3, least_tags: int = 1, entry: str = "entry", tag: str = "tag") -> DataFrame:
    """(component, members, tags) where all members share so many tags."""
    sizes = components.groupBy("component").agg(F.count("*").alias("members")).filter(F.col("members") >= least_members)
    worn = components.join(entry_tags.select(F.col(entry).alias("node"), F.col(tag).alias("tag")).distinct(), "node").groupBy("component", "tag").agg(F.count("*").alias("n"))
    shared = worn.join(sizes, "component").filter("n = members").groupBy("component", "members").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return shared.filter(F.size("tags") >= least_tags)


def without_entries(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges that touch none of the entries (a column id)."""
    return edges.join(entries.select(F.col("id").alias("a")), "a", "left_anti").join(entries.select(F.col("id").alias("b")), "b", "left_anti").select(edges.columns)


def direct_unvetted(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Per seed (a column entry) its k strongest edges that were never vetted. edges: a, b, n, vetted, last."""
    from sparkloom.operators.joins import neighbours

    return neighbours(edges.filter("vetted IS NULL").select("a", "b", "n", "last"), k, recent="last").join(seeds.select("entry"), "entry", "left_semi")
