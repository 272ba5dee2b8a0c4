"""Joins and hierarchies: bundles, validity, path closure, table differences, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.windows import row_numbers


def with_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Live entries with their live files."""
    return entries.filter("deleted_at IS NULL").join(files.filter("deleted_at IS NULL").drop("deleted_at"), "file_id")


def symmetric(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair in both directions, as (entry, other)."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    one = pairs.select(F.col(a).alias("entry"), F.col(b).alias("other"), *rest)
    return one.unionByName(pairs.select(F.col(b).alias("entry"), F.col(a).alias("other"), *rest))


def neighbours(pairs: DataFrame, k: int, a: str = "a", b: str = "b", weight: str = "n", recent: str | None = None) -> DataFrame:
    """Per entry its k strongest others, by weight, recency, id."""
    order = [F.desc(weight), *([F.desc(recent)] if recent else []), F.asc("other")]
    both = symmetric(pairs, a, b)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).filter(F.col("rank") <= k)


def one_hop(pairs: DataFrame, anchors: DataFrame, a: str = "a", b: str = "b", weight: str = "n") -> DataFrame:
    """Others next to anchors (query_id, entry) that are no anchors of the query themselves, with their
    strongest count and their anchors."""
    met = symmetric(pairs, a, b).join(anchors, "entry")
    outside = met.join(anchors.withColumnRenamed("entry", "other"), ["query_id", "other"], "left_anti")
    return outside.groupBy("query_id", "other").agg(F.max(weight).alias("count"), F.array_sort(F.collect_set("entry")).alias("anchors"))


def not_processed(candidates: DataFrame, outcomes: DataFrame, since, key: str = "id", at: str = "completed_at") -> DataFrame:
    """Candidates without an outcome since then."""
    return candidates.join(outcomes.filter(F.col(at) >= since).select(key), key, "left_anti")


def mentioning(notes: DataFrame, wanted: DataFrame, ids: str = "entry_ids", key: str = "note_id") -> DataFrame:
    """Notes that mention any wanted id (a column id)."""
    hits = notes.select(key, F.explode(ids).alias("id")).join(wanted.select("id"), "id", "left_semi").select(key)
    return notes.join(hits, key, "left_semi")


def reference_validity(notes: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Per note (note_id, created_at, entry_ids) is_stale and its reasons. entries: id, file_id, deleted_at;
    files: file_id, deleted_at, ingested_at. The first reason that holds counts for a reference."""
    refs = notes.select("note_id", "created_at", F.explode_outer("entry_ids").alias("id"))
    e = entries.select("id", "file_id", F.col("deleted_at").alias("_ed"), F.lit(True).alias("_e"))
    f = files.select("file_id", F.col("deleted_at").alias("_fd"), "ingested_at")
    reason = (
        F.when(F.col("id").isNull(), "unreferenced").when(F.col("_e").isNull(), "missing").when(F.col("_ed").isNotNull(), "entry_deleted")
        .when(F.col("_fd").isNotNull(), "file_deleted").when(F.col("ingested_at") > F.col("created_at"), "file_reingested_after_note")
    )
    marked = refs.join(e, "id", "left").join(f, "file_id", "left").withColumn("reason", reason)
    stale = F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "unreferenced")) > 0
    return marked.groupBy("note_id").agg(stale.alias("is_stale"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def closure(nodes: DataFrame, id_col: str = "id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, id, depth) for every node, itself at depth 0. Doubles paths each round, so a tree of depth d
    takes log2(d) joins; a node on a cycle stops where it comes back to itself, and with the least depth of each pair it ends."""
    up = nodes.filter(F.col(parent).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent).alias("ancestor")).join(nodes.select(F.col(id_col).alias("ancestor")), "ancestor")
    paths = up.select("ancestor", "id", F.lit(1).alias("depth")).filter("ancestor <> id").checkpoint()
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("b.ancestor").alias("ancestor"), F.col("a.id").alias("id"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        longer = longer.filter("ancestor <> id").unionByName(paths)
        grown = longer.groupBy("ancestor", "id").agg(F.min("depth").alias("depth")).checkpoint()
        if grown.count() == paths.count():
            break
        paths = grown
    return paths.unionByName(nodes.select(F.col(id_col).alias("ancestor"), F.col(id_col).alias("id"), F.lit(0).alias("depth")))


def subtree_rollup(closed: DataFrame, entries: DataFrame, roots: DataFrame, status: str = "status") -> DataFrame:
    """Per root (a column root), total and count by status over its whole subtree. entries: folder, status."""
    inside = roots.join(closed.select(F.col("ancestor").alias("root"), F.col("id").alias("folder")), "root").join(entries, "folder", "left")
    return inside.groupBy("root", F.col(status).alias("status")).agg(F.count(status).alias("n"))


def paths(closed: DataFrame, names: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """Display path /a/b/c of each node."""
    named = closed.join(names.select(F.col(id_col).alias("ancestor"), F.col(name).alias("_name")), "ancestor")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "_name")))
    return named.groupBy("id").agg(F.concat(F.lit("/"), F.array_join(F.transform(steps, lambda s: s["_name"]), "/")).alias("path"))


def path_to_id(asked: DataFrame, paths_: DataFrame) -> DataFrame:
    """Per asked path or bare name (column raw), the id when one matches, else ambiguous or not_found. Paths begin
    with a slash and are joined on the whole path, names on the last part; a null is not found."""
    known = paths_.select("id", "path", F.substring_index("path", "/", -1).alias("name"))
    is_path = F.coalesce(F.startswith("raw", F.lit("/")), F.lit(False))
    full = asked.filter(is_path).select("raw").join(known.select("id", F.col("path").alias("raw")), "raw", "left")
    bare = asked.filter(~is_path).select("raw").join(known.select("id", F.col("name").alias("raw")), "raw", "left")
    n = F.count_distinct("id")
    return full.unionByName(bare).groupBy("raw").agg(F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(n == 1, F.min("id")).alias("id"))


def latest_per_key(df: DataFrame, key: str, at: str, value: str, tie: str | None = None) -> DataFrame:
    """The newest value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(at, tie) if tie else F.col(at)).alias(value), F.max(at).alias(at))


def first_message(turns: DataFrame, session: str = "session_id", turn: str = "turn_index", text: str = "user_message") -> DataFrame:
    """J15."""
    return turns.groupBy(session).agg(F.min_by(text, turn).alias(text))


def resolve_tags(asked: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per asked (name, facet or null), the canonical tag: by name with one alias hop, else by alias history."""
    t = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("_n"), F.col("facet").alias("_f"), "alias_of")
    direct = asked.join(t, (F.lower("name") == F.lower("_n")) & (F.col("facet").isNull() | (F.col("facet") == F.col("_f"))), "left")
    best = direct.groupBy("name", "facet").agg(F.min_by(F.struct("tag_id", "alias_of"), "tag_id").alias("d"))
    past = best.join(aliases.groupBy(F.lower("from_name").alias("_l")).agg(F.max_by("to_tag_id", "created_at").alias("to_tag_id")), F.lower("name") == F.col("_l"), "left")
    via = F.when(F.col("d.tag_id").isNotNull(), "name").when(F.col("to_tag_id").isNotNull(), "alias_history")
    return past.select("name", "facet", F.coalesce("d.alias_of", "d.tag_id", "to_tag_id").alias("tag_id"), via.alias("via"), (F.col("d.alias_of").isNotNull() | (via == "alias_history")).alias("was_alias"))


def disk_diff(disk: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, entry_id, state, from_path) with state in_sync, modified, moved, missing, new. disk: path, sha256;
    expected: entry_id, path, sha256 and, if there is one, storage_key.

    Each path is claimed once, in stages: by the entry that expects it; by an entry left whose own storage key it is
    and whose content it has, the smallest id first; by the entries left of its content, in the order of their ids, who
    get paths first that no entry expects or stores, in the order of paths. Copies of one content may be many: they
    are numbered by row_numbers()."""
    key = F.col("storage_key").cast("string") if "storage_key" in expected.columns else F.lit(None).cast("string")
    d = disk.select("path", F.col("sha256").alias("dsha"))
    e = expected.select("entry_id", "path", F.col("sha256").alias("sha"), key.alias("key"))
    none = F.lit(None).cast("string").alias("from_path")
    at_place = e.join(d, "path").select("path", "entry_id", F.when(F.col("dsha") == F.col("sha"), "in_sync").otherwise("modified").alias("state"), none)
    left = e.join(d.select("path"), "path", "left_anti")
    free = d.join(e.select("path").distinct(), "path", "left_anti")
    kept = left.join(free.select(F.col("path").alias("key"), F.col("dsha").alias("sha")), ["key", "sha"])
    kept = kept.groupBy(F.col("key").alias("at")).agg(F.min(F.struct("entry_id", "path")).alias("m")).select("at", "m.entry_id", F.col("m.path").alias("from_path")).checkpoint()
    pending = left.join(kept.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.col("path").alias("from_path"), "sha")
    owned = e.select(F.col("key").alias("path")).dropna().distinct().withColumn("owned", F.lit(1))  # expected paths aren't free
    open_paths = free.join(kept.select(F.col("at").alias("path")), "path", "left_anti").join(owned, "path", "left").select("path", F.col("dsha").alias("sha"), F.coalesce("owned", F.lit(0)).alias("owned"))
    paired = row_numbers(open_paths, ["sha"], ["owned", "path"], "_r").join(row_numbers(pending, ["sha"], ["entry_id"], "_r"), ["sha", "_r"], "full_outer")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("entry_id").isNull(), "new").otherwise("moved")
    rest = paired.select(F.coalesce("path", "from_path").alias("path"), "entry_id", state.alias("state"), F.when(F.col("path").isNotNull(), F.col("from_path")).alias("from_path"))
    return at_place.unionByName(kept.select(F.col("at").alias("path"), "entry_id", F.lit("moved").alias("state"), "from_path")).unionByName(rest)


def content_seeds(files: DataFrame, sha: str = "sha256", at: str = "created_at", id_col: str = "id") -> DataFrame:
    """Per content, its oldest row."""
    return files.groupBy(sha).agg(F.min_by(id_col, F.struct(at, id_col)).alias("seed_id"), F.count("*").alias("copies"))


def orphans(files: DataFrame, entries: DataFrame, key: str = "file_id") -> DataFrame:
    """Files that no entry is left of."""
    return files.join(entries.select(key), key, "left_anti")


def sync_plan(left: DataFrame, right: DataFrame, new: str, changed: str = "changed", key: str = "id", sha: str = "sha256") -> DataFrame:
    """Rows of left that right hasn't (state `new`) or has with another hash (`changed`)."""
    there = right.select(F.col(key), F.col(sha).alias("_sha"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), new).when(~F.col(sha).eqNullSafe(F.col("_sha")), changed)
    return left.join(there, key, "left").select(key, sha, state.alias("state")).filter("state IS NOT NULL")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """U4: rows of left whose keys no row of right has; nulls are equal to nulls."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)]).distinct()
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], "left_anti")


# Pairs are made in rectangles of SIDE ids a side, in which ids return near each other, so that files of pairs
# stay small. A unit is at most UNIT_A by UNIT_B rectangles; one of more than UNIT_PAIRS pairs is made of fewer.
SIDE, UNIT_A, UNIT_B, UNIT_PAIRS, MAX_PARTS = 256, 16, 256, 1 << 27, 10_000


def missing_pairs(left: DataFrame, right: DataFrame, on: Column | tuple[Column, Column], taken: DataFrame, a: str, b: str) -> DataFrame:
    """U4 over a product: (a, b) of left (a) and right (b) that meet `on` and stand in no row of taken (a, b). `on` is a
    condition, or the sides (of a, of b) of an equation, and then only groups of equal sides meet. Only the given rows are
    shuffled, never the pairs: units of a group's a's and b's meet, and what is left of their pairs is given where they are made."""
    side_a, side_b = on if isinstance(on, tuple) else (F.lit(0), F.lit(0))
    kind_a, kind_b = (df.select(c).union(taken.select(c)).schema[0].dataType for df, c in ((left, a), (right, b)))
    col_a, col_b = F.col(a).cast(kind_a).alias("_a"), F.col(b).cast(kind_b).alias("_b")
    lefts, rights = left.select(side_a.alias("_g"), col_a), right.select(side_b.alias("_g"), col_b)
    sizes = lefts.groupBy("_g").agg(F.count("*").alias("_l")).join(rights.groupBy("_g").agg(F.count("*").alias("_r")), "_g")
    most_a, most_b, pairs = sizes.agg(F.max("_l"), F.max("_r"), F.sum(F.col("_l").cast("double") * F.col("_r"))).first()
    most_a, most_b, pairs = most_a or 1, most_b or 1, pairs or 1.0

    strips, blocks = -(-most_a // SIDE), -(-most_b // SIDE)
    high = min(most_b, UNIT_B * SIDE)
    unit = min(max(pairs / (2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 20), UNIT_PAIRS)
    wide = min(max(int(unit / high / SIDE), 1), UNIT_A)
    parts = min(int(pairs / (wide * SIDE * high)) + 1, MAX_PARTS)
    strip, block = F.pmod(F.hash("_a"), F.lit(strips)).alias("_strip"), F.pmod(F.hash("_b"), F.lit(blocks)).alias("_block")
    row, span = F.floor(F.col("_strip") / wide).cast("int"), F.floor(F.col("_block") / UNIT_B).cast("int")
    rows, spans = (F.explode(F.sequence(F.lit(0), F.lit((n - 1) // each))) for n, each in ((strips, wide), (blocks, UNIT_B)))

    keys = ["_g", "_strip", "_span"]
    had = taken.filter(side_a == side_b).select(side_a.alias("_g"), col_a, col_b).dropna().select("*", strip, block).withColumn("_span", span)
    had = had.repartition(*keys).groupBy(*keys, "_block", "_b").agg(F.collect_set("_a").alias("_had"))
    had = had.groupBy(*keys, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_had"))).alias("_had"))
    had = had.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_block", "_had"))).alias("_had"))

    near = lefts.select("*", strip).repartition("_g", "_strip").groupBy("_g", "_strip").agg(F.collect_list(F.struct("_a"))["_a"].alias("_as"))
    whole = F.size("_as") - F.size("_as") % 8  # files pack ids by eights: only then does a strip that returns look as before
    near = near.withColumn("_as", F.explode(F.array(F.slice("_as", 1, whole), F.slice("_as", whole + 1, F.size("_as") - whole))))
    near = near.withColumn("_span", spans).join(had, keys, "left").withColumn("_row", row).repartition(parts, "_g", "_row", "_span")
    far = rights.select("*", block).groupBy("_g", "_block").agg(F.collect_list(F.struct("_b"))["_b"].alias("_bs"))
    far = far.withColumn("_span", span).withColumn("_row", rows).repartition(parts, "_g", "_row", "_span")
    met = near.hint("merge").join(far, ["_g", "_row", "_span"]).select("_as", "_bs", F.try_element_at("_had", F.col("_block")).alias("_had"))

    # Lambdas keep this step apart from the generated code of the join and of the next step, which hold all that a row gives.
    met = met.select("_as", F.transform("_bs", lambda x: F.struct(x.alias("b"), F.try_element_at("_had", x).alias("had"))).alias("_bs"))
    met = met.select("_as", F.explode(F.concat(F.filter("_bs", lambda x: x["had"].isNull()), F.filter("_bs", lambda x: x["had"].isNotNull()))).alias("_r"))
    out = met.select(F.explode("_as").alias("_a"), F.col("_r.b").alias("_b"), F.col("_r.had").alias("_had")).filter(~F.coalesce(F.array_contains("_had", F.col("_a")), F.lit(False)))
    out = out.select(F.col("_a").cast(left.schema[a].dataType).alias(a), F.col("_b").cast(right.schema[b].dataType).alias(b))
    return out if isinstance(on, tuple) else out.filter(on)


def bundle(entries: DataFrame, tags: DataFrame, related: DataFrame, key: str = "id", catalogs: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Entries with their tag names and related ids as sorted arrays, and the paths of their catalog and folder
    where such tables (id, path; from paths()) are given and the entries have catalog_id and folder_id."""
    t = tags.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    r = related.groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("related"))
    empty = F.array().cast("array<string>")
    out = entries.join(t, key, "left").join(r, key, "left")
    for of, known in (("catalog", catalogs), ("folder", folders)):
        if known is not None:
            out = out.join(known.select(F.col("id").alias(f"{of}_id"), F.col("path").alias(f"{of}_path")), f"{of}_id", "left")
    return out.withColumns({"tags": F.coalesce("tags", empty), "related": F.coalesce(F.col("related").cast("array<string>"), empty)})


def verified_citations(citations: DataFrame, reads: DataFrame) -> DataFrame:
    """Citations (entry_id, quote, page) whose quote occurs in a read (entry_id, text) of the same entry, each
    once. Each quote and text is brought to its normal form once, before the join, which stops at a citation's first read."""
    c = citations.select("entry_id", "quote", "page").distinct().withColumn("_q", T.normalize_quote(F.col("quote")))
    r = reads.select(F.col("entry_id").alias("_e"), T.normalize_quote(F.col("text")).alias("_t"))
    return c.join(r, (F.col("entry_id") == F.col("_e")) & T.quote_in_source(F.col("_q"), F.col("_t"), normal=True), "left_semi").select("entry_id", "quote", "page")


def quote_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Per (doc, quote), the first page (doc, page, text) that has it."""
    q = quotes.withColumn("_q", T.normalize_quote(F.col("quote")))
    p = pages.select("doc", "page", T.normalize_quote(F.col("text")).alias("_t"))
    hits = q.join(p, "doc").filter(T.quote_in_source(F.col("_q"), F.col("_t"), normal=True)).groupBy("doc", "quote").agg(F.min("page").alias("page"))
    return quotes.join(hits, ["doc", "quote"], "left")


def prior_insights(insights: DataFrame, sessions: DataFrame, k: int = 20) -> DataFrame:
    """Per session (session_id, entry_ids) the k newest insights (insight_id, entry_ids, created_at) that share an
    entry with it or have none. An insight among a session's k newest is among the k newest of the entry they share, so
    only those are joined."""
    newest = [F.desc("created_at"), F.desc("insight_id")]
    each = insights.select("insight_id", "created_at", F.explode("entry_ids").alias("id")).distinct()
    latest = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*newest))).filter(F.col("_r") <= k).drop("_r")
    shared = sessions.select("session_id", F.explode("entry_ids").alias("id")).distinct().join(latest, "id").select("session_id", "insight_id", "created_at").distinct()
    loose = insights.filter(F.size("entry_ids") == 0).orderBy(*newest).limit(k).select("insight_id", "created_at")
    both = shared.unionByName(sessions.select("session_id").join(F.broadcast(loose)).select("session_id", "insight_id", "created_at"))  # k rows
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest))).filter(F.col("rank") <= k)


def lookup(entries: DataFrame, wanted: DataFrame, variant: str = "any", key: str = "id") -> DataFrame:
    """Entries of the wanted ids (a column of that name): any, live or active."""
    from sparkloom.operators import filters

    out = entries.join(wanted.select(key), key, "left_semi")
    return out if variant == "any" else out.filter(filters.live() if variant == "live" else filters.active())


def entry_tag_names(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame, canonical: bool = True) -> DataFrame:
    """(entry_id, tag_id, name, facet) of entries (entry_id); canonical: without aliases."""
    known = tags.filter("alias_of IS NULL") if canonical else tags
    return entries.select("entry_id").join(entry_tags, "entry_id").join(known.select(F.col("id").alias("tag_id"), "name", "facet"), "tag_id").select("entry_id", "tag_id", "name", "facet")


def relation_endpoints(relations: DataFrame, entries: DataFrame, files: DataFrame, least: int = 1) -> DataFrame:
    """Relations (a, b, n) seen so often, of which both ends are live and have a summary, with names and
    summaries. entries: id, file_id, name, deleted_at; files: file_id, summary, deleted_at."""
    ends = with_files(entries, files).filter("summary IS NOT NULL").select("id", "name", "summary")
    side = lambda x: ends.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"), F.col("summary").alias(f"{x}_summary"))
    return relations.filter(F.col("n") >= least).join(side("a"), "a").join(side("b"), "b")


def cited_entries(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations (entry_id or a prefix) with the live entry's id and name, and missing."""
    from sparkloom.operators import filters

    live = entries.filter(filters.live())
    ids = filters.resolve_id_prefix(citations.select(F.col("entry_id").alias("raw")).distinct(), live.select("id", "name")).select(F.col("raw").alias("entry_id"), "id")
    return citations.join(ids, "entry_id", "left").join(live.select("id", "name"), "id", "left").withColumn("missing", F.col("name").isNull())


def scoped_files(files: DataFrame, entries: DataFrame, scope: DataFrame, column: str, status: str | None = None) -> DataFrame:
    """Distinct files of live entries whose column (catalog_id, folder_id, or entry_id for a tag's entries) is in
    scope, by ingest status if one is given."""
    inside = entries.filter("deleted_at IS NULL").join(scope.select(column), column, "left_semi").select("file_id").distinct()
    out = files.filter("deleted_at IS NULL").join(inside, "file_id", "left_semi")
    return out if status is None else out.filter(F.col("ingest_status") == status)
