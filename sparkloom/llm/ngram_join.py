"""Exact Jaccard self-join on word shingles, by partitions of the universe of shingles.

Sizes fall into bands. For a pair whose smaller set lies in a band, the sets differ in at most U shingles, a quarter of
the band's largest size. The universe is hashed into segments; when one of the two sets has U + 1 segments that hold
something, at least one of them is equal in both. So the hashes of a set's segments are its index keys, in its own band
and, as the larger set, in the band below that it can reach. In the lowest band one difference is allowed: there the
whole set and its one-deletion neighbourhood are the keys. What a key costs is counted over all sets: a set with enough
other keys gives up its common ones, and one without keeps them all. Sets that have too few filled segments also have
each of their shingles as a key.

Sets that share a key meet in the group of the key's smallest set, and are verified there exactly; a group too large
for a task is dealt out as pairs of its parts. Only links that join what was apart so far leave a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import filter_blocks, filter_cells, filter_table, stored, with_hit
from sparkloom.llm.components import components

WORDS = 5
#: A key that more sets have is common.
COMMON = 200
#: Sets, and shingles, that one task verifies against each other.
GROUP_SETS, GROUP_SHINGLES = 3000, 3_000_000
#: Keys, and bytes of sets, that one Arrow batch holds, about.
BATCH_KEYS, BATCH_BYTES = 200_000, 16 << 20
_U64 = np.uint64


def _bands(largest: int = 1 << 40) -> list[int]:
    """Where bands begin: 4, 8, then each by a factor of 1.6."""
    out = [4, 8]
    while out[-1] < largest:
        out.append(out[-1] * 8 // 5)
    return out


BANDS = np.array(_bands())


def segments(band: int) -> tuple[int, int]:
    """(segments, U) of a band."""
    low, high = int(BANDS[band]), int(BANDS[band + 1]) - 1
    return max(2, low * 62 // 100 + 2), high // 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


_SPACE = _spaces()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The low bytes of a number, by how many.
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 4 << 20


def _word_names(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes in eights, mixed in one after the other. data: with 8 bytes more behind."""
    eights = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    out = _mix(sizes.astype(_U64))
    rest = np.flatnonzero(sizes <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if at:
            rest = rest[sizes[rest] > at]
        if not len(rest):
            break
        out[rest] = _mix((out[rest] + _U64(0x9E3779B97F4A7C15)) ^ (eights[starts[rest] + at] & _LOW[np.minimum(sizes[rest] - at, 8)]))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return _mix(out)


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts of about SLICE_BYTES: their bytes, with 8 more behind, and where each text begins and the last ends."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        part = np.zeros(int(offsets[end] - offsets[at]) + 8, np.uint8)
        part[:-8] = _LOWER[data[offsets[at] : offsets[end]]]
        yield part, offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles. Bytes decide: only A-Z and ASCII white space count."""
    for data, offsets in _slices(texts):
        space = _SPACE[data[:-8]]
        space_before = np.append(True, space[:-1]) if len(space) else space
        space_before[offsets[:-1][offsets[:-1] < len(space)]] = True
        starts = np.flatnonzero(~space & space_before)
        space_after = np.append(space[1:], True) if len(space) else space
        space_after[offsets[1:-1][offsets[1:-1] > 0] - 1] = True
        sizes = np.flatnonzero(~space & space_after) + 1 - starts
        names = _word_names(data, starts, sizes)
        whole = np.full(max(0, len(names) - WORDS + 1), WORDS, _U64)
        for j in range(WORDS):
            whole = whole * _U64(0x9E3779B97F4A7C15) + names[j : j + len(whole)]
        whole = _mix(whole)
        bounds = np.searchsorted(starts, offsets).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= WORDS:
                out = np.sort(whole[a : b - WORDS + 1])
                yield out[np.append(True, out[1:] != out[:-1])]
            elif b > a:
                short = np.array([b - a], _U64)
                for i in range(a, b):
                    short = short * _U64(0x9E3779B97F4A7C15) + names[i : i + 1]
                yield _mix(short)
            else:
                yield np.empty(0, _U64)


def keys(s: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of a set, for each band that it takes part in: (keys, band, how many it can give up; -1: none)."""
    n = len(s)
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    for band in (own, own - 1):
        if band < 0 or (band < own and 100 * (int(BANDS[band + 1]) - 1) < 80 * n):
            continue
        salt = _U64((band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        m = _mix(s + salt)
        if band == 0:
            whole = np.add.reduce(m)
            yield _mix(np.append(whole - m, whole)), band, -1
            continue
        count, differ = segments(band)
        m.sort()
        segment = ((m >> _U64(32)) * _U64(count)) >> _U64(32)  # in the order of m
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        value = np.add.reduceat(_mix(m + _U64(1)), first)
        out = _mix(value + segment[first] * _U64(0xD6E8FEB86659FD93))
        if len(out) < differ + 1:
            yield np.concatenate([out, _mix(m + _U64(2))]), band, -1
        else:
            yield out, band, len(out) - differ - 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f, n = [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            f.append(xxhash.xxh3_64_intdigest(s.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(f, _U64).view(np.int64)), pa.array(n, pa.int64())], ["k", "f", "n"])


def _key_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, int, int, int]]]:
    """(keys, f, band, spare) of sets, lists of about BATCH_KEYS keys."""
    parts: list[tuple[np.ndarray, int, int, int]] = []
    size = 0
    for batch in batches:
        for s in shingle_sets(batch.column(0)):
            f = xxhash.xxh3_64_intdigest(s.tobytes())
            for out, band, spare in keys(s):
                parts.append((out, f, band, spare))
                size += len(out)
            if size >= BATCH_KEYS:
                yield parts
                parts, size = [], 0
    yield parts


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _key_parts(batches):
        yield _key_batch(parts)


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """40 bits of each key."""
    for parts in _key_parts(batches):
        short = np.concatenate([p[0] for p in parts] or [np.empty(0, _U64)]) & _U64((1 << 40) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64))], ["short"])


def _key_batch(parts: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
    sizes = [len(p[0]) for p in parts]
    key = np.concatenate([p[0] for p in parts] or [np.empty(0, _U64)]).view(np.int64)
    f = np.repeat(np.array([p[1] for p in parts], _U64), sizes).view(np.int64)
    band, spare = (np.repeat(np.array([p[i] for p in parts], np.int32), sizes) for i in (2, 3))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), pa.array(band), pa.array(spare)], ["key", "f", "band", "spare"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, f, groups) -> (group, f, the set's hashes)."""

    def emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "f", "data"])

    rows, size = [], 0
    for batch in batches:
        for s, own, groups in zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            s = s.tobytes()
            for g in groups:
                rows.append((g, own, s))
                size += len(s)
                if size >= BATCH_BYTES:
                    yield emit(rows)
                    rows, size = [], 0
    yield emit(rows)


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all sets of 100 * intersection >= 80 * union: a forest of them, found by comparing each set with
    all later ones over an index of the shingles that two or more have."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.diff(values, prepend=values[0] ^ _U64(1)))
    length = np.diff(np.append(edge, len(values)))
    run = np.repeat(np.arange(len(edge)), length)  # the shingle's number, for each of its sets
    end = edge[run] + length[run]
    by_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_owner], np.arange(n + 1))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    for i in range(n):
        at = by_owner[bounds[i] : bounds[i + 1]]
        begin, stop = at + 1, end[at]  # the later sets of each of its shingles
        lengths = stop - begin
        some = lengths > 0
        if not some.any():
            continue
        begin, lengths = begin[some], lengths[some]
        total = int(lengths.sum())
        index = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)
        both = np.bincount(owner[index], minlength=n)
        for j in np.flatnonzero(100 * both >= 80 * (size[i] + size - both)).tolist():
            a, b = root(i), root(j)
            if j != i and a != b:
                parent[b] = a
                out.append((i, j))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by group -> links (u, v)."""

    def settle(members: dict[int, bytes]) -> list[tuple[int, int]]:
        ids = list(members)
        return [(ids[a], ids[b]) for a, b in links_within([np.frombuffer(members[i], _U64) for i in ids])] if len(ids) > 1 else []

    def emit(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    group, members = None, {}
    for batch in batches:
        rows = []
        for g, f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if g != group:
                rows += settle(members)
                group, members = g, {}
            members[f] = data
        yield emit(rows)
    yield emit(settle(members))


def _probed(rows: DataFrame, key, keys_: DataFrame) -> DataFrame:
    """rows of which key may be in the one column of keys_, by a filter of bounded size."""
    blocks = filter_blocks(keys_.count())
    bitmaps = filter_table(keys_.select(F.explode(filter_cells(F.xxhash64(keys_.columns[0]), blocks)).alias("cell")).distinct())
    return with_hit(rows.withColumn("_f", F.xxhash64(key)), "_f", bitmaps, blocks, "_hit").drop("_f")


def _key_table(texts: DataFrame) -> DataFrame:
    """(key, f, band, spare) of keys that two sets or more may have."""
    rows = texts.mapInArrow(_key_rows, "key bigint, f bigint, band int, spare int")
    short = F.col("key").bitwiseAND(F.lit((1 << 40) - 1).cast("long"))
    shared = stored(texts.mapInArrow(_short_keys, "short bigint").groupBy("short").count().filter("count >= 2").select("short"))
    return stored(_probed(rows, short, shared).filter("_hit").drop("_hit"))


def _may_link(live: DataFrame, rounds: int = 1) -> DataFrame:
    """(key, f, band, spare, sets) of sets that can have a partner: of its filled segments all but U are equal in a
    partner's, so at least spare + 1 of a set's keys must be another set's too. Two sets that link both stay, and with
    them the keys that they share; each round, the keys that are left alone go."""
    for i in range(rounds):
        counts = live.groupBy("key").agg(F.count("*").alias("sets")).filter("sets >= 2")
        met = live.select("key", "f", "band", "spare").join(counts, "key")
        able = met.groupBy("f", "band").agg(F.count("*").alias("n"), F.first("spare").alias("left")).filter("n > left").select("f", "band")
        live = met.join(able, ["f", "band"], "left_semi")
        live = stored(live)
    counts = live.groupBy("key").agg(F.count("*").alias("_n")).filter("_n >= 2")
    return live.join(counts, "key").select("key", "f", "band", "spare", F.col("_n").alias("sets"))


def _each_set_once(rows: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts of one row for each set; only rows that may be copies shuffle."""
    copies = stored(sets.filter("n > 0").select("k").distinct().join(classes.select("k"), "k", "left_anti"))
    probed = _probed(rows, "k", copies)
    return probed.filter("NOT _hit").select("text").unionByName(probed.filter("_hit").join(copies, "k", "left_anti").select("text"))


def similar_sets(rows: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between sets. rows: k, text; sets: k, f, n; classes: f, k (of one row that has the set), n."""
    texts = _each_set_once(rows, sets, classes)
    met = stored(_may_link(_key_table(texts)))
    lacking = met.filter(F.col("sets") > COMMON).groupBy("f", "band").agg(F.count("*").alias("common"), F.first("spare").alias("left")).filter("common > left").select("f", "band")
    kept = met.filter(F.col("sets") <= COMMON).select("key", "f").unionByName(met.filter(F.col("sets") > COMMON).join(lacking, ["f", "band"]).select("key", "f"))
    pivots = kept.groupBy("key").agg(F.min("f").alias("pivot"))
    pairs = stored(kept.join(pivots, "key").select("pivot", "f").distinct())

    sizes = pairs.join(classes.select("f", "n"), "f").groupBy("pivot").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(2 * F.col("sets") / GROUP_SETS), F.ceil(2 * F.col("total") / GROUP_SHINGLES)).cast("int")
    one = (F.col("sets") <= GROUP_SETS) & (F.col("total") <= GROUP_SHINGLES)
    sizes = sizes.filter("sets >= 2").select("pivot", "sets", F.when(one, F.lit(1)).otherwise(parts).alias("parts"))
    # Groups with a thousandth of all rows or more are at most a thousand, so what is known of them is broadcast; none
    # of the others can fill a shuffle partition.
    sizes, n = stored(sizes), pairs.count()
    marked = pairs.join(F.broadcast(sizes.filter(F.col("sets") * 1000 >= n).select("pivot", "parts")), "pivot", "left")
    others = marked.filter("parts IS NULL").drop("parts").join(sizes.filter(F.col("sets") * 1000 < n).select("pivot", "parts"), "pivot")
    dealt = marked.filter("parts IS NOT NULL").unionByName(others).withColumn("c", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    # A set goes to every group of two parts of which one is its own; with one part, to the one group.
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = other.select("f", F.xxhash64("pivot", F.least("c", "o"), F.greatest("c", "o")).alias("g"))
    asked = stored(grouped.groupBy("f").agg(F.collect_set("g").alias("groups")))

    wanted = stored(classes.select("f", "k").join(asked, "f"))
    hit = _probed(rows, "k", wanted.select("k")).filter("_hit").select("text", "k")
    members = hit.join(wanted, "k").select("text", "f", "groups").mapInArrow(_members, "g bigint, f bigint, data binary")
    return members.repartition("g").sortWithinPartitions("g", "f").mapInArrow(_linked, "u bigint, v bigint")


def _joined(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, id, n, component, stays, rows) for each distinct row: stays is true for one of each component, rows counts its repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(F.col(id_col), text).alias("k"), text.alias("text"))
    sets = stored(rows.mapInArrow(_sets, "k bigint, f bigint, n bigint"))
    ids = stored(df.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id")))
    classes = stored(sets.filter("n > 0").groupBy("f").agg(F.min("k").alias("k"), F.first("n").alias("n")))
    found = components(similar_sets(rows, sets, classes))
    named = sets.dropDuplicates(["k"]).join(ids.groupBy("k", "id").agg(F.count("*").alias("rows")), "k").join(found.select(F.col("node").alias("f"), "component"), "f", "left")
    named = stored(named.select("k", "id", "n", "f", "rows", F.when(F.col("n") > 0, F.coalesce("component", "f")).alias("c")))
    least = named.filter("n > 0").groupBy("c").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k")).alias("first"))
    component, stays = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")), (F.col("n") == 0) | (F.col("k") == F.col("first.k"))
    return named.join(least, "c", "left").select("k", "id", "n", component.alias("component"), stays.alias("stays"), "rows")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct row (id, text) of df: id_col, n_shingles, component_id.

    A set is the text's distinct shingles of WORDS words, A-Z lower-cased; a text of fewer words is one shingle; null,
    empty and blank texts have none and link with nothing. Sets link when 100 * intersection >= 80 * union;
    component_id is the smallest id reachable, itself included (null ids are larger than all). Rows that repeat an
    id and its text count once. An empty table gives an empty result, other columns are ignored.
    """
    return _joined(df, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one row of each component: the one with the smallest id (null ids are larger than all).
    Of rows that repeat an id and its text one stays."""
    verdict = stored(_joined(df.select(id_col, text_col), id_col, text_col).filter("NOT stays OR rows > 1").select("k", "stays"))
    keyed = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)], F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("k"))
    probed = _probed(keyed, "k", verdict.select("k").distinct())
    # Rows of one k are equal in id and text; those of a k that repeats are all among the hits.
    once = probed.filter("_hit").drop("_hit").dropDuplicates(["k"]).join(verdict.filter("NOT stays").select("k"), "k", "left_anti")
    stay = probed.filter("NOT _hit").drop("_hit").unionByName(once)
    return stay.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
