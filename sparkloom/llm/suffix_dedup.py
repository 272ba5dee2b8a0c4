"""Repeated byte strings, by sorting the suffixes at sampled anchors.

Every window of `length` bytes has one anchor: the smallest hash of a 24-byte string within its first half. So equal
windows have equal anchors at equal places, and all of an anchor's windows share the bytes after it up to the shortest
window's end, its core. Spark groups anchors by core. An anchor whose whole stretch of windows occurs twice is settled
by that count. What is left are the ends of repeats: there the suffixes behind the core and the reversed prefixes
before it are sorted (multikey quicksort to a shallow depth, blind tries for what is still equal), and the common
prefixes of neighbours in the two orders decide how far each member's match with any other reaches to either side.
Groups too large for one task are split first into halves of their windows, each with a longer core, until they are
small or a core is a whole window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, filter_blocks, filter_cells, filter_table, stored, with_hit

LENGTH = 400
GRAM = 24
#: Members of a core that one task sorts at once (a few seconds, some 20 MB). A larger group isn't cut: its windows are
#: split (_halves).
GROUP = 20_000
#: Bytes that the multikey quicksort looks at; longer common prefixes go to blind tries.
SHALLOW = 32
#: Bytes before and after cores that one Arrow batch holds.
BATCH_BYTES = 16 << 20
_TABLE = np.random.default_rng(10).integers(1, 1 << 32, 256, dtype=np.uint32)


def reach(length: int) -> int:
    """The most bytes from a window's start to its anchor; the anchor's core has length - reach(length) bytes."""
    return length // 2 - GRAM


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and last window start of each."""
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none
    h, width = _TABLE[data], 1
    for _ in range(3):  # h[i]: of 8 bytes from i
        h = h[:-width] + np.uint32(pow(0x9E3779B1, width, 1 << 32)) * h[width:]
        width *= 2
    m = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (8, 16)]
    h = h[:-16] + m[0] * h[8:-8] + m[1] * h[16:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    v = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, w = 1, reach(length) + 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    v = np.minimum(v[: len(v) - (w - width)], v[w - width :])[: n - length + 1]
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first, np.append(first[1:], len(at)) - 1


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] is common, a[:n] is not
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids in the order of their strings. Inner nodes hold a depth and children by the byte there; a string is led
    down by those bytes alone and compared once, with the leaf it comes to."""
    root: list | tuple = [ids[0]]  # a leaf: ids of equal strings; an inner node: (depth, children)
    for i in ids[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        common = lcp(s, other)
        if common == len(s) == len(other):
            node.append(i)
            continue
        parent, key, node = None, None, root
        while isinstance(node, tuple) and node[0] < common:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        mine = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [i]
            continue
        grown = (common, {mine: [i], other[common] if common < len(other) else -1: node})
        if parent is None:
            root = grown
        else:
            parent[1][key] = grown
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of strings: three-way quicksort by eight bytes at a time, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) == 1:
            out += ids
        elif depth >= SHALLOW:
            out += blind_trie(strings, ids)
        else:
            key = [strings[i][depth : depth + 8] for i in ids]
            pivot = sorted((key[0], key[len(ids) // 2], key[-1]))[1]
            parts = ([i for i, k in zip(ids, key, strict=True) if k > pivot], [i for i, k in zip(ids, key, strict=True) if k == pivot], [i for i, k in zip(ids, key, strict=True) if k < pivot])
            equal = parts[1] if len(pivot) == 8 else None
            if equal is None:  # ended strings: what is equal is equal to the end
                stack += [(parts[0], depth)] * bool(parts[0])
                stack += [([i], depth) for i in parts[1]]
            else:
                stack += [(parts[0], depth)] * bool(parts[0])
                stack.append((equal, depth + 8))
            stack += [(parts[2], depth)] * bool(parts[2])
    return out


def _ordered(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings, and the prefix that each place in it shares with the place before."""
    order = deep_shallow(strings)
    return order, [0, *[lcp(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]]


def _between(common: list[int]):
    """Least of common[i + 1 .. j], by a table of the least of runs of 2^k."""
    levels, width = [common], 1
    while 2 * width <= len(common):
        last = levels[-1]
        levels.append([min(a, b) for a, b in zip(last, last[width:], strict=False)])
        width *= 2

    def least(i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return min(levels[k][i + 1], levels[k][j + 1 - (1 << k)])

    return least


def _furthest(order: list[int], common: list[int], other: list[int], other_common: list[int], needed: int) -> list[int]:
    """For each string the longest prefix in `order` shared with a string whose prefix in the other order makes up at
    least `needed` bytes with it; -1 without one.

    Neighbours in `order` are merged from the longest common prefix to the shortest. Within a merged run all strings
    share that prefix at least, and the best partner in the other order is a neighbour there. A string that finds none
    at one length can only find one at a shorter length next to a string that has just come to its run."""
    n = len(order)
    rank, least = [0] * n, _between(other_common)
    for r, i in enumerate(other):
        rank[i] = r
    out, most = [-1] * n, max(other_common)
    runs: list[list[int]] = [[rank[i]] for i in order]  # of a run's root: its ranks, sorted
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in sorted(range(1, n), key=common.__getitem__, reverse=True):
        shared = common[k]
        if shared + most < needed:
            break
        small, large = sorted((root(k - 1), root(k)), key=lambda i: len(runs[i]))
        few, many = runs[small], runs[large]
        parent[small], runs[small] = large, []
        for r in few:
            insort(many, r)
        for r in few:
            at = bisect_left(many, r)
            for x, y in ((at - 1, at), (at, at + 1)):
                if x >= 0 and y < len(many):
                    a, b = other[many[x]], other[many[y]]
                    if (out[a] < 0 or out[b] < 0) and shared + least(many[x], many[y]) >= needed:
                        out[a], out[b] = max(out[a], shared), max(out[b], shared)
    return out


def resolve(members: list[tuple[bytes, bytes]], needed: int) -> list[tuple[int, int] | None]:
    """Of members (bytes before the core, bytes after it) the smallest and largest distance from the anchor back to
    the start of a window that another member has too; a window has `needed` bytes besides the core."""
    behind, before = _ordered([m[1] for m in members]), _ordered([m[0][::-1] for m in members])
    right, left = _furthest(*behind, *before, needed), _furthest(*before, *behind, needed)
    return [(needed - r, n) if r >= 0 else None for r, n in zip(right, left, strict=True)]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    core = length - reach(length)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out: list[list] = [[] for _ in range(6)]
        for key, data in zip(keys, batch.column(1).to_pylist(), strict=True):
            at, first, last = anchors(np.frombuffer(data, np.uint8), length)
            places, firsts, lasts = at.tolist(), first.tolist(), last.tolist()
            out[0] += [xxhash.xxh3_64_intdigest(data[p : p + core]) for p in places]
            out[1] += [xxhash.xxh3_64_intdigest(data[a : b + length], p - a) for p, a, b in zip(places, firsts, lasts, strict=True)]
            out[2] += [key] * len(places)
            out[3] += places
            out[4] += (at - last).tolist()
            out[5] += (at - first).tolist()
            if len(out[0]) >= 50_000:
                yield _batch(out)
                out = [[] for _ in range(6)]
        yield _batch(out)


_ROW = "core bigint, stretch bigint, k bigint, at int, lo int, hi int"
_MEMBER = "core bigint, n bigint, k bigint, at int, lo int, hi int, before binary, after binary"
_MEMBER_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _batch(out: list[list]) -> pa.RecordBatch:
    arrays = [pa.array(np.array(out[i], dtype=np.uint64).view(np.int64)) for i in (0, 1)]
    arrays += [pa.array(out[2], pa.int64()), *[pa.array(c, pa.int32()) for c in out[3:]]]
    return pa.RecordBatch.from_arrays(arrays, ["core", "stretch", "k", "at", "lo", "hi"])


def _around(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(data, members of it) -> the members with the bytes before and after their cores."""
    core, names = length - reach(length), ["core", "n", "k", "at", "lo", "hi", "before", "after"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MEMBER_TYPES, strict=True)], names)

    rows, size = [], 0
    for batch in batches:
        for data, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for m in members:
                p, hi, lo = m["at"], m["hi"], m["lo"]
                rows.append((m["core"], m["n"], m["k"], p, lo, hi, data[p - hi : p], data[p + core : p - lo + length]))
                size += length
                if size >= BATCH_BYTES:
                    yield emit(rows)
                    rows, size = [], 0
    yield emit(rows)


def _resolved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Members sorted by core -> stretches (k, begin, end) of those that occur once."""

    def settle(group: list[dict]) -> list[tuple[int, int, int]]:
        found = resolve([(m["before"], m["after"]) for m in group], reach(length))
        return [(m["k"], m["at"] - d[1], m["at"] - d[0] + length) for m, d in zip(group, found, strict=True) if d and m["n"] == 1]

    def emit(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k", "begin", "end"])

    group: list[dict] = []
    for batch in batches:
        rows = []
        for m in batch.to_pylist():
            if group and group[0]["core"] != m["core"]:
                rows += settle(group)
                group = []
            group.append(m)
        yield emit(rows)
    yield emit(settle(group) if group else [])


def _halves(members: DataFrame, length: int) -> DataFrame:
    """Each member once or twice: for the nearer and the farther half of its group's distances, with the bytes that
    all those windows share taken into the core."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    near = F.struct(
        F.xxhash64("core", mid, F.lit(0), F.expr(f"substring(after, 1, {reach(length) + 1} - cast(floor((a + b) / 2) as int))")).alias("core"),
        F.col("lo").alias("lo"), F.least(F.col("hi"), mid - 1).alias("hi"), F.col("a").alias("a"), mid.alias("b"),
    )
    far = F.struct(
        F.xxhash64("core", mid, F.lit(1), F.expr("right(hex(before), 2 * cast(floor((a + b) / 2) as int))")).alias("core"),
        F.greatest(F.col("lo"), mid).alias("lo"), F.col("hi").alias("hi"), mid.alias("a"), F.col("b").alias("b"),
    )
    part = members.select("n", "k", "at", "before", "after", F.explode(F.array(near, far)).alias("h")).filter("h.lo <= h.hi")
    return part.select("h.core", "n", "k", "at", "h.lo", "h.hi", "before", "after", "h.a", "h.b")


def repeated_stretches(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, begin, end): bytes of the text with key k that are covered by strings of `length` bytes that also start
    elsewhere. rows: k, data (binary)."""
    everything = stored(rows.select("k", "data").mapInArrow(partial(_anchor_rows, length=length), _ROW))
    # Most cores occur once; only the others, and the few that the filter can't tell, go on.
    shared = stored(everything.groupBy("core").count().filter("count >= 2").select("core"))
    blocks = filter_blocks(shared.count())
    bitmaps = filter_table(shared.select(F.explode(filter_cells(F.col("core"), blocks)).alias("cell")).distinct())
    occurrences = stored(with_hit(everything, "core", bitmaps, blocks, "_hit").filter("_hit").drop("_hit"))
    discard(everything)
    one = occurrences.groupBy("core", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("k", "at", "lo", "hi")).alias("first"))
    one = stored(one)
    cores = one.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("stretches"), F.min("n").alias("least"))
    mixed = one.join(cores.filter("stretches >= 2 AND least = 1").select("core"), "core")
    whole = occurrences.join(one.filter("n >= 2").select("core", "stretch"), ["core", "stretch"])
    out = [whole.select("k", (F.col("at") - F.col("hi")).alias("begin"), (F.col("at") - F.col("lo") + length).alias("end"))]

    asked = stored(mixed.select("core", "n", "first.*"))
    wanted = asked.groupBy("k").agg(F.collect_list(F.struct("core", "n", "k", "at", "lo", "hi")).alias("members"))
    texts = among(rows, wanted.select("k")).join(wanted, "k").select("data", "members")
    members = texts.mapInArrow(partial(_around, length=length), _MEMBER)
    work = stored(members.withColumns({"a": F.lit(0), "b": F.lit(reach(length) + 1)}))
    while True:
        sizes = work.groupBy("core").agg(F.count("*").alias("size"))
        large = sizes.filter(F.col("size") > GROUP).select("core")
        small = work.join(sizes.filter(f"size BETWEEN 2 AND {GROUP}").select("core"), "core")
        sorted_ = small.repartition("core").sortWithinPartitions("core").select("core", "n", "k", "at", "lo", "hi", "before", "after")
        out.append(stored(sorted_.mapInArrow(partial(_resolved, length=length), "k bigint, begin int, end int")))
        more = stored(_halves(work.join(large, "core"), length))
        if more.isEmpty():
            break
        # A core that is a whole window is settled by its count.
        single = more.filter("b - a = 1")
        again = single.join(single.groupBy("core").count().filter("count >= 2").select("core"), "core").filter("n = 1")
        out.append(again.select("k", (F.col("at") - F.col("a")).alias("begin"), (F.col("at") - F.col("a") + length).alias("end")))
        work = more.filter("b - a > 1")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def among(rows: DataFrame, keys: DataFrame, keep: bool = False) -> DataFrame:
    """Rows of which the key k may be in keys; the others don't reach the join's shuffle. With keep: all rows, and the
    boolean _hit."""
    n = keys.count()
    blocks = filter_blocks(n)
    bitmaps = filter_table(keys.select(F.explode(filter_cells(F.xxhash64("k"), blocks)).alias("cell")).distinct())
    probed = with_hit(rows.withColumn("_f", F.xxhash64("k")), "_f", bitmaps, blocks, "_hit").drop("_f")
    return probed if keep else probed.filter("_hit").drop("_hit")


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, stretches: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in stretches:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _by_text(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("k").agg(F.collect_set(F.struct("begin", "end")).alias(name))


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(k, data, spans) -> the merged spans of at least so many bytes: (k, base, data)."""
    for batch in batches:
        rows = []
        for k, data, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows += [(k, a, data[a:b]) for a, b in merged([(s["begin"], s["end"]) for s in spans]) if b - a >= least]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["k", "base", "data"])


def _within(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """repeated_stretches() of rows, given the spans of a smaller length: what repeats lies inside of them."""
    hit = among(rows, spans.select("k")).join(spans, "k").select("k", "data", "spans")
    pieces = stored(hit.mapInArrow(partial(_pieces, least=length), "k bigint, base int, data binary").withColumn("piece", F.xxhash64("k", "base")))
    found = repeated_stretches(pieces.select(F.col("piece").alias("k"), "data"), length).withColumnRenamed("k", "piece")
    placed = found.join(pieces.select("piece", "k", "base").distinct(), "piece")
    return placed.select("k", (F.col("begin") + F.col("base")).alias("begin"), (F.col("end") + F.col("base")).alias("end"))


def _spans(df: DataFrame, id_col: str, text_col: str, keep: list[str], length: int, shorter: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without repeats, rows with them and the array `spans`); columns k, id, text, _c0.. for keep. With shorter:
    also an array `shared` of the spans at that length, and rows that have only those are among the second."""
    if min(length, shorter or length) < 4 * GRAM or (shorter or length) > length:
        raise ValueError(f"lengths must be {4 * GRAM} at least, and shorter no more than length")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    data = rows.select("k", F.col("text").cast("binary").alias("data"))
    spans = stored(_by_text(repeated_stretches(data, shorter or length), "spans"))
    if shorter:
        longer = _by_text(_within(data, spans, length), "spans")
        spans = stored(spans.withColumnRenamed("spans", "shared").join(longer, "k", "left"))
    probed = among(rows, spans.select("k"), keep=True)
    hit = probed.filter("_hit").drop("_hit").join(spans, "k", "left")
    return probed.filter("NOT _hit").drop("_hit"), hit


def suffix_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """Per row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256; with shorter also n_shared, the bytes covered by
    strings of that length that also start anywhere else.

    A text is its UTF-8 bytes, null is empty. Removed is every byte covered by a string of `length` bytes that also
    starts anywhere else, in the same text too; strings are judged on the input and don't cross texts. No copy of a
    repeat stays, as there is no first one. Rows that repeat an id and its text, and rows with a null id and equal
    texts, are copies of each other. Texts may have any length; an empty table gives an empty result, other columns
    are ignored, whatever their names.
    """
    clean, hit = _spans(df, id_col, text_col, [], length, shorter)

    def size(gone: list[tuple[int, int]]) -> int:
        return sum(b - a for a, b in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, shared in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                data, gone, wide = text.encode(), *[merged([(s["begin"], s["end"]) for s in x or []]) for x in (spans, shared)]
                rows.append((len(data), size(gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest(), size(wide)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    kind = clean.schema["id"].dataType.simpleString()
    asked = hit.select("id", "text", "spans", "shared" if shorter else F.col("spans").alias("shared"))
    some = asked.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint")
    zero = F.lit(0).cast("bigint")
    none = clean.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), zero.alias("n_shared"))
    out = none.unionByName(some).withColumnRenamed("id", id_col)
    return out if shorter else out.drop("n_shared")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of df, their texts without repeated strings; see suffix_digests(). Every copy of a repeat goes, the
    first one too. A character of which some bytes are removed goes whole. Null texts stay null."""
    keep = [c for c in df.columns if c != text_col]
    clean, hit = _spans(df, id_col, text_col, [*keep, text_col], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = merged([(s["begin"], s["end"]) for s in spans or []])
                texts.append(text if text is None else without(text.encode(), gone).decode("utf-8", "ignore"))
            names = [f"_c{i}" for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "_text"])

    last = f"_c{len(keep)}"
    kinds = ", ".join(f"_c{i} {clean.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    inside = [F.col(f"_c{i}") for i in range(len(keep))]
    some = hit.select(*inside, F.col(last).alias("_text"), "spans").mapInArrow(run, f"{kinds}, _text string" if kinds else "_text string")
    both = clean.select(*inside, F.col(last).alias("_text")).unionByName(some)
    at = {c: f"_c{i}" for i, c in enumerate(keep)} | {text_col: "_text"}
    return both.select(*[F.col(at[c]).alias(c) for c in df.columns])
