"""Repeated word windows, by recompression.

The words of a text are symbols. The first round names runs of equal symbols; every round then names pairs: a hash of
the symbol puts it on the left or the right side, the same everywhere, and each left symbol followed by a right one
becomes a pair, named by a hash of both. So equal stretches of words give equal symbols wherever they stand, but for a
few at their borders; for each symbol the words are kept that decide it. A window's symbol is the longest one that its
own words decide. Spark counts in how many documents each such symbol stands. Windows whose symbol stands in one
document only are done. The others are verified by the hash of the whole window: they are dealt out by it in packed
arrays, and per hash the smallest document is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored
from sparkloom.llm.suffix_dedup import among

WINDOW = 13
ROUNDS = 4
#: Bytes of text that a worker takes at once.
CHUNK_BYTES = 8 << 20
#: Windows that one task compares at once, about.
BUCKET_ROWS = 2_000_000
#: Bits of the filter of shared symbols, at most (32 MB); a fuller filter only lets more windows be verified.
FILTER_BITS = 1 << 28
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def window_symbols(names: np.ndarray) -> np.ndarray:
    """For each window of WINDOW words, the key of its longest symbol (words in the top byte, then the name)."""
    n = len(names)
    best = np.zeros(max(0, n - WINDOW + 1), _U64)

    def offer(name: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        fits = (low >= 0) & (high <= n) & (high - low <= WINDOW)
        name, size, low, high = name[fits], size[fits], low[fits], high[fits]
        key = (np.minimum(size, 255).astype(_U64) << _U64(56)) | (_mix(name) >> _U64(8))
        for back in range(WINDOW):
            at = low - back
            on = (high - at <= WINDOW) & (at >= 0) & (at < len(best))
            np.maximum.at(best, at[on], key[on])

    place = np.arange(n)
    symbol, size, low, high = names, np.ones(n, np.int64), place, place + 1
    offer(symbol, size, low, high)
    if n:  # runs; that a symbol is in none takes its neighbours
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        count = np.diff(np.append(first, n))
        symbol = np.where(count > 1, _mix(symbol[first] + _mix(count.astype(_U64))), symbol[first])
        size, low, high = count, first - 1, first + count + 1
        offer(symbol[count > 1], size[count > 1], low[count > 1], high[count > 1])
    for r in range(ROUNDS):
        if len(symbol) < 2:
            break
        right = (_mix(symbol + _U64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U64(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:])
        joined = np.zeros(len(symbol), bool)
        joined[pair] = joined[pair + 1] = True
        # Alone, a left symbol needs the next one, a right symbol the one before.
        alone_high = np.where(right, high, np.append(high[1:], n + 1))
        alone_low = np.where(right, np.append(-1, low[:-1]), low)
        new_low, new_high, new_size, new_symbol = np.where(joined, low, np.minimum(low, alone_low)), np.where(joined, high, np.maximum(high, alone_high)), size.copy(), symbol.copy()
        new_symbol[pair] = _mix(symbol[pair] * _U64(3) + _mix(symbol[pair + 1]))
        new_size[pair] += size[pair + 1]
        new_low[pair], new_high[pair] = np.minimum(low[pair], low[pair + 1]), np.maximum(high[pair], high[pair + 1])
        offer(new_symbol[pair], new_size[pair], new_low[pair], new_high[pair])
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, size, low, high = new_symbol[keep], new_size[keep], new_low[keep], new_high[keep]
    return best


class Chunk:
    """Words of some texts in a row, a separate symbol between them."""

    def __init__(self, texts: list[str], first: int):
        split = [t.encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        digest = xxhash.xxh3_64_intdigest
        marks = [digest(b"", first + i + 1) for i in range(len(split))]
        self.names = np.array([x for w, mark in zip(split, marks, strict=True) for x in (*map(digest, w), mark)], _U64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]) if split else np.empty(0, np.int64)
        self.windows = np.maximum(self.sizes - WINDOW + 1, 0)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows within texts: the text's number, the place in it, the place in names."""
        doc = np.repeat(np.arange(len(self.sizes)), self.windows)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        return doc, at, self.begin[doc] + at if len(doc) else at

    def hashes(self) -> np.ndarray:
        n = len(self.names) - WINDOW + 1
        out = np.zeros(max(0, n), _U64)
        mixed = _mix(self.names)
        for j in range(WINDOW):
            out = out * _U64(0x9E3779B97F4A7C15) + mixed[j : j + len(out)]
        return _mix(out)


def _chunks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list, ...]]:
    """Lists of the first columns, the last of them texts, of about CHUNK_BYTES together."""
    held: list[list] = [[] for _ in range(columns)]
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(columns)], strict=True):
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[-1])
            if size >= CHUNK_BYTES:
                yield tuple(held)
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield tuple(held)


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct symbols, 40 bits of them."""
    for (texts,) in _chunks(batches, 1):
        chunk = Chunk(texts, 0)
        doc, _, place = chunk.places()
        key = window_symbols(chunk.names)[place] >> _U64(24) if len(place) else np.empty(0, _U64)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        first = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.empty(0, bool)
        out = key[first].view(np.int64)
        for i in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 100_000])], ["symbol"])


def _filter_places(symbol: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(symbol.astype(_U64))
    return x & _U64(bits - 1), (x >> _U64(32)) & _U64(bits - 1)


def _filter_parts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Shared symbols -> the filter's bytes that are not zero, as (block of 4096 bytes, bytes)."""
    field = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for place in _filter_places(batch.column(0).to_numpy(), bits):
            np.bitwise_or.at(field, (place >> _U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (place & _U64(7)).astype(np.uint8)))
    blocks = field.reshape(-1, min(4096, len(field)))
    some = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(some), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 1000], pa.int32()), pa.array([blocks[b].tobytes() for b in some[i : i + 1000]], pa.binary())], ["block", "bytes"])


def _packed(batches: Iterator[pa.RecordBatch], field, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(k, id, text) -> packed windows (bucket, chunk, then arrays); bucket -1: windows already known to be covered."""
    shared = np.frombuffer(field, np.uint8)
    for keys, ids, texts in _chunks(batches, 3):
        chunk = Chunk(texts, 0)
        doc, at, place = chunk.places()
        if not len(doc):
            continue
        a, b = _filter_places(window_symbols(chunk.names)[place] >> _U64(24), bits)
        on = np.ones(len(doc), bool)
        for bit in (a, b):
            on &= (shared[(bit >> _U64(3)).astype(np.int64)] >> (bit & _U64(7)).astype(np.uint8)) & 1 == 1
        doc, at, h = doc[on], at[on], chunk.hashes()[place[on]]
        ids_, keys_ = np.array(ids, np.int64), np.array(keys, np.int64)
        # Within the chunk only the smallest document of a window can be uncovered, and stands for the others.
        order = np.lexsort((ids_[doc], h))
        doc, at, h = doc[order], at[order], h[order]
        start = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
        least = ids_[doc[np.flatnonzero(start)]][np.cumsum(start) - 1] if len(h) else ids_[:0]
        covered = ids_[doc] > least
        name = xxhash.xxh3_64_intdigest(keys_.tobytes(), len(keys_)) >> 1
        bucket = np.where(covered, -1, ((h >> _U64(40)) % _U64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
        for i, e in enumerate(edges):
            part = order[e : edges[i + 1] if i + 1 < len(edges) else None]
            used, local = np.unique(doc[part], return_inverse=True)
            arrays = (h[part] if bucket[part[0]] >= 0 else h[:0], keys_[used], ids_[used], local.astype(np.uint32), at[part].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([bucket[part[0]]], pa.int64()), pa.array([name], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], _NAMES)


_NAMES = ["bucket", "chunk", "hashes", "keys", "ids", "docs", "places"]
_PACKED = "bucket bigint, chunk bigint, hashes binary, keys binary, ids binary, docs binary, places binary"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed windows sorted by bucket -> the covered ones among them, packed by chunk."""
    for rows in _groups(batches, "bucket"):
        h = [np.frombuffer(r["hashes"], _U64) for r in rows]
        ids = [np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["docs"], np.uint32)] for r in rows]
        part = np.repeat(np.arange(len(rows)), [len(x) for x in h])
        inside = np.concatenate([np.arange(len(x)) for x in h])
        h_, ids_ = np.concatenate(h), np.concatenate(ids)
        order = np.lexsort((ids_, h_))
        h_, ids_ = h_[order], ids_[order]
        start = np.append(True, h_[1:] != h_[:-1])
        covered = order[ids_ > ids_[np.flatnonzero(start)][np.cumsum(start) - 1]]
        part, inside = part[covered], inside[covered]
        for p in np.unique(part):
            r, chosen = rows[p], np.sort(inside[part == p])
            docs = np.frombuffer(r["docs"], np.uint32)[chosen]
            used, local = np.unique(docs, return_inverse=True)
            arrays = (np.frombuffer(r["keys"], np.int64)[used], local.astype(np.uint32), np.frombuffer(r["places"], np.uint32)[chosen])
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], ["chunk", "keys", "docs", "places"])


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows sorted by chunk -> (k, places)."""
    for rows in _groups(batches, "chunk"):
        k = np.concatenate([np.frombuffer(r["keys"], np.int64)[np.frombuffer(r["docs"], np.uint32)] for r in rows])
        at = np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows])
        order = np.lexsort((at, k))
        k, at = k[order], at[order]
        first = np.flatnonzero(np.append(True, np.diff(k) != 0))
        texts = [at[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(k)), strict=True)]
        for i in range(0, len(first), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(k[first[i : i + 1000]]), pa.array(texts[i : i + 1000], pa.binary())], ["k", "places"])


def covered_windows(rows: DataFrame) -> DataFrame:
    """(k, places): of the text with key k, where windows start that start in a document with a smaller id too.
    rows: k, id, text."""
    spark = rows.sparkSession
    symbols = rows.select("text").mapInArrow(_symbol_rows, "symbol bigint").groupBy("symbol").count()
    shared = stored(symbols.filter("count >= 2").select("symbol"))
    n = shared.count()
    bits = max(1 << 15, min(FILTER_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    field = np.zeros(bits // 8, np.uint8)
    for r in shared.coalesce(8).mapInArrow(lambda b: _filter_parts(b, bits), "block int, bytes binary").toLocalIterator():
        part = np.frombuffer(r["bytes"], np.uint8)
        field[r["block"] * len(part) : (r["block"] + 1) * len(part)] |= part
    sent = spark.sparkContext.broadcast(field.tobytes())
    n_words = rows.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, int(n_words) // 6 // BUCKET_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = stored(rows.select("k", "id", "text").mapInArrow(lambda b: _packed(b, sent.value, bits, buckets), _PACKED))
    dealt = packed.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    later = dealt.mapInArrow(_compared, "chunk bigint, keys binary, docs binary, places binary")
    found = later.unionByName(packed.filter("bucket < 0").select("chunk", "keys", "docs", "places"))
    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_by_text, "k bigint, places binary")


def kept_words(text: str, places: list[bytes]) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    for part in places:
        at = np.unique(np.frombuffer(part, np.uint32)).astype(np.int64)
        at = at[at + WINDOW <= len(words)]
        gone[at] += 1
        gone[at + WINDOW] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)


def window_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id_col, n_words, n_removed, kept_sha256.

    Removed is each word covered by a window of WINDOW words of which the words also start, in that order, in a
    document with a smaller id (whole numbers, or strings of them; others are an error; null is larger than all).
    Windows are judged on the input. A null text
    is empty: no words and the digest of nothing. Rows that repeat an id are one document, and don't cover each other.
    An empty table gives an empty result, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(F.col(id_col), text).alias("k"), F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.col(id_col).alias("_id"), text.alias("text"))
    found = stored(covered_windows(rows).groupBy("k").agg(F.collect_list("places").alias("places")))
    hit = among(rows, found.select("k"), keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                stay, n = kept_words(text_, places or [])
                out.append((n, n - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]], ["id", "n_words", "n_removed", "kept_sha256"])

    kind = rows.schema["_id"].dataType.simpleString()
    some = hit.filter("_hit").join(found, "k", "left").select("_id", "text", "places")
    none = hit.filter("NOT _hit").select("_id", "text", F.lit(None).cast("array<binary>").alias("places"))
    both = [part.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string") for part in (none, some)]
    return both[0].unionByName(both[1]).withColumnRenamed("id", id_col)
