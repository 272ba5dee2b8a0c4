"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text into chunks, so that a passage shared by documents gives the same chunks
wherever it stands. A chunk's inside is encoded once per Python worker and then reused. What lies around a join
between chunks is encoded again, from the last place in the left chunk to the first in the right one where both sides
agree whatever stands beyond: white space after a character that is none always begins a new piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import ByteBpe, Generations, byte_bpe, vocabulary

#: A cut where so many low bits of the rolling hash are zero: chunks of 512 bytes on average.
CUT_MASK = np.uint32(511)
#: Chunks, and texts around joins, kept by a worker in each of two generations, and the sums of their lengths; ids and
#: decoded bytes take up to ten times as much. A longer text around a join, without white space, isn't kept.
CACHE_CHUNKS = 20_000
CHUNK_BYTES, JOIN_CHARS, LONGEST_JOIN = 12 << 20, 2 << 20, 4096
_TABLE = np.random.default_rng(20).integers(1, 1 << 32, 256, dtype=np.uint32)
_MULTIPLIER = 0x9E3779B1
_AGREED = re.compile(r"(?<=\S)(?=\s)")


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks begin, after the first one; never inside a character."""
    h = _TABLE[data]
    for step in (1, 2, 4, 8):
        factor = np.uint32(pow(_MULTIPLIER, step, 1 << 32))
        h[step:] = h[step:] + factor * h[:-step]
    at = np.flatnonzero((h[15:-1] & CUT_MASK) == 0) + 16
    return at[(data[at] & 0xC0) != 0x80]


class ChunkCodec:
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.chunks = Generations(self._chunk, CACHE_CHUNKS, most=CHUNK_BYTES)
        self.joins = Generations(self._part, CACHE_CHUNKS, LONGEST_JOIN, JOIN_CHARS)

    def _part(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as digits, and their decoded bytes."""
        ids = self.bpe.ids(text)
        return len(ids), ",".join(map(self.bpe.digits_of.__getitem__, ids)), self.bpe.decode(ids)

    def _chunk(self, data: bytes) -> tuple[str, tuple[int, str, bytes] | None, str]:
        """Head, encoded inside, tail; without two agreed places all of it is head."""
        text = data.decode()
        first = _AGREED.search(text)
        if not first:
            return text, None, ""
        last = len(text) - 1
        while last > first.start() and not (text[last].isspace() and not text[last - 1].isspace()):
            last -= 1
        if last <= first.start():
            return text, None, ""
        return text[: first.start()], self._part(text[first.start() : last]), text[last:]

    def parts(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        data = text.encode()
        array = np.frombuffer(data, np.uint8)
        edges = [0, *(cuts(array).tolist() if len(data) > 32 else ()), len(data)]
        pending = ""
        for a, b in zip(edges, edges[1:], strict=False):
            head, inside, tail = self.chunks[data[a:b]]
            pending += head
            if inside:
                yield self.joins[pending]
                yield inside
                pending = tail
        yield self.joins[pending]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        parts = [p for p in self.parts(text) if p[0]]
        joined = ",".join([p[1] for p in parts]).encode()
        decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()
        return sum(p[0] for p in parts), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, digits, _ in self.parts(text) if digits for i in digits.split(",")]


_CODECS: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(byte_bpe(path))
    return _CODECS[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of df: id_col and ids, an array of the text's token ids. See digests() for the defined cases."""
    path = path or vocabulary("byte_bpe_50k.json")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # ids are larger than texts, so few rows at a time
                part = batch.slice(i, 256)
                ids = [codec(path).encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Per row of df: id_col and text, of an array of token ids (null: empty). Bytes that are no UTF-8 become U+FFFD."""
    path = path or vocabulary("byte_bpe_50k.json")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of df: id_col, n_tokens, ids_sha256, decoded_sha256 of the text encoded and decoded again.

    A null text is empty: no ids, and digests of the empty string. Special tokens' strings in a text are special
    tokens, as the tokenizers package has it by default. Repeated rows give repeated results, an empty table gives an empty
    result, other columns are ignored.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, text = zip(*[codec(path).digest(t) for t in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
