"""Exact token counts of every prefix, by dynamic programming.

Words between white space are encoded independently, so the count of a text's prefix is the count up to its last whole
word, from a running sum over words, plus the count of the begun word's own prefix. Inside a word one forward pass
stores the last token and the count of every prefix (tokens.WordBpe.piece_counts). The tables answer how much of a text
fits a budget without encoding it again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import WordBpe, vocabulary, word_bpe


class PrefixTable:
    """Counts at the ends of a text's words; at(i) gives the count of any prefix."""

    def __init__(self, bpe: WordBpe, text: str):
        self.bpe, self.text = bpe, text
        self.words = bpe.words(text)
        sizes = np.fromiter(map(len, map(bpe.cache.__getitem__, self.words)), dtype=np.int64, count=len(self.words))
        self.counts = np.concatenate([[0], np.cumsum(sizes // 4)])
        self._ends: np.ndarray | None = None
        self._inside: tuple[int, tuple[list[int], list[int]]] = (-1, ([], []))

    def total(self) -> int:
        return int(self.counts[-1])

    def ends(self) -> np.ndarray:
        """Where each word ends, in code points."""
        if self._ends is None:
            out, at = np.empty(len(self.words), np.int64), 0
            for i, word in enumerate(self.words):
                at = self.text.index(word, at) + len(word)
                out[i] = at
            self._ends = out
        return self._ends

    def inside(self, k: int) -> tuple[list[int], list[int]]:
        """prefix_counts() of word k; the last one asked for is kept."""
        if self._inside[0] != k:
            self._inside = (k, self.bpe.prefixes[self.words[k]])
        return self._inside[1]

    def at(self, i: int) -> int:
        """Tokens of the first i code points."""
        ends = self.ends()
        k = int(np.searchsorted(ends, i, side="right"))
        if k == len(self.words):
            return self.total()
        n = i - (int(ends[k]) - len(self.words[k]))
        if n <= 0:
            return int(self.counts[k])
        places, counts = self.inside(k)
        at = bisect_right(places, n) - 1
        if at >= 0 and places[at] == n:
            return int(self.counts[k]) + counts[at]
        return int(self.counts[k]) + len(self.bpe.ids(self.words[k][:n]))  # it parts what is normalised together

    def fitting(self, limit: int) -> int:
        """Code points of the longest prefix of at most limit tokens; it parts no characters that are normalised
        together, as a letter and its marks."""
        if self.total() <= limit:
            return len(self.text)
        k = int(np.searchsorted(self.counts, limit, side="right")) - 1  # so many whole words fit; word k doesn't
        begin = int(self.ends()[k]) - len(self.words[k])
        left = limit - int(self.counts[k])
        places, counts = self.bpe.prefix_counts(self.words[k], left)
        return begin + max((p for p, n in zip(places, counts, strict=True) if n <= left), default=0)


def token_counts(df: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of df: id_col, n_bytes, n_tokens, over_limit, chars_in_limit (code points of the longest prefix that
    has at most limit tokens).

    A null text is empty: no bytes, no tokens. Texts may have any length, with or without white space. Repeated rows
    and null ids give results of their own, an empty table gives an empty result, other columns are ignored.
    """
    path = path or vocabulary("word_bpe_49k.json")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                table = PrefixTable(bpe, text)
                out.append((len(text.encode()), table.total(), table.total() > limit, table.fitting(limit)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_in_limit bigint").withColumnRenamed("id", id_col)
