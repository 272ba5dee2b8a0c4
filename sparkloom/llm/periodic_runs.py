"""Periodic run detection by Lyndon roots.

By the runs theorem every run has a root that is the longest Lyndon word at its start, under one order of the words or
under the reverse of it. The first phase of Baier's suffix sorter, which groups suffixes and lengthens the words that
the groups stand for, ends with exactly these longest Lyndon words; it is run under both orders. Each root is then
extended to both sides by longest common extensions, and what is long enough is a run.

Before that, words that can't stand in a long run are left out: within a run of length >= 3 * period, all words but
the last period have their next occurrence at most a period ahead, so a run lies in a stretch of at least two periods
of such words. That only excludes; every run comes from a root.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

#: Words handled at once; a longer text is handled alone.
GROUP_WORDS = 200_000
#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGESTS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

Run = tuple[int, int, int]  #: start, length, period


def lyndon_array(w: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of w (numbers from 0), by Baier's first phase.

    Groups of places are taken in descending order. A group's word u is final when its turn comes; the nearest place to
    the left of each member that is in a lower group has its own word lengthened by u, as many times as members point
    to it, and goes to a new group right above its old one."""
    n = len(w)
    size = [1] * (max(w, default=0) + 1)  # length of each group's word
    members: list[list[int]] = [[] for _ in size]
    for i, x in enumerate(w):
        members[x].append(i)
    below = list(range(-1, len(size) - 1))
    above = list(range(1, len(size) + 1))
    above[-1] = -1
    group = list(w)
    left = list(range(n))  # left[i] == i: not handled yet; else a place at most as far right as the nearest such one
    out = [1] * n
    g = len(size) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        length = size[g]
        for i in own:
            out[i] = length
            left[i] = i - 1
        pointing: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and left[j] != j:
                left[j] = k = left[left[j]] if left[j] >= 0 else -1
                j = k
            if j >= 0:
                pointing[j] = pointing.get(j, 0) + 1
        if pointing:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in pointing.items():
                moved.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new, high = len(size), above[old]
                size.append(size[old] + times * length)
                places = moved[times, old]
                members.append(places)
                below.append(old)
                above.append(high)
                above[old] = new
                below[high] = new
                for j in places:
                    group[j] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions in an array of numbers, from names of all its blocks of 1, 2, 4, ... numbers."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        self.names = [w.astype(np.int32)]
        while 2 << (len(self.names) - 1) <= self.n:
            half = self.names[-1].astype(np.int64)
            step = 1 << (len(self.names) - 1)
            pairs = half[:-step] * self.n + half[step:] if int(half.max()) < self.n else half[:-step] * (int(half.max()) + 1) + half[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal numbers from a and b on, for a < b."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            inside = np.flatnonzero(b + out + (1 << level) <= self.n)
            x, y, names = (a + out)[inside], (b + out)[inside], self.names[level]
            out[inside[names[x] == names[y]]] += 1 << level
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal numbers before a and b, for a < b."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            inside = np.flatnonzero(a - out >= 1 << level)
            x, y, names = (a - out)[inside] - (1 << level), (b - out)[inside] - (1 << level), self.names[level]
            out[inside[names[x] == names[y]]] += 1 << level
        return out


def stretch_runs(w: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs of an array of numbers, from the Lyndon roots under both orders; by start, then period."""
    ids = np.unique(w, return_inverse=True)[1]
    at = np.arange(len(w))
    found: set[Run] = set()
    common = Extensions(ids)
    for order in (ids, ids.max() - ids):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        roots = np.flatnonzero((at + period < len(w)) & (periods * period <= len(w)))
        roots = roots[ids[roots] == ids[roots + period[roots]]]  # else it is no run's first root
        p = period[roots]
        before, after = common.left(roots, roots + p), common.right(roots, roots + p)
        length = before + p + after
        good = length >= np.maximum(least, periods * p)
        found.update(zip((roots - before)[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(ahead: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of stretches that may hold a run: words whose next occurrence is at most half the stretch ahead.
    ahead: distance to the next occurrence in the same text, 0: none; the stretches of a text don't overlap."""
    n = len(ahead)
    alive = ahead > 0
    while True:
        edge = np.ones(n + 1, bool)
        edge[1:n] = (alive[1:] != alive[:-1]) | (text_of[1:] != text_of[:-1])
        cut = np.flatnonzero(edge)
        sizes = np.diff(cut)
        size = np.repeat(sizes, sizes)
        keep = alive & (2 * ahead <= size) & (size >= LEAST_WORDS * (LEAST_PERIODS - 1) // LEAST_PERIODS)
        if (keep == alive).all():
            return [(int(b), int(e)) for b, e in zip(cut[:-1], cut[1:], strict=True) if alive[b]]
        alive = keep


def text_runs(texts: list[list[str]]) -> list[list[Run]]:
    """Runs of each list of words."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    w = np.fromiter((x for words in texts for x in map(number.__getitem__, words)), np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Run]] = [[] for _ in texts]
    if len(w) < LEAST_WORDS:
        return out
    text_of = np.repeat(np.arange(len(texts)), sizes)
    key = text_of * (len(number) + 1) + w
    order = np.argsort(key, kind="stable")
    ahead = np.zeros(len(w), np.int64)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    ahead[order[same]] = order[same + 1] - order[same]
    for begin, end in _stretches(ahead, text_of):
        text = int(text_of[begin])
        last = min(end + (end - begin) // 2, int(begins[text + 1]))  # the last period of a run has no next occurrence
        shift = begin - int(begins[text])
        # Where all but the last period isn't inside of the stretch, it is the begin of a later stretch's run.
        out[text] += [(start + shift, length, period) for start, length, period in stretch_runs(w[begin:last]) if begin + start + length - period <= end]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def tailed(doc_id: object, words: list[str]) -> list[str]:
    """The words, for one in ten ids with a periodic tail in the place of their own."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that stand in a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return words if not runs else [x for x, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def _digests(words: list[str], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest())


def _in_groups(batches: Iterator[pa.RecordBatch], tails: bool) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Ids and words of rows, in groups of about GROUP_WORDS words."""
    for batch in batches:
        texts: list[list[str]] = []
        begin = waiting = 0
        for i, text in enumerate(batch.column(1)):
            words = _WORD.findall(text.as_py() or "")
            texts.append(tailed(batch.column(0)[i].as_py(), words) if tails else words)
            waiting += len(words)
            if waiting >= GROUP_WORDS or i == batch.num_rows - 1:
                yield batch.column(0).slice(begin, len(texts)), texts
                begin, waiting, texts = i + 1, 0, []


def _mapped(df: DataFrame, id_col: str, text_col: str, columns: dict[str, pa.DataType], row, tails: bool = False) -> DataFrame:
    """id_col and columns, a row of them for each of df's; row(words, runs) gives the values."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _in_groups(batches, tails):
            values = zip(*[row(words, runs) for words, runs in zip(texts, text_runs(texts), strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, kind) for kind, v in zip(columns.values(), values, strict=True)]], ["id", *columns])

    schema = StructType([StructField("id", rows.schema["id"].dataType), *[StructField(n, from_arrow_type(k)) for n, k in columns.items()]])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = True) -> DataFrame:
    """Per row of df: id_col, n_runs, start, length, period, exponent_milli of the run with the greatest exponent,
    runs_sha256, collapsed_sha256. tails: one in ten ids (by CRC-32) gets a periodic tail first.

    A null or empty text has no words and no runs; of texts without runs the four numbers are null. A null id gets no
    tail. Words and texts may have any length; a text is one task's, in space of its words times their logarithm. Repeated
    rows give repeated results, an empty table gives an empty result, other columns are ignored."""
    return _mapped(df, id_col, text_col, _DIGESTS, _digests, tails)


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run of every text: id_col, start, length, period (in words). Texts without runs give no row; otherwise as
    run_digests()."""
    runs = _mapped(df, id_col, text_col, {"_runs": pa.list_(pa.list_(pa.int64()))}, lambda words, runs: (runs,))
    return runs.select(id_col, F.explode("_runs").alias("_r")).select(id_col, *[F.get("_r", i).alias(c) for i, c in enumerate(("start", "length", "period"))])


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id_col and collapsed, its words joined by one space without those that only repeat a run's
    period. Otherwise as run_digests()."""
    return _mapped(df, id_col, text_col, {"collapsed": pa.string()}, lambda words, runs: (" ".join(collapsed(words, runs)),))
