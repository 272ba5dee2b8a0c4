"""Exact encoders for the public vocabularies, with bounded caches that Python workers keep between tasks.

Both give the ids of the tokenizers package. They run the merges through tiktoken, which is several times faster on
short pieces; tests hold them against the package.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
import tiktoken

#: Entries of the word cache, in each of its two generations, and the most code points of a word in it.
CACHE_WORDS, CACHE_LENGTH = 500_000, 64
#: Pairs of tokens of which it is known whether they stand side by side.
CACHE_PAIRS = 1_000_000
#: White space to the package's pattern: Python's, without U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Generations(dict):
    """A cache of at most two generations of `limit` keys, whose lengths sum to `most`: what is asked for again moves to
    the young one. Keys of more than `longest` are made anew each time, so that its bytes have a bound too."""

    def __init__(self, make, limit: int, longest: int = 1 << 62, most: int = 1 << 62):
        super().__init__()
        self.old: dict = {}
        self.make, self.limit, self.longest, self.most, self.held = make, limit, longest, most, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > self.longest:
            return value
        self.held += len(key)
        if len(self) >= self.limit or self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = len(key)
        self[key] = value
        return value


#: Stands for the end of a piece; no UTF-8 text has this byte.
_END = b"\xff"
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters of combining class 0 that may still merge with what stands before them: second parts of canonical
    decompositions, and the vowels and finals of Hangul."""
    out = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


class WordBpe:
    """word_bpe_49k.json: lower case, white space dropped, words end in a marker.

    Words between white space are independent of each other, so each is encoded once. The end marker is a byte of its
    own that merges with the byte before it first of all.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars, vocab = _byte_chars(), model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}

        def raw(token: str) -> bytes:
            return bytes(chars[c] for c in token.removesuffix("</w>")) + _END * token.endswith("</w>")

        ranks = {bytes([b]): 10_000_000 + b for b in range(256)} | {bytes([b]) + _END: b for b in range(255)}
        for i, pair in enumerate(model["model"]["merges"]):
            ranks.setdefault(b"".join(raw(t) for t in (pair if isinstance(pair, list) else pair.split(" "))), 256 + i)
        ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self._id = {rank: ids[token] for token, rank in ranks.items() if token in ids}
        self._piece = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.cache = Generations(self._encode, CACHE_WORDS, CACHE_LENGTH)
        self.prefixes = Generations(self.prefix_counts, CACHE_WORDS // 10, CACHE_LENGTH)
        self._ranks, self._tree = ranks, None

    def words(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def ids(self, word: str) -> list[int]:
        """Ids of one word, not cached."""
        out: list[int] = []
        for part in self._split.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = part.lower() if part.isascii() else _lower(unicodedata.normalize("NFC", part))
            for piece in self._words.findall(part):
                out += [self._id[r] for r in self._piece(piece.encode() + _END)]
        return out

    def _encode(self, word: str) -> bytes:
        return np.array(self.ids(word), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.cache.__getitem__, self.words(text)))

    def _prepare(self) -> dict:
        """Tokens as a tree of their bytes; at -1 a token's rank, at -2 that of the token with the end marker."""
        self._tree, self._bytes, self._pairs = {}, {r: t for t, r in self._ranks.items()}, {}
        self._longest = max(map(len, self._ranks))
        for token, rank in self._ranks.items():
            if token == _END:
                continue
            node = self._tree
            for b in token.removesuffix(_END):
                node = node.setdefault(b, {})
            node[-2 if token.endswith(_END) else -1] = rank
        return self._tree

    def _beside(self, last: int, rank: int) -> bool:
        """Whether the merges leave the two tokens side by side (last -1: whether they make this token)."""
        out = self._pairs.get((last, rank))
        if out is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            before = self._bytes[last] if last >= 0 else b""
            out = self._pairs[last, rank] = self._piece(before + self._bytes[rank]) == [last, rank][last < 0 :]
        return out

    def piece_counts(self, data: bytes, limit: int) -> list[int]:
        """Tokens of each prefix of a piece's bytes as a piece of its own; the list may end early, where all counts
        that are left are over the limit.

        One forward pass: a prefix has one last token that the last token before it leaves alone, so its count is
        that of the shorter prefix and one. A count depends on those of the longest token's bytes before it only; once
        all of these are over the limit, so is the rest."""
        tree, n = self._tree or self._prepare(), len(data)
        last, count, out = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        over = 0
        for at in range(n):
            before, more = last[at], count[at] + 1
            over = over + 1 if more > limit + 1 else 0
            if over > self._longest:
                return out[: at + 1]
            node, end = tree, at
            while end < n:
                node = node.get(data[end])
                if node is None:
                    break
                end += 1
                rank = node.get(-1)
                if rank is not None and not count[end] and self._beside(before, rank):
                    last[end], count[end] = rank, more
                rank = node.get(-2)
                if rank is not None and not out[end] and self._beside(before, rank):
                    out[end] = more
        return out

    def _part_counts(self, part: str, limit: int) -> Iterator[tuple[int, int]]:
        """(code points, tokens) of the prefixes of a part without special tokens, while they may be within limit."""
        n = lambda piece: len(self._piece(piece.encode() + _END))
        if part.isascii():
            text, ends = part.lower(), range(1, len(part) + 1)
            places = ends
        elif unicodedata.is_normalized("NFC", part):
            text, ends = _lower(part), range(1, len(part) + 1)
            places = ends if len(text) == len(part) else list(accumulate(len(_lower(c)) for c in part))
        else:  # only between characters, not inside a sequence that is normalised together
            starts = [i for i, c in enumerate(part) if not unicodedata.combining(c) and c not in _joining()]
            edges = sorted({0, *starts, len(part)})
            clusters = [_lower(unicodedata.normalize("NFC", part[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
            text, ends, places = "".join(clusters), edges[1:], list(accumulate(map(len, clusters)))
        counts, done = [0] * (len(text) + 1), 0
        total = 0
        for m in self._words.finditer(text):
            a, b = m.span()
            counts[done + 1 : a + 1] = [total] * (a - done)
            piece = m[0]
            if piece in _CONTRACTIONS:
                counts[a + 1] = total + n("'")
                if b - a == 3:
                    counts[a + 2] = counts[a + 1] + n(piece[1])
                counts[b], done = total + n(piece), b
            else:
                data = piece.encode()
                found, at = self.piece_counts(data, limit - total), 0
                for i, c in enumerate(piece, a + 1):
                    at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                    if at >= len(found):
                        break
                    counts[i], done = total + found[at], i
            if done < b or counts[b] > limit:
                break
            total = counts[b]
        else:
            counts[done + 1 :] = [total] * (len(text) - done)
            done = len(text)
        for end, place in zip(ends, places, strict=True):
            if place > done:
                break
            yield end, counts[place]

    def prefix_counts(self, word: str, limit: int = 1 << 62) -> tuple[list[int], list[int]]:
        """Where a word may be parted (code points), and the tokens up to there. Characters that normalise together
        aren't parted. The lists end early where the rest is over the limit."""
        ends, counts, begin, total = [], [], 0, 0
        parts = self._split.split(word) if "<|" in word else [word]
        for i in range(0, len(parts), 2):
            special = parts[i + 1] if i + 1 < len(parts) else ""
            length = len(parts[i]) + len(special)
            for end, n in self._part_counts(parts[i] + special, limit - total):  # a begun special token is text
                if end < length or not special:
                    ends.append(begin + end)
                    counts.append(total + n)
            if special:
                begin, total = begin + length, total + len(self.ids(parts[i])) + 1
                ends.append(begin)
                counts.append(total)
            if total > limit:
                break
        return ends, counts


class ByteBpe:
    """byte_bpe_50k.json, by way of the same vocabulary as ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ids = {bytes(chars[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        order = {b"".join(bytes(chars[c] for c in t) for t in (p if isinstance(p, list) else p.split(" "))): 256 + i for i, p in enumerate(model["model"]["merges"])}
        same = all(ids[t] == r for t, r in order.items())
        if not same:
            raise ValueError("the ids must be the order of the merges")
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._encoding = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ids, special_tokens=self.special)
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]

    def ids(self, text: str) -> list[int]:
        if "<|" in text:
            return self._encoding.encode(text, allowed_special="all", disallowed_special=())
        return self._encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
