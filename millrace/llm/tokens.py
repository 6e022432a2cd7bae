"""Words of whole Arrow text columns as 64-bit hashes, in numpy.

A word is a run of ASCII letters or digits and of characters from U+00C0 on, without the general
punctuation U+2000-207F and the CJK punctuation U+3000-303F. A-Z and the Latin-1 capitals are folded to
small letters byte by byte, so byte offsets stay those of the text. Null counts as the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
CHUNK = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD[0x80:] = True

#: The same definition for tests and for verification by characters.
WORD = re.compile("[0-9a-zÀ-῿₀-⿿぀-\U0010ffff]+")
FOLD = {i: i + 32 for i in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}


def words_of(text: str | None) -> list[str]:
    """The words of one text, by characters: the definition that the vectorised form must agree with."""
    return WORD.findall((text or "").translate(FOLD))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


_POW = _powers(_P, CHUNK + 1)
_INV = _powers(_PINV, CHUNK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Words:
    """The words of documents row .. row + len(ptr) - 2 of a column; start and end are bytes in data."""

    row: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    docs: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def owner(self) -> np.ndarray:
        """For each word, its document, counted from row."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())


def _words(data: np.ndarray, docs: np.ndarray, row: int) -> Words:
    """data: bytes of consecutive documents; docs: their offsets, the end included."""
    global _POW, _INV
    n = len(data)
    if n + 1 > len(_POW):
        _POW, _INV = _powers(_P, 2 * n), _powers(_PINV, 2 * n)
    low = _FOLD[data]
    word = _WORD[low]
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        lead = data[wide]
        nxt = data[np.minimum(wide + 1, n - 1)]
        up = wide[(lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        low[up] += 32
        two = wide[lead == 0xC2]
        three = wide[((lead == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((lead == 0xE3) & (nxt == 0x80))]
        for at in (two, two + 1, three, three + 1, three + 2):
            word[at[at < n]] = False
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    w = np.zeros(n + 2, bool)
    w[1:-1] = word
    start = np.flatnonzero(w[1:] & (~w[:-1] | edge))
    end = np.flatnonzero(w[:-1] & (~w[1:] | edge))
    total = np.zeros(n + 1, U)
    value = low.astype(U)
    value += U(1)
    value *= _POW[:n]
    np.cumsum(value, out=total[1:])
    h = mix((total[end] - total[start]) * _INV[start])
    return Words(row, h, start, end, np.searchsorted(start, docs), data, docs)


def tokenize(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of all texts of a column, some whole documents at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1
        j = min(max(j, i + 1), n, i + 60000)
        yield _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each n-gram that lies in one document, in order."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = words.hash[:count].copy()
    for k in range(1, n):
        g *= U(_P)
        g += words.hash[k : k + count]
    last = words.ptr[1:].repeat(words.counts())[:count]
    at = np.flatnonzero(np.arange(count) + n <= last)
    return mix(g[at]), at


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of 48-bit n-gram hashes of each document, in one array, and the offsets.

    A text of fewer than n words, but not of none, has one gram: all its words.
    """
    g, at = grams(words, n)
    docs = len(words.ptr) - 1
    owner = np.searchsorted(words.ptr, at, side="right") - 1
    short = np.flatnonzero((words.counts() < n) & (words.counts() > 0))
    if len(short):
        extra = np.array([int(mix(np.bitwise_xor.reduce(mix(words.hash[words.ptr[d] : words.ptr[d + 1]] + np.arange(words.counts()[d], dtype=U)), keepdims=True))[0]) for d in short], U)
        g, owner = np.concatenate([g, extra]), np.concatenate([owner, short])
    key = (owner.astype(U) << U(48)) | (g >> U(16))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    ptr = np.searchsorted(key, np.arange(docs + 1, dtype=U) << U(48))
    return key & U((1 << 48) - 1), ptr
