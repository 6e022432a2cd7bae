"""A quick look for texts that may share a word gram with a known set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What (?U)\s matches in Java, but for a blank and a line end.
_SPACE = "[\\x09\\x0B-\\x0D\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Bytes of text whose words are held at once.
_SLICE = 4 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where those of each text begin, with the end of the last."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _SPACE)
    if pc.any(odd).as_py():
        texts = pc.if_else(odd, pc.replace_substring_regex(texts, _SPACE, " "), texts)
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words, ends = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return words, ends
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


class KnownGrams:
    """Tells which texts may hold one of the grams: no text that does is missed, few others are named.

    Windows of n words that all occur in the grams are looked up by a 64-bit sum over their words; of shorter texts, which
    are one gram, all words are.
    """

    def __init__(self, grams: pa.Array, n: int):
        self.n = n
        words, starts = split_words(grams)
        self.vocabulary = words.unique()
        r = np.random.default_rng(13)
        self.values = r.integers(0, 2**64, len(self.vocabulary), np.uint64, endpoint=False)
        self.factors = r.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        ids, sizes = pc.index_in(words, value_set=self.vocabulary).to_numpy(zero_copy_only=False), np.diff(starts)
        self.sums = np.unique(self._sums(ids, starts[:-1][sizes == n]))
        self.mask = np.uint64((1 << max(16, int(16 * len(self.sums)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.sums & self.mask] = True
        self.short = {tuple(ids[a : a + k]) for a, k in zip(starts[:-1][sizes < n], sizes[sizes < n])}

    def _sums(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(self.n):
            out += self.values[ids[at + j]] * self.factors[j]
        return out

    def _slice(self, texts: pa.Array) -> np.ndarray:
        words, starts = split_words(texts)
        out, sizes, n = np.zeros(len(texts), bool), np.diff(starts), self.n
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        if len(self.sums) and len(ids) >= n:
            inside = np.arange(n, len(ids) + 1) <= np.repeat(starts[1:], sizes)[: len(ids) - n + 1]
            at = np.flatnonzero(inside & (known[n:] - known[:-n] == n))
            sums = self._sums(ids, at)
            hit = self.bits[sums & self.mask]
            at, sums = at[hit], sums[hit]
            at = at[self.sums[np.minimum(np.searchsorted(self.sums, sums), len(self.sums) - 1)] == sums]
            out[np.searchsorted(starts, at, side="right") - 1] = True
        if self.short:
            for k in np.flatnonzero((sizes > 0) & (sizes < n) & (known[starts[1:]] - known[starts[:-1]] == sizes)):
                out[k] = tuple(ids[starts[k] : starts[k + 1]]) in self.short
        return out

    def held(self, texts: pa.Array) -> pa.Array:
        """For each text, with case folded but blanks as they were, whether it may hold one of the grams; null as empty."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // _SLICE)) + 1), len(texts)]
        return pa.array(np.concatenate([self._slice(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a] or [np.zeros(0, bool)]))
