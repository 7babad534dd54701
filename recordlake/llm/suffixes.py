"""Suffix arrays of integer sequences by prefix doubling, with common prefixes, in numpy.

Only suffixes that still share their prefix with another are sorted again, so text
with few repeats costs little more than one sort.
"""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """``order``: suffixes in lexicographic order of the symbols' numbers; ``lcp[k]``: common prefix of order[k-1] and order[k]."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable").astype(np.int64)
        sorted_ = symbols[self.order]
        head = np.ones(n, bool)
        head[1:] = sorted_[1:] != sorted_[:-1]
        place = np.arange(n)
        # Places past the end have numbers of their own below all others.
        rank = np.full(n + 1, -1, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(head, place, 0)) if n else 0
        self.levels = [rank.copy()]
        span = 1
        while True:
            alone = head & np.append(head[1:], True)
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            suffix = self.order[open_]
            key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + span, n)] + 1
            by = np.argsort(key, kind="stable")
            key, suffix = key[by], suffix[by]
            self.order[open_] = suffix
            first = np.ones(len(open_), bool)
            first[1:] = key[1:] != key[:-1]
            head[open_] = first
            rank[suffix] = np.maximum.accumulate(np.where(first, open_, 0))
            self.levels.append(rank.copy())
            span *= 2
        self.lcp = self._common_prefixes(n)

    def _common_prefixes(self, n: int) -> np.ndarray:
        """From the ranks by the first 1, 2, 4, ... symbols: the longest power that agrees, then the next shorter."""
        lcp = np.zeros(n, np.int64)
        if n < 2:
            return lcp
        a, b = self.order[:-1], self.order[1:]
        alike = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[alike], b[alike]
        common = np.zeros(len(alike), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            same = rank[np.minimum(a + common, n)] == rank[np.minimum(b + common, n)]
            common[same] += 1 << level
        lcp[alike + 1] = common
        return lcp

    def longest_repeats(self) -> np.ndarray:
        """For each position, the longest substring from there that stands elsewhere too.

        This is the depth of the innermost common-prefix interval around the suffix.
        """
        n = len(self.order)
        out = np.zeros(n, np.int64)
        after = np.append(self.lcp[1:], 0) if n else self.lcp
        out[self.order] = np.maximum(self.lcp, after)
        return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeated substring of at least ``least`` symbols.

    The union over all positions' longest repeats is the union over the maximal
    repeated substrings, as each of those is the longest at its first position.
    """
    n = len(repeats)
    at = np.arange(n)
    reach = np.maximum.accumulate(np.where(repeats >= least, at + repeats, 0)) if n else at
    return reach > at
