"""BM25, and inverted indexes with block maxima, as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

K1, B = 1.2, 0.75


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def impacts(tf: np.ndarray, length: np.ndarray, mean_length: float, weight: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in a query adds to an item's score."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))


def expand(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at[k] .. at[k + 1] - 1 for each key, one after another, and their number for each."""
    first = at[keys]
    size = at[keys + 1] - first
    some = np.flatnonzero(size)
    steps = np.ones(int(size.sum()), np.int64)
    if len(some):
        first, own = first[some], size[some]
        steps[np.append(0, np.cumsum(own)[:-1])] = first - np.append(0, first[:-1] + own[:-1] - 1)
    return np.cumsum(steps, out=steps), size


class Blocks:
    """An index for threshold search by block-max WAND, of entries given as word hashes. An entry's score by a query of all its own words is 1.

    terms: sorted word hashes; the words of entry e and their impacts: term and impact[cut[e]:cut[e + 1]]. Entries are cut into blocks; lists
    hold, for each word, the blocks in which it is not before the pivot, and the greatest impact there; rest is what words before the pivot can
    add to a block's entries.
    """

    def __init__(self, docs: list[np.ndarray], block: int, threshold: float, weigh: Callable[[np.ndarray], np.ndarray], mean_length: float, share: float = 0.4) -> None:
        self.n, self.block, self.threshold, self.blocks = len(docs), block, threshold, max(-(-len(docs) // block), 1)
        length = np.array([len(d) for d in docs], np.int64)
        self.terms, code = np.unique(np.concatenate(docs) if docs else np.empty(0, np.uint64), return_inverse=True)
        many = max(len(self.terms), 1)
        pair, tf = np.unique(np.repeat(np.arange(self.n), length) * many + code, return_counts=True)
        item, self.term = pair // many, pair % many
        impact = impacts(tf.astype(float), length[item].astype(float), mean_length, weigh(self.terms)[self.term] if len(pair) else np.empty(0))
        self.impact = impact / np.maximum(np.bincount(item, impact, self.n)[item], 1e-12)
        self.cut = np.searchsorted(item, np.arange(self.n + 1))

        cell = item // block * many + self.term
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else np.empty(0, np.int64)
        greatest = np.maximum.reduceat(self.impact[order], starts) if len(starts) else np.empty(0)
        of, word = cell[order][starts] // many, cell[order][starts] % many
        up = np.lexsort((greatest, of))  # each block's words by what they can add
        of, word, greatest = of[up], word[up], greatest[up]
        total = np.append(0.0, np.cumsum(greatest))
        so_far = total[1:] - total[np.searchsorted(of, of)]
        before = so_far <= share * threshold
        self.rest = np.bincount(of[before], greatest[before], self.blocks)
        opened = np.flatnonzero(~before)
        opened = opened[np.argsort(word[opened], kind="stable")]
        self.list_block, self.list_most = of[opened], greatest[opened]
        self.list_at = np.searchsorted(word[opened], np.arange(many + 1))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms: their positions, and the terms there."""
        where = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.terms):
            return where[:0], where[:0]
        term = np.searchsorted(self.terms, hashes[where])
        term[term == len(self.terms)] = 0
        ok = self.terms[term] == hashes[where]
        return where[ok], term[ok]

    def candidates(self, query: np.ndarray, term: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and blocks in which an entry may reach the threshold. query, term: pairs, distinct."""
        own, size = expand(self.list_at, term)
        bound = np.bincount(np.repeat(query * self.blocks, size) + self.list_block[own], self.list_most[own], queries * self.blocks).reshape(queries, self.blocks)
        return np.nonzero((bound + self.rest >= self.threshold * 0.999) & (bound > 0))

    def scored(self, pairs: np.ndarray, query: np.ndarray, block: np.ndarray, together: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, entries and scores at or over the threshold, in the blocks given. pairs: query * number of terms + term, sorted."""
        found = []
        for at in range(0, len(query), together):
            q, lo = query[at : at + together], block[at : at + together] * self.block
            own, size = expand(np.append(self.cut, self.cut[-1]), np.minimum(lo[:, None] + np.arange(self.block), self.n).ravel())
            cell = np.repeat(np.arange(len(q) * self.block), size)
            key = q[cell // self.block] * len(self.terms) + self.term[own]
            there = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
            score = np.bincount(cell[there], self.impact[own[there]], len(q) * self.block)
            over = np.flatnonzero(score >= self.threshold - 1e-9)
            found.append((q[over // self.block], lo[over // self.block] + over % self.block, score[over]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
