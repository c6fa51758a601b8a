"""Gray-order hierarchical index over 64-bit codes, and the joins it answers (numpy, inside tasks).

Codes are sorted by Gray rank, so neighbours differ in few bits. Every ``fan`` neighbours form a
node that keeps the bits on which all of them agree (a mask and a pattern); nodes form nodes in the
same way up to one root. A search walks pairs of nodes downwards. Each step compares only the shared bits
that the level above had not fixed yet and adds the differences to those found so far; once they
exceed the bound, the whole group of pairs below is dropped.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Index of ``codes``; a pair is only looked for inside one ``bucket``."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray, fan: int = 4):
        self.order = np.lexsort((gray_rank(codes), buckets))
        self.codes = codes[self.order].astype(np.uint64)
        bucket = buckets[self.order]
        self.ones, self.mask, self.first, self.count = [self.codes], [np.full(len(codes), ALL)], [None], [None]
        zeros = ~self.codes
        while len(bucket):
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            if new.all():
                break
            at = np.arange(len(bucket))
            begin = np.maximum.accumulate(np.where(new, at, 0))
            first = np.flatnonzero((at - begin) % fan == 0)
            ones = np.bitwise_and.reduceat(self.ones[-1], first)
            zeros = np.bitwise_and.reduceat(zeros, first)
            self.ones.append(ones)
            self.mask.append(ones | zeros)
            self.first.append(first)
            self.count.append(np.diff(np.r_[first, len(bucket)]))
            bucket = bucket[first]
        self.labels = np.arange(len(codes))

    def _spread(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lowest and highest component label below each node."""
        low = high = self.labels
        out = [(low, high)]
        for first in self.first[1:]:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append((low, high))
        return out

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            la, lb = labels[a], labels[b]
            if (la == lb).all():
                return
            low = np.minimum(la, lb)
            np.minimum.at(labels, la, low)
            np.minimum.at(labels, lb, low)
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray, far: np.ndarray, bound: int):
        """Pairs of children whose accumulated differences stay within ``bound``."""
        na, nb = self.count[level][a], self.count[level][b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = i // nb[pair], i % nb[pair]
        ca, cb = self.first[level][a][pair] + i, self.first[level][b][pair] + j
        ok = ca < cb if level == 1 else ca <= cb
        ok |= a[pair] != b[pair]
        pair, ca, cb = pair[ok], ca[ok], cb[ok]
        known = (self.mask[level][a] & self.mask[level][b])[pair]
        shared = self.mask[level - 1][ca] & self.mask[level - 1][cb] & ~known
        more = np.bitwise_count((self.ones[level - 1][ca] ^ self.ones[level - 1][cb]) & shared)
        far = far[pair] + more
        near = far <= bound
        return ca[near], cb[near], far[near]

    def link(self, bound: int, block: int = 20_000, seen: Counter | None = None) -> np.ndarray:
        """For each code the smallest code of its component, codes within ``bound`` bits being linked.

        Pairs are worked off depth first in blocks, so memory stays bounded; pairs of groups that
        are already one component are skipped, so a dense group is not compared pair by pair. ``seen``
        counts the pairs of nodes looked into, by level; level 0 are the pairs of codes that are linked.
        """
        top = len(self.first) - 1
        roots = np.arange(len(self.ones[top]))
        todo = [(top, roots, roots, np.zeros(len(roots), np.int64))] if top else []
        spread, stale = self._spread(), 0
        while todo:
            level, a, b, far = todo.pop()
            if stale > 20_000:
                spread, stale = self._spread(), 0
            low, high = spread[level]
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, far = a[open_], b[open_], far[open_]
            if not len(a):
                continue
            if seen is not None:
                seen[level] += len(a)
            a, b, far = self._children(level, a, b, far, bound)
            if seen is not None and level == 1:
                seen[0] += len(a)
            if level == 1:
                self._unite(a, b)
                stale += len(a)
            else:
                todo += [(level - 1, a[k : k + block], b[k : k + block], far[k : k + block]) for k in range(0, len(a), block)]
        # The label is a position; the representative is the smallest code of the component.
        least = self.codes.copy()
        np.minimum.at(least, self.labels, self.codes)
        out = np.empty(len(least), np.uint64)
        out[self.order] = least[self.labels]
        return out
