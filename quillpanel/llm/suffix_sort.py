"""Blockwise suffix sorting with a difference cover, for finding repeated strings of a fixed length.

A block holds the texts of whole buckets. Suffixes are sorted by their first PERIOD bytes; longer
ties are resolved by the ranks of cover-sample suffixes: for any two positions there is a shift
under PERIOD that takes both into the sample. Memory follows the block, never the collection.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np

PERIOD = 64
#: A difference cover modulo 64 (every difference occurs between two of its members).
COVER = (1, 2, 3, 6, 15, 17, 35, 43, 60)


def _shifts() -> np.ndarray:
    """shift[a, b]: the least d with a + d and b + d both in the cover, modulo PERIOD."""
    member = np.zeros(PERIOD, dtype=bool)
    member[list(COVER)] = True
    at = np.arange(PERIOD)
    shift = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        both = member[(at + d) % PERIOD][:, None] & member[(at + d) % PERIOD][None, :]
        shift[both] = d
    return shift


SHIFT = _shifts()


def _words(buffer: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """The bytes from each position as count big-endian words."""
    rows = np.lib.stride_tricks.sliding_window_view(buffer, 8 * count)[at]
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _ranks(bucket: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """For each row how many rows are less, by bucket and then by the keys in turn; buckets are in order.

    A key is looked at only where rows are equal by what came before it.
    """
    n = len(bucket)
    order = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = np.flatnonzero(new)
    rank = np.repeat(first, np.diff(np.append(first, n)))
    for k in keys:
        by = rank[order]
        same = np.zeros(n, dtype=bool)
        same[1:] = by[1:] == by[:-1]
        same[:-1] |= same[1:]
        place = np.flatnonzero(same)
        if not len(place):
            break
        rows, before = order[place], by[place]
        own = k[rows]
        inner = np.lexsort((own, before))
        rows, before, own = rows[inner], before[inner], own[inner]
        order[place] = rows
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        rank[rows] = np.repeat(place[first], np.diff(np.append(first, len(rows))))
    return rank


class Block:
    """Texts laid end to end; origin[i] is the place in text i whose offsets count as 0 modulo PERIOD.

    buckets[i] is the bucket of text i, never falling; suffixes are sorted within each bucket.
    """

    def __init__(self, texts: list[bytes], origins: list[int], buckets: list[int]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.buffer = np.frombuffer(b"".join(texts) + bytes(8 * PERIOD), dtype=np.uint8)
        self.origin = self.start + np.array(origins, dtype=np.int64)
        self.bucket = np.array(buckets, dtype=np.int64)

    def _sample(self, depth: int) -> np.ndarray:
        """At each cover-sample position the rank of its suffix to that depth, else -1."""
        size = int(self.end[-1])
        owner = np.repeat(np.arange(len(self.end)), self.end - self.start)
        every = np.arange(size)
        at = np.flatnonzero(np.isin((every - self.origin[owner]) % PERIOD, COVER))
        left = self.end[owner[at]] - at
        words = _words(self.buffer, at, PERIOD // 8)
        beyond = np.clip(left[:, None] - 8 * np.arange(PERIOD // 8)[None, :], 0, 8)  # bytes of its own text in each word
        words &= np.where(beyond == 0, 0, ~np.uint64(0) << ((8 - beyond) * 8 % 64).astype(np.uint64)).astype(np.uint64)
        rank = np.full(size + 1, -1, dtype=np.int64)
        bucket = self.bucket[owner[at]]
        rank[at] = _ranks(bucket, [*words.T, np.minimum(left, PERIOD)])
        reach = PERIOD
        while reach < depth:
            after = np.where(at + reach < self.end[owner[at]], rank[np.minimum(at + reach, size)], -1)
            rank[at] = _ranks(bucket, [rank[at], after])
            reach *= 2
        return rank

    def sorted_suffixes(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes with at least length bytes left in their text, by bucket and in order of those bytes.

        Also a group number that changes where the bucket or the first PERIOD bytes change, and each one's text.
        """
        counts = np.maximum(self.end - self.start - length + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = self.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        if not len(at):
            return at, at, owner
        group = _ranks(self.bucket[owner], list(_words(self.buffer, at, PERIOD // 8).T))
        rank = self._sample(length)
        residue = (at - self.origin[owner]) % PERIOD
        tie = rank[at + SHIFT[residue, residue]]
        order = np.lexsort((tie, residue, group))
        at, group, residue, owner = at[order], group[order], residue[order], owner[order]
        # A tie between residues is settled by the shift of each pair; within one residue it is settled.
        bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        mixed = np.flatnonzero(residue[bounds[:-1]] != residue[bounds[1:] - 1])
        for b in mixed.tolist():
            s, e = int(bounds[b]), int(bounds[b + 1])

            def before(i, j):
                d = SHIFT[residue[s + i], residue[s + j]]
                return int(rank[at[s + i] + d]) - int(rank[at[s + j] + d])

            own = np.array(sorted(range(e - s), key=cmp_to_key(before)), dtype=np.int64) + s
            at[s:e], residue[s:e], owner[s:e] = at[own], residue[own], owner[own]
        return at, group, owner

    def repeated(self, length: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position, text) of every suffix whose first length bytes start another suffix too.

        copies: how many equal texts each text stands for; a suffix of several is its own neighbour.
        """
        at, group, owner = self.sorted_suffixes(length)
        pair = np.flatnonzero(group[1:] == group[:-1]) if len(at) else np.zeros(0, dtype=np.int64)
        for low in range(PERIOD, length, 8):  # neighbours are compared to the end
            low = min(low, length - 8)
            same = _words(self.buffer, at[pair] + low, 1) == _words(self.buffer, at[pair + 1] + low, 1)
            pair = pair[same[:, 0]]
        hit = np.zeros(len(at), dtype=bool) if copies is None else copies[owner] > 1
        hit[pair] = hit[pair + 1] = True
        return at[hit] - self.start[owner[hit]], owner[hit]
