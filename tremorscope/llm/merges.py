"""Vectorised byte-pair merging: many words at once, in flat numpy arrays.

Every round finds, for each word, the adjacent pair of the lowest rank (a segmented minimum), merges the
pair's leftmost occurrences in all words at the same time, and compacts the arrays. A word leaves when none
of its pairs can merge. Where a merge could make a pair of an equal or better rank than its own, only its
leftmost occurrence merges in a round, which is what a one-by-one merge in order of (rank, position) does.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int32(2**31 - 1)


class MergeTable:
    """An open-addressed table from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rank, self.merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        best = np.full(max(left.max(initial=0), right.max(initial=0), self.merged.max(initial=0)) + 1, NEVER, np.int32)  # of the pairs that hold a symbol
        np.minimum.at(best, left, self.rank)
        np.minimum.at(best, right, self.rank)
        tied = np.bincount(np.unique(np.stack([self.rank, self.merged], 1), axis=0)[:, 0], minlength=self.rank.max(initial=0) + 1) > 1
        self.safe = (best[self.merged] > self.rank) & ~tied[self.rank]  # by pair
        self.safe_rank = np.ones(self.rank.max(initial=0) + 1, bool)
        self.safe_rank[self.rank[~self.safe]] = False
        self.bits = max(8, int(len(left) * 8 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        key = left << 32 | right
        at, todo = self._home(left, right), np.arange(len(key))
        while len(todo):
            place = at[todo]
            free = self.keys[place] < 0
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            first = first[free[first]]
            self.keys[place[first]], self.slot[place[first]] = key[todo[first]], todo[first]
            keep = np.ones(len(todo), bool)
            keep[first] = False
            todo = todo[keep]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' places in the table, -1 for those that never merge."""
        out = np.full(len(left), -1, np.int32)
        at, todo, key = self._home(left, right), None, left.astype(np.int64) << 32 | right
        there = self.keys[at]
        hit = there == key
        out[hit] = self.slot[at[hit]]
        todo = np.flatnonzero(~hit & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.slot[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge every word to the end; negative symbols never merge.

        Returns the symbols of all words one after another, the words' lengths, and the place in the input
        at which each symbol began.
        """
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        symbol, origin = np.asarray(symbols, np.int32), np.arange(len(word), dtype=np.int32)
        pair = self._pairs(symbol, word)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            rank = np.where(pair >= 0, self.rank[pair], NEVER)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((word[gone], symbol[gone], origin[gone]))
                stay = ~gone
                word, symbol, origin, pair, rank = word[stay], symbol[stay], origin[stay], pair[stay], rank[stay]
                sizes, best = sizes[~over], best[~over]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.cumsum(np.r_[True, np.diff(hits) > 1]) - 1  # consecutive hits overlap: every other one merges
            first = hits[np.flatnonzero(np.r_[True, np.diff(run) > 0])][run]
            keep = (hits - first) % 2 == 0
            cautious = ~self.safe_rank[rank[hits]]
            if cautious.any():
                leftmost = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
                keep &= ~cautious | leftmost
            hits = hits[keep]
            symbol[hits] = self.merged[pair[hits]]
            stay = np.ones(len(word), bool)
            stay[hits + 1] = False
            moved = np.cumsum(stay) - 1
            word, symbol, origin, pair = word[stay], symbol[stay], origin[stay], pair[stay]
            at = moved[hits]
            self._again(symbol, word, pair, at)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64), np.zeros(0, np.int32)
        word, symbol, origin = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(lengths)), origin[order]

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(symbol), -1, np.int32)
        near = np.flatnonzero((word[1:] == word[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0))
        pair[near] = self.find(symbol[near], symbol[near + 1])
        return pair

    def _again(self, symbol: np.ndarray, word: np.ndarray, pair: np.ndarray, at: np.ndarray) -> None:
        """Look up anew the pairs that end or begin at the merged symbols."""
        touched = np.zeros(len(word), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        near = np.flatnonzero(touched)
        pair[near] = -1
        near = near[near + 1 < len(word)]
        near = near[(word[near] == word[near + 1]) & (symbol[near] >= 0) & (symbol[near + 1] >= 0)]
        pair[near] = self.find(symbol[near], symbol[near + 1])
