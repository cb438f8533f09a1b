"""A run-length index over short strings: Burrows-Wheeler runs with sampled run ends.

Strings of several groups are indexed together; suffixes sort by group first, so a match
is always between strings of one group. The transform is kept as its runs: for each run
the text position of its first and last row. Where two neighbouring rows lie in one run,
their suffixes extend to the left alike, so the common prefix with the sorted neighbour
only has to be measured at run borders; streaming over the text, every position's
matching statistic is the last sampled value less the distance from it.
"""

from __future__ import annotations

import numpy as np

_STEP = 7


class RunIndex:
    def __init__(self, strings: list[bytes], group: np.ndarray):
        """group: a number below 2**31 for each string; strings of one group compare."""
        m = len(strings)
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=m)
        self.start = np.zeros(m + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=self.start[1:])
        self.n = int(self.start[-1])
        self.text = np.frombuffer(b"\0".join([*strings, b""]) + b"\0" * 8, dtype=np.uint8)
        self.owner = np.repeat(np.arange(m), sizes + 1)
        self.end = (self.start[1:] - 1)[self.owner]  # where each position's string ends
        self.group = np.asarray(group, dtype=np.int64)[self.owner]
        self._sort()
        self._runs()

    def _sort(self) -> None:
        """Suffix array by prefix doubling from packed bytes; ends of strings are unique."""
        n, at = self.n, np.arange(self.n)
        rest = self.end - at
        word = np.ndarray((n,), dtype="<u8", buffer=self.text, strides=(1,)).byteswap() >> np.uint64(8)
        short = (8 * (_STEP - np.minimum(rest, _STEP))).astype(np.uint64)
        word = (word >> short << short) << np.uint64(3) | np.minimum(rest, _STEP).astype(np.uint64)
        _, rank = np.unique(word, return_inverse=True)
        rank = self._ranked(self.group.astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64))
        span, m = _STEP, np.uint64(len(self.start))
        while True:
            order_known = int(rank.max(initial=0)) == n - 1
            if order_known:
                break
            ahead = np.minimum(at + span, n - 1)
            second = np.where(at + span <= self.end, rank[ahead] + m, self.owner.astype(np.uint64))
            rank = self._ranked(rank << np.uint64(32) | second)
            span *= 2
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[rank.astype(np.int64)] = at

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(len(key), dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        return rank

    def _runs(self) -> None:
        """Runs of the transform; a string's first symbol counts as one of its own."""
        sa = self.sa
        before = self.text[np.maximum(sa - 1, 0)].astype(np.int64)
        whole = sa == self.start[:-1][self.owner[sa]]
        before[whole] = 256 + self.owner[sa[whole]]
        group = self.group[sa]
        new = np.ones(self.n, dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        self.run_first = sa[first]  # sampled starts of runs
        self.run_last = sa[np.concatenate([first[1:], [self.n]]) - 1]  # and their ends
        same = np.zeros(len(first), dtype=bool)
        same[1:] = group[first[1:]] == group[first[1:] - 1]
        # common prefix over each border between runs: row first[i]-1 and row first[i]
        self.border = np.zeros(len(first), dtype=np.int64)
        at = np.flatnonzero(same)
        self.border[at] = self.extent(self.run_last[at - 1], self.run_first[at])

    @property
    def runs(self) -> int:
        return len(self.run_first)

    def extent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of pairs of positions."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        out = most.copy()
        words = np.ndarray((self.n,), dtype="<u8", buffer=self.text, strides=(1,))
        left, done = np.arange(len(a)), 0
        while len(left):
            x = words[np.minimum(a[left] + done, self.n - 1)] ^ words[np.minimum(b[left] + done, self.n - 1)]
            differ = x != 0
            if differ.any():
                low = x[differ] & (~x[differ] + np.uint64(1))
                byte = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
                at = left[differ]
                out[at] = np.minimum(most[at], done + byte)
            done += 8
            left = left[~differ]
            left = left[most[left] > done]
        return out

    def statistics(self) -> np.ndarray:
        """For each position the longest match with another suffix of its group."""
        return np.maximum(self._stream(self.run_first, self.border), self._stream(self.run_last, np.concatenate([self.border[1:], [0]])))

    def _stream(self, sample: np.ndarray, value: np.ndarray) -> np.ndarray:
        reach = np.full(self.n, -1, dtype=np.int64)
        reach[sample] = sample + value  # a match found at a sample ends here
        last = np.where(reach >= 0, np.arange(self.n), -1)
        last = np.maximum.accumulate(last)
        return np.where(last >= 0, np.maximum(reach[np.maximum(last, 0)] - np.arange(self.n), 0), 0)

    def repeated(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, from, to): maximal stretches covered by matches of at least size."""
        got = self.statistics()
        at = np.flatnonzero(got >= size)
        step = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + got[at], -1)
        inside = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
        inside[self.end + 1] = False  # never over a string's end
        a, b = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        own = self.owner[a]
        return own, a - self.start[own], b - self.start[own]
