"""Suffix sorting by hash-compared mergesort, in numpy.

Prefix polynomial hashes give the hash of any stretch of the text; a binary search over stretch lengths gives
the common extension of two suffixes, so two suffixes compare in a logarithmic number of steps. Runs of sorted
suffixes are merged pairwise, all merges of a level at once, each suffix finding its place among the sibling
run's by binary search. Claimed extensions are verified against the bytes at the end.
"""

from __future__ import annotations

import numpy as np

from .common import BYTE_VALUE, prefix_hashes, span_hashes


class Suffixes:
    """Suffixes of ``data`` that start at ``starts``, each compared on its first ``limit`` bytes only.

    Every suffix has ``limit`` bytes. ``data`` may be several texts end to end.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, limit: int):
        self.data, self.starts, self.limit = data, starts.astype(np.int64), limit
        self.prefix = prefix_hashes(BYTE_VALUE[data])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``i`` and ``j`` (positions in data) share, up to ``limit``."""
        out = np.zeros(len(i), np.int64)
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            fits = np.flatnonzero(out + step <= self.limit)
            a, b = i[fits] + out[fits], j[fits] + out[fits]
            same = span_hashes(self.prefix, a, a + step) == span_hashes(self.prefix, b, b + step)
            out[fits[same]] += step
            step >>= 1
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``i`` comes before that at ``j``; of equal ones neither does."""
        n = self.common(i, j)
        differ = n < self.limit
        at = np.where(differ, n, 0)
        return differ & (self.data[i + at] < self.data[j + at])

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes (numbers of ``starts``; equal ones in their order there), and for each in that
        order the bytes it shares with the one before it (0 for the first)."""
        n = len(self.starts)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # Buckets by the first bytes come first; merging is within buckets.
        head = np.zeros(n, np.uint64)
        for b in range(min(8, self.limit)):
            head = head << np.uint64(8) | self.data[self.starts + b].astype(np.uint64)
        order = np.argsort(head, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], head[order[1:]] != head[order[:-1]])))
        size = np.diff(np.append(begins, n))
        bucket_start, bucket_size = np.repeat(begins, size), np.repeat(size, size)
        width = 1
        while (live := np.flatnonzero(bucket_size > width)).size:
            inside = live - bucket_start[live]
            run = inside // width
            sibling = bucket_start[live] + (run ^ 1) * width
            low, high = sibling.copy(), np.minimum(sibling + width, bucket_start[live] + bucket_size[live])
            high = np.maximum(low, high)
            mine, left = self.starts[order[live]], run % 2 == 0
            while (open_at := np.flatnonzero(low < high)).size:
                middle = (low[open_at] + high[open_at]) // 2
                other = self.starts[order[middle]]
                # From the left run: those strictly before it; from the right run: those not after it.
                first = np.where(left[open_at], other, mine[open_at])
                second = np.where(left[open_at], mine[open_at], other)
                before = self.less(first, second)
                goes = np.where(left[open_at], before, ~before)
                low[open_at[goes]] = middle[goes] + 1
                high[open_at[~goes]] = middle[~goes]
            pair = bucket_start[live] + (run // 2) * 2 * width
            place = pair + inside % width + (low - sibling)
            order[place] = order[live]
            width *= 2
        shared = np.zeros(n, np.int64)
        shared[1:] = self.common(self.starts[order[1:]], self.starts[order[:-1]])
        if not self.verified(order, shared):
            return self.by_bytes()
        return order, shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours share just as many bytes as the hashes say and are in the order of their bytes."""
        a, b = self.starts[order[:-1]], self.starts[order[1:]]
        for at in range(0, len(a), 1 << 14):
            x = self.data[a[at : at + (1 << 14), None] + np.arange(self.limit)]
            y = self.data[b[at : at + (1 << 14), None] + np.arange(self.limit)]
            differ = x != y
            real = np.where(differ.any(1), differ.argmax(1), self.limit)
            row, last = np.arange(len(x)), np.minimum(real, self.limit - 1)
            if (real != shared[at + 1 : at + 1 + len(x)]).any() or (x[row, last] > y[row, last]).any():
                return False
        return True

    def by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing bytes: the way out of a hash collision."""
        raw = self.data.tobytes()
        parts = [raw[s : s + self.limit] for s in self.starts.tolist()]
        order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
        shared = np.zeros(len(parts), np.int64)
        for k in range(1, len(order)):
            a, b = parts[order[k - 1]], parts[order[k]]
            shared[k] = next((n for n in range(self.limit) if a[n] != b[n]), self.limit)
        return order, shared
