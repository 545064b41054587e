"""A mergesort of suffixes that compares by prefix polynomial hashes (numpy, many small sorts at once).

The common extension of two suffixes is found by binary search over lengths with equal hashes, so a comparison takes a
logarithmic number of steps; merging is by binary search in the other run.  Hashes are modulo 2**64; suffixes that count
as equal are compared byte by byte at the end, so a collision can't join different strings.
"""

from __future__ import annotations

import numpy as np

from archivum.llm.hashing import U, mix

_TABLE = np.random.default_rng(77).integers(1, 2**64 - 1, 256, dtype=U) | U(1)
_BASE = U(0xD1342543DE82EF95)
_INVERSE = U(pow(0xD1342543DE82EF95, -1, 2**64))
_POWER = np.ones(1, U)
_BACK = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers up to n."""
    global _POWER, _BACK
    if len(_POWER) < n:
        n = max(n, 2 * len(_POWER))
        p = np.full(n, _BASE)
        p[0] = 1
        b = np.full(n, _INVERSE)
        b[0] = 1
        _POWER, _BACK = np.cumprod(p), np.cumprod(b)
    return _POWER, _BACK


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the hash of buf[i:j], times the base's power i."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=out[1:])
    return out


class SuffixSorter:
    """Suffixes of ``buf``, each taken to ``depth`` bytes at most (all must have so many)."""

    def __init__(self, buf: np.ndarray, depth: int):
        self.buf, self.depth, self.hash = buf, depth, prefix_hashes(buf)
        self.power, _ = powers(len(buf) + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        h, p = self.hash, self.power
        return (h[a + n] - h[a]) * p[b] == (h[b + n] - h[b]) * p[a]

    def shared(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places (ascending) of the suffixes whose first ``depth`` bytes have another's hash in their segment."""
        _, back = powers(len(self.buf) + 1)
        value = mix((self.hash[starts + self.depth] - self.hash[starts]) * back[starts]) + mix(segment.astype(U) + U(1))
        sorted_ = np.sort(value)
        twice = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
        if not len(twice):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
        return np.flatnonzero(twice[at] == value)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension, at most ``depth``."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.depth)
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.equal(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before b; ``ties`` says what holds for equal ones."""
        n = self.common(a, b)
        full = n >= self.depth
        at = np.minimum(n, self.depth - 1)
        return np.where(full, ties, self.buf[a + at] < self.buf[b + at])

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes, by segment (already ascending) and then by their bytes."""
        n = len(starts)
        order = np.arange(n)
        if not n:
            return order
        cut = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        size = np.diff(np.append(cut, n))
        begin, end = np.repeat(cut, size), np.repeat(cut + size, size)
        width, most = 1, int(size.max())
        while width < most:
            live = np.flatnonzero(end - begin > width)
            offset = live - begin[live]
            run = offset // width
            left = run % 2 == 0
            low = begin[live] + np.where(left, run + 1, run - 1) * width  # the run to merge with
            low = np.minimum(low, end[live])
            high = np.minimum(low + width, end[live])
            lo, hi = low.copy(), high.copy()
            mine = starts[order[live]]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                # equal suffixes of the left run stay first
                before = self.less(starts[order[mid]], mine[open_], ~left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            first = begin[live] + (run - run % 2) * width
            target = first + offset % width + (lo - low)
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order

    def groups(self, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order, and each sorted suffix's group of equal strings (to ``depth`` bytes) in its segment."""
        order = self.sort(starts, segment)
        s, seg = starts[order], segment[order]
        same = np.zeros(len(s), bool)
        pairs = np.flatnonzero(seg[1:] == seg[:-1]) + 1
        pairs = pairs[self.equal(s[pairs - 1], s[pairs], self.depth)]
        for lo in range(0, len(pairs), 1 << 16):  # byte by byte
            part = pairs[lo : lo + (1 << 16)]
            span = np.arange(self.depth)
            same[part] = (self.buf[s[part - 1, None] + span] == self.buf[s[part, None] + span]).all(axis=1)
        return order, np.cumsum(~same) - 1
