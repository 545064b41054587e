"""Vectorised word and shingle hashes of a batch of texts (numpy, inside Arrow tasks).

Words are maximal runs outside the bytes 0x09-0x0D and 0x20, after lower-casing A-Z; a word's hash is a polynomial over
a random table of its bytes modulo 2**64, finalised by a mixing step.  Two different words collide with a probability
of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U) | U(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 2**64 - 1, 8, dtype=U) | U(1)
_SHORT = _rng.integers(1, 2**64 - 1, 8, dtype=U)
_POWERS = np.ones(1, U)  # grows as longer words come


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(n, U(_BASE))
        p[0] = 1
        _POWERS = np.cumprod(p)
    return _POWERS


def chunks(texts: list[str | None] | pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs [lo, hi) of texts of about ``limit`` bytes, so that working arrays stay small; a longer text stands alone.

    An Arrow column is read value by value, without a copy of the whole batch.
    """
    if isinstance(texts, (pa.Array, pa.ChunkedArray)):
        every = (x.as_py() or b"" for x in texts.cast(pa.binary()))
    else:
        every = ((t or "").encode("utf-8", "surrogatepass") for t in texts)
    lo, size, part = 0, 0, []
    for i, b in enumerate(every):
        if part and size + len(b) > limit:
            yield lo, i, part
            lo, size, part = i, 0, []
        part.append(b)
        size += len(b)
    if part:
        yield lo, lo + len(part), part


def slices(text: bytes, limit: int = 1 << 20, space: np.ndarray = _SPACE) -> Iterator[bytes]:
    """A text in slices of about ``limit`` bytes that end between words (a longer word stays whole)."""
    lo = 0
    while lo < len(text):
        hi = lo + limit
        while hi < len(text):  # on to the next byte between words
            ahead = np.flatnonzero(space[np.frombuffer(text[hi : hi + 4096], np.uint8)])
            if len(ahead):
                hi += int(ahead[0])
                break
            hi += 4096
        yield text[lo:hi]
        lo = hi


def word_hashes(part: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts and each text's first word's place (with the end).

    A text of more than ``limit`` bytes is hashed slice by slice: what is held for it is eight bytes a word.
    """
    if len(part) == 1 and len(part[0]) > limit:
        h = np.concatenate([words([x])[0] for x in slices(part[0], limit)])
        return h, np.array([0, len(h)])
    return words(part)[:2]


def words(part: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, each text's first word's place (with the end), and bytes, starts, ends.

    ``space`` says which bytes stand between words; a blank always does.
    """
    buf = np.frombuffer(b" ".join(part).lower() + b" ", np.uint8)
    gap = space[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(p) + 1 for p in part])
    at = np.searchsorted(starts, first)
    if not len(starts):
        return np.zeros(0, U), at, buf, starts, ends
    longest = int((ends - starts).max())
    place = np.arange(len(buf), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(buf))))
    place[gap] = 0
    value = _BYTE[buf] * _powers(longest + 1)[place]
    value[gap] = 0
    return mix(np.add.reduceat(value, starts)), at, buf, starts, ends


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: runs of ``width`` words, or the whole text if it has fewer words."""
    n = len(hashes)
    runs = np.zeros(0, U)
    if n >= width:
        runs = hashes[: n - width + 1] * _STEP[0]
        for k in range(1, width):
            runs += hashes[k : n - width + 1 + k] * _STEP[k]
        runs = mix(runs)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        m = hi - lo
        if m >= width:
            own = np.sort(runs[lo : hi - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif m:
            yield mix((hashes[lo:hi] * _STEP[:m]).sum(keepdims=True, dtype=U) + _SHORT[m])
        else:
            yield np.zeros(0, U)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text, as sorted 64-bit hashes."""
    for _, _, part in chunks(texts):
        yield from shingles(*word_hashes(part), width)
