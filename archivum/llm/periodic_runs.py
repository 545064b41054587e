"""Maximal runs of repeated words by a suffix tree: branching tandem repeats, rotated and merged.

The words of many texts are numbered and their suffixes sorted together by prefix doubling (a suffix ends with its
text).  Longest common prefixes of neighbours give the suffix tree: its internal nodes are the intervals of the sorted
suffixes.  After Stoye and Gusfield, every node's leaf list without its largest child is walked: a leaf ``i`` below a node
of depth ``d`` is a branching tandem repeat if ``i + d`` (or ``i - d``) is below the same node, by another child.  A leaf is
walked at most log n times.  Each branching repeat is rotated to the left as far as it goes, which gives the run that
ends where it ends; repeats of a multiple of the period have the same bounds and are merged with it.  All steps are
array operations over the whole batch, so a text of ten words costs what its ten words cost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are sorted together; a longer text stands alone, with some 300 bytes of arrays for each word.
BATCH = 300_000
#: A run counts from this many words, and this many times its period.
LENGTH, EXPONENT = 6, 4

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Suffixes:
    """The sorted suffixes of several sequences, each by itself: ``order``, ``place`` (its inverse) and a rank for each power of two.

    ``ranks[k]`` is equal for two places of one sequence exactly if the 2**k words from there on are equal.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = len(codes)
        self.end = np.repeat(np.cumsum(sizes), sizes)  # where the sequence of each place ends
        self.begin = self.end - np.repeat(sizes, sizes)
        key = self.begin * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
        self.ranks = [rank.astype(np.int32)]
        size = np.diff(np.r_[first, n])
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in ``order`` that are not alone yet
        width = 1
        while len(open_):
            at = order[open_]
            nxt = at + width
            inside = nxt < self.end[at]
            second = np.where(inside, rank[np.where(inside, nxt, 0)] + 1, 0)
            key = rank[at] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[open_] = at
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            rank[at] = np.repeat(open_[first], size)
            self.ranks.append(rank.astype(np.int32))
            open_ = open_[np.repeat(size > 1, size)]
            width *= 2
        self.order, self.place = order, rank

    def neighbours(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it in ``order``; 0 for the first and from text to text."""
        order = self.order
        common = np.zeros(len(order), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            sorted_rank = rank[order]
            at = np.flatnonzero(sorted_rank[1:] == sorted_rank[:-1]) + 1
            if not len(at):
                continue
            a, b = order[at - 1] + common[at], order[at] + common[at]
            inside = (a < self.end[order[at - 1]]) & (b < self.end[order[at]])
            at, a, b = at[inside], a[inside], b[inside]
            common[at[rank[a] == rank[b]]] += 1 << k
        return common

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before the places ``a`` and before ``b`` are equal (a < b, one sequence)."""
        found = np.zeros(len(a), np.int64)
        begin = self.begin[a]
        for k in range(len(self.ranks) - 1, -1, -1):
            left = a - found - (1 << k)
            ok = np.flatnonzero(left >= begin)
            rank = self.ranks[k]
            found[ok[rank[left[ok]] == rank[(b - found - (1 << k))[ok]]]] += 1 << k
        return found


def _smaller(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each of the places ``at``, the nearest place on one side whose value is smaller; both ends of ``values`` are 0."""
    link = np.zeros(len(values), np.int64)
    link[at] = at + step
    active = at
    while len(active):
        active = active[values[link[active]] >= values[active]]
        link[active] = link[link[active]]
    return link[at]


def tandem_repeats(suffixes: Suffixes, exponent: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every branching tandem repeat whose period goes ``exponent`` times into its sequence."""
    n = len(suffixes.order)
    depth = np.r_[suffixes.neighbours(), 0]
    at = np.flatnonzero(depth)
    if not len(at):
        return at, at
    low, high = _smaller(depth, at, -1), _smaller(depth, at, 1)
    size = (suffixes.end - suffixes.begin)[suffixes.order[at]]
    keep = depth[at] * exponent <= size
    at, low, high = at[keep], low[keep], high[keep]
    if not len(at):
        return at, at
    by = np.argsort(low * (n + 1) + depth[at], kind="stable")  # a node is its interval: where it begins, and its depth
    at, low, high = at[by], low[by], high[by]
    d = depth[at]
    new = np.r_[True, (low[1:] != low[:-1]) | (d[1:] != d[:-1])]
    first = np.flatnonzero(new)
    # a node with m inner bounds has m + 1 children: the first begins with the node, each other at a bound
    where = np.arange(len(at)) + np.cumsum(new)
    child = np.zeros(len(at) + len(first), np.int64)
    child[where] = at
    heads = where[first] - 1
    child[heads] = low[first]
    last = np.r_[heads[1:], len(child)] - 1
    stop = np.r_[child[1:], 0]
    stop[last] = high[first]
    node = np.zeros(len(child), np.int64)
    node[heads[1:]] = 1
    node = np.cumsum(node)
    leaves = stop - child
    largest = np.maximum.reduceat(leaves, heads)
    big = np.flatnonzero(leaves == largest[node])
    small = np.ones(len(child), bool)
    small[big[np.r_[True, node[big[1:]] != node[big[:-1]]]]] = False  # one largest child of each node is left out
    child, stop, node = child[small], stop[small], node[small]
    leaves = stop - child
    each = np.repeat(np.arange(len(child)), leaves)
    leaf = np.arange(len(each)) - np.repeat(np.cumsum(leaves) - leaves, leaves) + child[each]
    i = suffixes.order[leaf]
    d, lo, hi = d[first][node][each], low[first][node][each], high[first][node][each]
    found_place, found_period = [], []
    for step in (1, -1):
        j = i + step * d
        ok = np.flatnonzero((j < suffixes.end[i]) if step > 0 else (j >= suffixes.begin[i]))
        p = suffixes.place[j[ok]]
        ok = ok[(p >= lo[ok]) & (p < hi[ok]) & ((p < child[each[ok]]) | (p >= stop[each[ok]]))]
        found_place.append(np.minimum(i[ok], j[ok]))
        found_period.append(d[ok])
    return np.concatenate(found_place), np.concatenate(found_period)


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs, by start and period; places count through all sequences."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(codes, sizes)
    at, period = tandem_repeats(suffixes, exponent)
    start = at - suffixes.back(at, at + period)  # rotations to the left, as far as they go
    stop = at + 2 * period
    keep = stop - start >= np.maximum(least, exponent * period)
    start, stop, period = start[keep], stop[keep], period[keep]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][: len(start)]  # multiples of a period have its bounds
    found = np.stack([start, stop - start, period], 1)[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _batches(rows: Iterator[tuple[int | None, list[bytes]]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    part, size = [], 0
    for row in rows:
        if part and size + len(row[1]) > BATCH:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[1])
    if part:
        yield part


def periodic_runs(docs: DataFrame, least: int = LENGTH, exponent: int = EXPONENT, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs and collapsed of every whole text.

    ``runs`` are the stretches of at least ``least`` words and ``exponent`` periods that no neighbouring word extends, as
    (start, length, period) in words from 0, by start and period; ``collapsed`` is the text's words without those that
    repeat a run's first period, joined by one space.  Words are maximal stretches without space, tab and line ends.
    ``rewrite`` may change the words of a text, given its doc_id, before they are searched.

    One pass without a shuffle.  Null and empty texts, and those of white space, have no runs and collapse to nothing; a
    null doc_id is kept; rows that repeat are searched each; further columns are ignored; an empty table gives no rows.
    A very long text is searched whole, by one task, beside others of up to BATCH words.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                    words = (text.as_py() or b"").split()
                    yield doc, rewrite(doc, words) if rewrite else words

        for part in _batches(rows()):
            every = [w for _, words in part for w in words]
            numbers = dict.fromkeys(every)
            numbers = dict(zip(numbers, range(len(numbers)), strict=True))
            codes = np.fromiter(map(numbers.__getitem__, every), np.int64, len(every))
            sizes = np.array([len(words) for _, words in part], np.int64)
            found = runs_of(codes, sizes, least, exponent)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            owner = np.searchsorted(ends, found[:, 0], "right")
            mark = np.zeros(len(every) + 1, np.int64)
            np.add.at(mark, found[:, 0] + found[:, 2], 1)
            np.add.at(mark, found[:, 0] + found[:, 1], -1)
            dropped = np.cumsum(mark)[:-1] > 0
            collapsed = [b" ".join(words) for _, words in part]
            for k in np.unique(owner).tolist():
                words = part[k][1]
                collapsed[k] = b" ".join([words[x] for x in np.flatnonzero(~dropped[begins[k] : ends[k]]).tolist()])
            found[:, 0] -= begins[owner]
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            values = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([doc for doc, _ in part], pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the query's repeats: in one text of ten (by crc32 of the id), all from one place on repeat a stretch."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest (ties: smallest start, then period), and SHA-256 of the runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("longest", longest)
    length, period = -F.col("longest.short"), F.col("longest.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000L * -longest.short div longest.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
