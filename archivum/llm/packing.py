"""Best-fit packing of token pieces into sequences, by a configuration linear program over the length histogram.

Texts become pieces of at most ``CAPACITY`` tokens in one pass.  The histogram of lengths (at most ``CAPACITY``
numbers) is all that the driver sees: multiplicative weights price the lengths, a knapsack dynamic program finds
configurations of the best price, the average of the rounds is rounded, and what is left is packed best-fit.  The plan says which ranks of each length go to which sequences, so every piece finds its place by its rank among the pieces
of its length: a sum over (length, salt) counts and a ranking within (length, salt), however many pieces share a length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.llm.common import materialize
from archivum.llm.text_units import LONGEST, units

CAPACITY = 2048
#: Units whose ids a task keeps.
CACHE = 200_000
#: Rounds of multiplicative weights of a solution, how steeply a length's price falls as it is covered, configurations drawn
#: in a round, and the loss (of a configuration's price of 1) that counts as one unit.
ROUNDS, STEEP, ANCHORS, NEAR = 60, 0.01, 256, 0.0001
#: Times that the program is solved, each time for the pieces that rounding has left.
SOLUTIONS = 4
#: Lengths whose configurations are drawn come with their uncovered tokens times this power of their length: long pieces first.
LONG = 8
#: Pieces of one length are ranked in so many groups for each million of pieces, at least SALT.
SALT = 32


class Ids:
    """Token ids of whole texts as little-endian 32-bit numbers, by units.

    They are those of the tokenizers library, which itself encodes texts with special strings; units go through the same
    vocabulary as ranks of tiktoken, which is faster (the tests compare both).
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public.path(name))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(public.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: The same vocabulary as ranks, faster for single units.
        self.fast = tiktoken.Encoding("units", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):  # as the library takes special strings by default
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        cache, every = self.cache, units(text)
        try:
            return b"".join(map(cache.__getitem__, every))
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        encode, out = self.fast.encode_ordinary, []
        for u in every:
            ids = cache.get(u)
            if ids is None:
                ids = np.array(encode(u), "<u4").tobytes()
                if len(u) <= LONGEST:
                    cache[u] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _ids(name: str) -> Ids:
    return Ids(name)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: ids of the text, then ``end``; only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = _ids(tokenizer), np.array([end], "<u4").tobytes()
        ids.cache = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = ids.of(text.as_py()) + last
                n = len(own) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows.extend((doc, i, a, b - a, zlib.crc32(memoryview(own)[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.cache = {}  # workers live on

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """The unbounded knapsack over ``size`` at given prices: the highest price of what fits into each room."""

    def __init__(self, size: np.ndarray, price: np.ndarray, capacity: int):
        self.size, self.price = size, price
        self.best = np.zeros(capacity + 1)
        fits = np.searchsorted(size, np.arange(capacity + 1), "right")
        for room in range(int(size[0]), capacity + 1):
            k = fits[room]
            self.best[room] = max(self.best[room - 1], (self.best[room - size[:k]] + price[:k]).max())

    def configurations(self, first: np.ndarray, taste: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """One configuration for each of the sizes (by number) ``first`` that holds it: rows of size numbers, -1 for none.

        Each further piece is drawn among those that lose nearly nothing of the highest price that the room allows: the
        loss counts in units of NEAR, ``taste`` is the log weight of each size.  So configurations of equal price all
        come up, and not the same complement for many sizes.
        """
        room, act, out = len(self.best) - 1 - self.size[first], np.arange(len(first)), [first]
        while len(act):
            r = room[act]
            rest = r[:, None] - self.size[None, :]
            loss = self.best[r][:, None] - self.price[None, :] - self.best[np.maximum(rest, 0)]
            luck = np.where(rest >= 0, taste - loss / NEAR + rng.gumbel(size=rest.shape), -np.inf)
            pick = luck.argmax(1)
            ok = rest[np.arange(len(act)), pick] >= 0
            act, pick = act[ok], pick[ok]
            column = np.full(len(first), -1)
            column[act] = pick
            out.append(column)
            room[act] -= self.size[pick]
            act = act[room[act] >= self.size[0]]
        return np.stack(out, 1)


def fractional(left: np.ndarray, capacity: int, rounds: int, seed: int) -> tuple[dict[tuple[int, ...], float], float]:
    """(weights of configurations, lower bound): a fractional answer of the configuration program for the pieces ``left``.

    Covering program: as few configurations as possible so that each length is covered.  Each round prices the lengths
    (multiplicative weights: a length's price falls as the rounds so far have covered it), solves the knapsack at these
    prices, draws ANCHORS configurations of the best price through lengths that lack cover, and gives each an equal part of
    the bound.  The answer is the average of the rounds.  Prices over the best price of a configuration are a dual answer,
    so what all pieces are worth is a lower bound of the program.
    """
    rng = np.random.default_rng(seed)
    size = np.flatnonzero(left) + 1
    n = left[size - 1].astype(float)
    anchors = min(ANCHORS, 4 * len(size))
    price, load, bound = size / capacity, np.zeros(len(size)), float((n * size).sum() / capacity)
    total: Counter = Counter()
    for turn in range(1, rounds + 1):
        table = Knapsack(size, price, capacity)
        top = float((price + table.best[capacity - size]).max())
        bound = max(bound, float((n * price).sum()) / top)
        table.price, table.best = price / top, table.best / top
        lacking = np.maximum(n - load / max(1, turn - 1), 1e-6 * n)
        chance = lacking * size
        long = chance * (size / capacity) ** LONG
        drawn = table.configurations(rng.choice(len(size), anchors, p=long / long.sum()), np.log(chance), rng)
        load += np.bincount(drawn[drawn >= 0], minlength=len(size)) * (bound / anchors)
        for row in drawn.tolist():
            total[tuple(sorted((int(size[x]) for x in row if x >= 0), reverse=True))] += bound / anchors
        price = price * np.exp(STEEP * (1 - np.minimum(load / turn / n, 2.0)))
        price = np.maximum(price / price.max(), 1e-9)
    return {c: w / rounds for c, w in total.items()}, bound


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(plan, placed): configurations with their times that pack every piece, and how many pieces the program placed.

    ``counts[k]``: pieces of length k + 1.  The fractional answer is rounded to whole times, heaviest configurations first,
    with what was rounded off carried to the next, and as far as there are pieces; the program is then solved again for what is left.  After
    each solution the rest is packed best-fit (longest first; runs of equal lengths in one step), and the fewest sequences
    count, of equal numbers those of which the program placed more.  Best fit alone is one of the choices, so the plan has
    never more sequences than it.
    """
    left = counts.astype(np.int64).copy()
    plan: Counter = Counter()
    if left[capacity - 1]:
        plan[(capacity,)] += int(left[capacity - 1])
        left[capacity - 1] = 0
    rest = _best_fit(left, capacity)
    best = (plan.total() + rest.total(), plan + rest, int((counts - left).sum()))
    for turn in range(SOLUTIONS):
        before = int(left.sum())
        if not before:
            break
        carry = 0.0
        for config, weight in sorted(fractional(left, capacity, rounds, turn)[0].items(), key=lambda x: (-x[1], x[0])):
            carry += weight
            times = int(carry + 1e-9)
            if times:
                amount = Counter(config)
                times = min(times, *(int(left[k - 1] // m) for k, m in amount.items()))
                if times:
                    plan[config] += times
                    carry -= times
                    for k, m in amount.items():
                        left[k - 1] -= m * times
        rest = _best_fit(left, capacity)
        if plan.total() + rest.total() <= best[0]:
            best = (plan.total() + rest.total(), plan + rest, int((counts - left).sum()))
        if before - int(left.sum()) < 0.02 * before:
            break
    return sorted(best[1].items(), key=lambda x: (-sum(x[0]), x[0])), best[2]


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Longest first, each open sequence filled with the longest pieces that still fit; equal sequences in one step."""
    plan: Counter = Counter()
    left = left.copy()
    while left.any():
        amount: Counter = Counter()
        room = capacity
        while room > 0:
            fit = np.flatnonzero(left[:room] > 0)
            fit = fit[[left[i] > amount[i + 1] for i in fit[-capacity:]]] if len(fit) else fit
            if not len(fit):
                break
            size = int(fit[-1]) + 1
            m = min(room // size, int(left[size - 1]) - amount[size])
            amount[size] += m
            room -= m * size
        times = max(1, min(int(left[s - 1] // m) for s, m in amount.items()))
        plan[tuple(sorted(amount.elements(), reverse=True))] += times
        for s, m in amount.items():
            left[s - 1] -= m * times
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset): ranks of a length in order of configurations."""
    used: Counter = Counter()
    sequence, rows = 0, []
    for config, times in plan:
        offset = 0
        for length in config:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is one piece: the end id alone.  Rows that repeat or have no id are packed each; further
    columns are ignored; an empty table gives no rows.  A very long text's ids are held by one task, four bytes each.  The driver gets one number for each length; the plan that is broadcast has a row for each place in a
    configuration, at most SOLUTIONS * ROUNDS * ANCHORS and two a length: ``capacity`` bounds it, not the corpus.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, end, capacity), "pieces")
    counts = np.zeros(capacity, np.int64)
    found = cut.groupBy("length").count().collect()
    for row in found:
        counts[row["length"] - 1] = row["count"]
    rows = _places(solve(counts, capacity)[0])
    columns = zip(*(rows or [(1, 0, 0, 0, 0)]), strict=True)
    plan = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("length", "low", "times", "sequence", "offset"), columns, strict=True)}))
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "times", "sequence", "offset"))).alias("runs"))
    salts = SALT * (1 + int(counts.sum()) // 1_000_000)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    base = cut.groupBy("length", "salt").count()
    base = base.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.coalesce("base", F.lit(0)) + F.col("within"))
    run = F.element_at(F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["low"] + r["times"])), 1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("run", run)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.col("rank") - F.col("run.low")).alias("sequence_id"), F.col("run.offset").alias("offset"))
