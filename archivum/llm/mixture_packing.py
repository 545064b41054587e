"""Mixture-controlled packing: deficit round-robin over source queues, carried across windows and partitions.

Each source is a queue of tokens: its texts, partition by partition.  A round of the deficit round-robin gives every queue
its share of a window as credit, lets it send whole tokens for it, and keeps what is left of the credit (or what it
sent too much) for the next round; a queue that runs dry leaves its share to the others.  So each window holds every
source in the target proportion to within a token or so, and no error adds up.

Rounds follow each other, but windows needn't: the same rule first deals the queues over blocks of ``FAN`` x ``FAN`` x ...
windows, then a block's tokens over its parts, down to windows.  The deficits of windows are carried within a block, those
of blocks by the level above.  A task works out only the blocks that its texts lie in, from the totals of the queues alone,
and cuts its texts at the bounds of the windows.  Tokens beyond the last full window fill sequences whose lengths are
powers of two, so nothing is padded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.llm.common import BROADCAST_ROWS, materialize
from archivum.llm.hashing import chunks
from archivum.llm.token_counts import byte_symbols

CAPACITY = 2048
#: Parts of a block; blocks whose bounds a task keeps.
FAN, KEPT = 1024, 32
#: Queues; if there are more sources, they share queues by a hash of their names.
QUEUES = 256
#: Words whose ids a task keeps beside those of a text.
CACHE = 200_000
#: Partitions whose totals are summed in one group.
GROUP = 1024
#: What a piece holds: its ids, or their CRC-32.
IDS, CRC = ("ids", "binary", bytes), ("ids_crc32", "long", zlib.crc32)


def deal(amounts: np.ndarray, rooms: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What each queue has sent before each round and after the last, one row a queue: rounds of the sizes ``rooms``.

    ``share``: target proportions of the queues.  A round adds a queue's share of its size to the queue's deficit; the
    queue sends the whole tokens of its deficit while it has any, and the round is filled up by one token each from those
    with the largest deficit left.  The sum of ``rooms`` mustn't exceed that of ``amounts``.
    """
    left = amounts.astype(np.int64).copy()
    sent = np.zeros((len(left), len(rooms) + 1), np.int64)
    deficit, credit = np.zeros(len(left)), None
    for turn, room in enumerate(rooms.tolist()):
        if credit is None:
            credit = np.where(left > 0, share / share[left > 0].sum(), 0.0)
        deficit += room * credit
        take = np.maximum(np.minimum(deficit.astype(np.int64), left), 0)
        missing = room - int(take.sum())
        while missing > 0:
            can = np.flatnonzero(take < left)
            if missing > len(can):  # queues ran dry: the others take what these leave, by share
                more = np.minimum(np.maximum(np.floor(missing * share[can] / share[can].sum()).astype(np.int64), 1), (left - take)[can])
                more = np.minimum(more, np.maximum(missing - np.cumsum(more) + more, 0))
            else:
                can = can[np.argsort(-(deficit - take)[can], kind="stable")[:missing]]
                more = 1
            take[can] += more
            missing = room - int(take.sum())
        while missing < 0:
            can = np.flatnonzero(take > 0)
            can = can[np.argsort((deficit - take)[can], kind="stable")[:-missing]]
            take[can] -= 1
            missing = room - int(take.sum())
        left -= take
        deficit -= take
        dry = (left == 0) & (credit > 0)
        if dry.any():
            deficit[dry], credit = 0.0, None
        sent[:, turn + 1] = sent[:, turn] + take
    return sent


class Plan:
    """Where each token of each queue goes: ``pieces`` cuts a stretch of a queue at the bounds of sequences."""

    def __init__(self, totals: np.ndarray, target: np.ndarray, capacity: int = CAPACITY):
        self.totals, self.target, self.capacity = totals, target, capacity
        self.windows = int(totals.sum()) // capacity
        self.level = 0  # a block of the top level has FAN ** level windows
        while FAN ** (self.level + 1) < self.windows:
            self.level += 1
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        size = self._sizes(self.windows, self.level)
        self.top = deal(totals, size * capacity, target) if self.windows else np.zeros((len(totals), 1), np.int64)
        rest = totals - self.top[:, -1]
        self.rest_before = np.r_[0, np.cumsum(rest)]
        bits = [1 << b for b in range(capacity.bit_length(), -1, -1) if int(rest.sum()) >> b & 1]
        self.rest_bounds = np.r_[0, np.cumsum(np.array(bits, np.int64))].astype(np.int64)

    def _sizes(self, windows: int, level: int) -> np.ndarray:
        """Windows of each part of a block of so many windows, parts being blocks of the given level."""
        part = FAN**level
        return np.array([part] * (windows // part) + ([windows % part] if windows % part else []), np.int64)

    def _inner(self, level: int, number: int, amounts: np.ndarray) -> np.ndarray:
        """As ``deal``, of the parts of block ``number`` of a level above 0; its tokens are spread evenly over its windows."""
        found = self.kept.get((level, number))
        if found is None:
            windows = min(FAN**level, self.windows - number * FAN**level)
            found = deal(amounts, self._sizes(windows, level - 1) * self.capacity, amounts / max(1, int(amounts.sum())))
            self.kept[level, number] = found
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        else:
            self.kept.move_to_end((level, number))
        return found

    def _block(self, queue: int, place: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(first window, bounds, base): the windows around a token, and what the queues have sent before bounds[:, 0]."""
        sent, base, first, level = self.top, np.zeros(len(self.totals), np.int64), 0, self.level
        while level:
            part = int(np.searchsorted(sent[queue], place - base[queue], "right")) - 1
            amounts = sent[:, part + 1] - sent[:, part]
            base = base + sent[:, part]
            first = first * FAN + part
            sent = self._inner(level, first, amounts)
            level -= 1
        return first * FAN if self.level else 0, sent, base

    def pieces(self, queue: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(place, length, sequence, offset) of the pieces of a queue's tokens from ``begin`` to before ``end``."""
        while begin < end:
            if begin >= self.top[queue, -1]:
                at = int(self.rest_before[queue]) + begin - int(self.top[queue, -1])
                k = int(np.searchsorted(self.rest_bounds, at, "right")) - 1
                size = min(end - begin, int(self.rest_bounds[k + 1]) - at)
                yield begin, size, self.windows + k, at - int(self.rest_bounds[k])
                begin += size
                continue
            first, sent, base = self._block(queue, begin)
            own = sent[queue]
            lo, stop = begin - int(base[queue]), min(end - int(base[queue]), int(own[-1]))
            a, b = int(np.searchsorted(own, lo, "right")) - 1, int(np.searchsorted(own, stop, "left"))
            before = (sent[:queue, a : b + 1]).sum(0)
            ahead = np.diff(before)  # what the queues before this one have in each window
            bounds = own[a : b + 1].tolist()
            for k, (x, y, o) in enumerate(zip(bounds, bounds[1:], ahead.tolist())):
                if x == y:
                    continue
                x0, y0 = max(x, lo), min(y, stop)
                yield x0 + int(base[queue]), y0 - x0, first + a + k, o + x0 - x
            begin = stop + int(base[queue])


class WordIds:
    """Ids of whole texts by a tokenizers file with word ends whose patterns never cross white space, with a bounded cache of words.

    The ids are those of the tokenizers library, which itself encodes words with characters beyond Latin Extended-A and
    texts with special strings.  Other words go through the same merges as ranks of tiktoken, where a byte that no UTF-8
    text has stands for a word's end; the tests compare both.  Texts are encoded word by word, words pattern by pattern.
    """

    END = b"\xff"
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SIMPLE = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
    BEYOND = re.compile("[\u0130\u0180-\U0010ffff]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        byte = {s: b for b, s in enumerate(byte_symbols())}
        special = set(self.library.get_added_tokens_decoder())
        ranks = {bytes(map(byte.__getitem__, t.removesuffix("</w>"))) + (self.END if t.endswith("</w>") else b""): i for t, i in vocabulary.items() if i not in special}
        self.fast = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids, self.kind).tobytes()

    def _parts(self, word: bytes) -> list[bytes] | None:
        """The matches of the pattern in a lower-cased word; None if the library is to encode it."""
        found = self.SIMPLE.fullmatch(word)
        if found:
            return [p for p in (found[1].lower(), found[2]) if p]
        text = word.decode("utf-8")
        if self.BEYOND.search(text):
            return None
        text = text.lower()
        return [text.encode()] if text.isalpha() else [p.encode() for p in self.PATTERN.findall(text)]

    def _learn(self, words: Iterable[bytes]) -> None:
        """Put the ids of new words into the cache; in texts of many rare words this is where the time goes."""
        cache, fast, end, width = self.cache, self.fast, self.END, self.kind[1:]
        code = {"u2": "H", "u4": "I"}[width]
        packs = [struct.Struct(f"<{n}{code}").pack for n in range(16)]
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters alone
                ids = fast(w.lower() + end)
            elif (parts := self._parts(w)) is None:
                cache[w] = self._whole(w)
                continue
            else:
                ids = fast(parts[0] + end) if len(parts) == 1 else [i for p in parts for i in fast(p + end)]
            cache[w] = packs[len(ids)](*ids) if len(ids) < 16 else np.array(ids, self.kind).tobytes()

    def of(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        cache, words = self.cache, text.split()
        if len(cache) > CACHE:
            cache.clear()
        if new := set(words).difference(cache):
            self._learn(new)
        return b"".join(map(cache.__getitem__, words))


@lru_cache(maxsize=1)
def _word_ids(name: str) -> WordIds:
    import public_tokenizers as public

    return WordIds(public.path(name))


def token_table(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, source, part, before, n, ids: the ids of each text, and how many its partition has of the source before it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part = _word_ids(tokenizer), TaskContext.get().partitionId()
        last = np.array([end], ids.kind).tobytes()
        sent: dict[str, int] = {}
        for batch in batches:
            for lo, hi, texts in chunks(batch.column("text"), 4 << 20):
                source = batch.column("source").slice(lo, hi - lo)
                own = [ids.of(t) + last for t in texts]
                n, before = [len(x) // len(last) for x in own], []
                for s, k in zip(source.to_pylist(), n, strict=True):
                    before.append(sent.get(s, 0))
                    sent[s] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), source, pa.array([part] * len(own), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )
        ids.cache.clear()  # workers live on
        pa.default_memory_pool().release_unused()

    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("source"))
    return rows.mapInArrow(encode, "doc_id long, source string, part int, before long, n long, ids binary")


def mixture_packing(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, targets: dict[str | None, float] | None = None, queues: int = QUEUES, content: tuple[str, str, Callable] = IDS) -> DataFrame:
    """doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id and offset of every piece.

    ``content`` names a column, its type and a function that makes its value of a piece's ids: the ids themselves, or
    what is needed of them, so that they needn't leave the task.

    ``targets``: the proportion of each source in a window; sources that it doesn't name get the mean of those it does.
    Without it, windows have the proportions of the whole table, so that all queues end together.  With it, a queue that
    runs dry leaves its share to the others.  Of more than ``queues`` sources, several share a queue (by a hash of the
    name), one behind the other, and a queue's target is the sum of theirs.

    Texts are tokenised once; their ids are written to the shared folder and cut where the plan says.  The driver gets a
    number for each queue.  A null source is a source of its own.  A null or empty text is its end id alone; rows that
    repeat or have no id are packed each; further columns are ignored; an empty table gives no rows.  A very long text's ids are held by
    one task, a few bytes each.
    """
    spark = docs.sparkSession
    cut = materialize(token_table(docs, tokenizer, end), "token-ids")
    per_part = materialize(cut.groupBy("source", "part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / GROUP)), "part-totals")
    sources = per_part.groupBy("source").agg(F.sum("n").alias("n"))
    few = sources.limit(queues + 1).count() <= queues
    number = F.row_number().over(Window.orderBy("source")) - 1 if few else F.pmod(F.xxhash64("source"), F.lit(queues)).cast("int")
    aim = F.lit(None).cast("double")
    if targets:
        mean = sum(targets.values()) / len(targets)
        named = F.create_map(*[F.lit(x) for k, v in targets.items() for x in ("" if k is None else f"={k}", float(v))])
        aim = F.coalesce(named[F.col("source")], F.lit(mean))
    sources = sources.withColumn("queue", number)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = materialize(sources.withColumn("ahead", ahead).withColumn("aim", aim), "sources")
    found = sources.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("aim").alias("aim")).collect()  # at most ``queues`` rows
    size = 1 + max((row["queue"] for row in found), default=0)
    totals, aims = np.zeros(size, np.int64), np.zeros(size)
    for row in found:
        totals[row["queue"]], aims[row["queue"]] = row["n"], row["n"] if row["aim"] is None else row["aim"]
    share = np.where(totals > 0, np.maximum(aims, 1e-12), 0.0)

    blocks = per_part.groupBy("source", "block").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("blocks_before"))
    within = Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.withColumn("parts_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, ["source", "block"]).join(sources.select("source", "queue", "ahead"), "source")
    starts = materialize(starts.select("source", "part", "queue", (F.col("ahead") + F.col("blocks_before") + F.col("parts_before")).alias("first")), "starts")
    small = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = cut.join(F.broadcast(starts) if small else starts, ["source", "part"]).select("doc_id", "queue", (F.col("first") + F.col("before")).alias("place"), "n", "ids")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = None
        name, kind, of = content
        names = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[kind], pa.int64(), pa.int64(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            plan = plan or Plan(totals, share, capacity)
            rows: list[tuple] = []
            held = 0
            for doc, queue, place, n, raw in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "queue", "place", "n")], batch.column("ids"), strict=True):
                raw = raw.as_py()
                ids = memoryview(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes())
                for at, size, sequence, offset in plan.pieces(queue, place, place + n):
                    start = at - place
                    rows.append((doc, start, size, of(ids[4 * start : 4 * (start + size)]), n, sequence, offset))
                held += 4 * n
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
        pa.default_memory_pool().release_unused()

    return placed.mapInArrow(cut_up, f"doc_id long, start long, length long, {content[0]} {content[1]}, doc_tokens long, sequence_id long, offset long")


