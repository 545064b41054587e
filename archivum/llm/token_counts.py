"""Token counts by byte-pair merging with a heap of pairs over a linked list of symbols.

The lowest-rank adjacent pair is popped again and again; a count is the number of initial symbols less the merges, and
no identifier is ever made.  Merge ranks, the pattern and special strings come from a public tokenizer file.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.text_units import LONGEST, units

#: Units whose counts a worker keeps; it starts anew when they are full, so memory is bounded.
CACHE = 1_000_000
LIMIT = 1024


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts for a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]]
        self.symbols = byte_symbols()
        self.numbers = {s: i for i, s in enumerate(spec["model"]["vocab"])}
        number = self.numbers
        #: pair of symbols -> (rank, symbol that they become)
        self.ranks = {(number[a], number[b]): (r, number[a + b]) for r, (a, b) in enumerate(merges)}
        self.initial = [number[s] for s in self.symbols]
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, int] = {}

    def piece(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        ranks = self.ranks
        sym = [self.initial[b] for b in piece]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (p := ranks.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one of them has been merged since
                continue
            sym[i], sym[j] = ranks[a, b][1], -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := ranks.get((sym[i], sym[k])):
                    heapq.heappush(heap, (p[0], i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (p := ranks.get((sym[h], sym[i]))):
                heapq.heappush(heap, (p[0], h, sym[h], sym[i]))
        return n - merges

    def unit(self, unit: str) -> int:
        return sum(self.piece(p.encode("utf-8")) for p in self.pattern.findall(unit))

    def plain(self, text: str) -> int:
        cache, total, unknown = self.cache, 0, []
        for u in units(text):
            try:
                total += cache[u]
            except KeyError:
                unknown.append(u)
        for u in unknown:
            n = cache.get(u)
            if n is None:
                n = self.unit(u)
                if len(u) <= LONGEST:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[u] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string inside it is one token, as the library takes it by default."""
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def _counter(name: str) -> MergeCounter:
    import public_tokenizers as public

    return MergeCounter(public.path(name), public.PATTERN)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    One pass without a shuffle.  Null and empty texts have no bytes and no tokens; rows that repeat are each counted; a
    null doc_id is kept; further columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t.encode("utf-8")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
