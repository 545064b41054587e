"""Benchmark decontamination by size-partitioned MinHash containment search, with exact verification.

Items are partitioned by the number of their shingles.  An item's sketch is its ``SKETCH`` smallest shingle hashes, so a
partition needs no document shingle above its largest kept hash.  A document that holds the share ``c`` of an item holds
each kept hash with probability ``c``: what a text holds of the sketches is counted while it is read (in windows of no
kind: whole texts), and an item is a candidate if the text holds at least the number that a share of 4/5 leaves behind
with negligible probability.  Candidates are verified by exact containment of all the item's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import materialize
from archivum.llm.hashing import U, chunks, shingles, word_hashes

WIDTH = 5
THRESHOLD = 0.8
#: Hashes in an item's sketch.
SKETCH = 16
#: Sketch hashes that may be broadcast (8 bytes each, and 8 for the item's place); beyond, a join by hash takes over.
BROADCAST_HASHES = 4_000_000
#: A sketch hash more often missing than this, at a share of THRESHOLD, is not allowed for: with 16 hashes, 4 must be held.
MISSED = 1e-6


def least_held(n: int, share: float = THRESHOLD, missed: float = MISSED) -> int:
    """The number of ``n`` sketch hashes that a text with this share of the item holds, but for ``missed`` of cases."""
    from math import comb

    total = 0.0
    for held in range(n + 1):
        total += comb(n, held) * share**held * (1 - share) ** (n - held)
        if total > missed:
            return max(1, held)
    return n


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, width (words of its shingles), size partition, size, sketch hashes and all hashes of items with words."""
    for batch in batches:
        ids, rows = batch.column("item_id").to_pylist(), []
        for lo, _, part in chunks(batch.column("text")):
            h, at = word_hashes(part)
            sizes = np.diff(at)
            for k, s in enumerate(shingles(h, at, WIDTH)):
                if len(s):
                    rows.append((ids[lo + k], int(min(sizes[k], WIDTH)), len(s).bit_length(), len(s), s[:SKETCH].view(np.int64).tolist(), s.tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item_id", "width", "size_class", "n", "sketch", "items"])


def item_sketches(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(_item_rows, "item_id long, width int, size_class int, n long, sketch array<long>, items binary")


def _whole_short(h: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Runs of fewer than WIDTH words, hashed as a whole text of so many words is."""
    from archivum.llm.hashing import _SHORT, _STEP, mix

    n = len(h) - width + 1
    runs = mix(sum((h[k : n + k] * _STEP[k] for k in range(width)), np.zeros(max(n, 0), U)) + _SHORT[width]) if n > 0 else np.zeros(0, U)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(runs[lo : max(lo, hi - width + 1)])


class _Search:
    """The sketches of all items as sorted hashes, for each partition by width and size.

    A partition's bound is its largest kept hash: the larger its items, the fewer of a text's shingles it looks at.
    """

    def __init__(self, rows: list[tuple]):
        self.parts, self.widths = [], sorted({r[1] for r in rows})
        for width, size in sorted({(r[1], r[2]) for r in rows}):
            own = [r for r in rows if (r[1], r[2]) == (width, size)]
            keys = np.concatenate([np.array(r[4], np.int64).view(U) for r in own])
            item = np.concatenate([np.full(len(r[4]), i) for i, r in enumerate(own)])
            order = np.argsort(keys, kind="stable")
            self.parts.append((width, keys[order], item[order], np.array([least_held(len(r[4])) for r in own]), [r[0] for r in own], keys.max()))

    def text(self, sets: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        """(item_id, held sketch hashes) of candidates."""
        for width, keys, item, least, ids, top in self.parts:
            s = sets[width]
            s = s[: np.searchsorted(s, top, "right")]
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                held = np.bincount(np.concatenate([item[lo[i] : hi[i]] for i in hit.tolist()]), minlength=len(ids))
                for i in np.flatnonzero(held >= least).tolist():
                    yield ids[i], int(held[i])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: texts that hold an item's shingles to ``threshold`` at least.

    Shingles are runs of five words (the whole item if it is shorter, searched as such a run).  Items and texts without
    words give no rows, nor do rows without an id; repeated items and documents each count once by id.  A very long text is
    hashed slice by slice.  Further columns of either table are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = materialize(item_sketches(benchmark).dropDuplicates(["item_id"]), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    size = items.agg(F.sum(F.size("sketch")), F.sum("n")).first()
    if not size[0]:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")
    if size[0] + size[1] <= BROADCAST_HASHES:
        rows = [(r["item_id"], r["width"], r["size_class"], r["n"], r["sketch"], bytes(r["items"])) for r in items.collect()]
        sent = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _Search(sent.value)
            whole = {r[0]: np.frombuffer(r[5], U) for r in sent.value}
            for batch in batches:
                ids, found = batch.column("doc_id").to_pylist(), []
                for lo, _, part in chunks(batch.column("text")):
                    h, at = word_hashes(part)
                    kinds = {w: (shingles if w == WIDTH else _whole_short)(h, at, w) for w in index.widths}
                    for k in range(len(part)):
                        sets = {w: next(it) for w, it in kinds.items()}
                        if WIDTH in sets and at[k + 1] - at[k] < WIDTH:
                            sets[WIDTH] = np.zeros(0, U)
                        for item, _ in index.text(sets):
                            mine = whole[item]
                            shared = max(int(np.isin(mine, s, assume_unique=True).sum()) for s in sets.values())
                            if shared >= threshold * len(mine):
                                found.append((ids[lo + k], item, len(mine), shared, shared / len(mine)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.float64(),))], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        out = texts.mapInArrow(search, "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")
        return out.dropDuplicates(["doc_id", "item_id"])
    return _by_join(texts, items, threshold)


def _by_join(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for many items: of each partition, document shingles up to its bound meet its sketches in a join by hash."""
    top = items.select("width", "size_class", F.explode("sketch").alias("key")).groupBy("width", "size_class").agg(F.max(F.col("key").bitwiseXOR(F.lit(-(2**63)))).alias("top"))
    tops = {(r["width"], r["size_class"]): int(np.int64(r["top"]).view(U) ^ U(1 << 63)) for r in top.collect()}  # at most 5 widths and 64 sizes
    widths = sorted({w for w, _ in tops})

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, part in chunks(batch.column("text")):
                h, at = word_hashes(part)
                for width in widths:
                    for k, s in enumerate((shingles if width == WIDTH else _whole_short)(h, at, width)):
                        for part, bound in tops.items():
                            own = s[: np.searchsorted(s, U(bound), "right")] if part[0] == width else s[:0]
                            if len(own):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ids[lo + k])), pa.array(np.full(len(own), 64 * width + part[1], np.int32)), pa.array(own.view(np.int64))], ["doc_id", "part", "key"])

    least = F.create_map(*[F.lit(x) for n in range(1, SKETCH + 1) for x in (n, least_held(n))])
    keys = items.select("item_id", (64 * F.col("width") + F.col("size_class")).cast("int").alias("part"), F.size("sketch").alias("kept"), F.explode("sketch").alias("key"))
    held = texts.mapInArrow(low, "doc_id long, part int, key long").join(keys, ["part", "key"]).groupBy("doc_id", "item_id", "kept").agg(F.countDistinct("key").alias("held"))
    pairs = held.where(F.col("held") >= F.try_element_at(least, F.col("kept"))).select("doc_id", "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text, item, n, width, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "n", "width", "items")), strict=True):
                h, at = word_hashes([text.encode("utf-8", "surrogatepass")])
                s = next(shingles(h, at, WIDTH) if width == WIDTH else _whole_short(h, at, width))
                shared = int(np.isin(np.frombuffer(own, U), s).sum())
                if shared >= threshold * n:
                    found.append((doc, item, n, shared, shared / n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.float64(),))], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    both = pairs.join(texts, "doc_id").join(items.select("item_id", "n", "width", "items"), "item_id")
    return both.mapInArrow(verify, "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double").dropDuplicates(["doc_id", "item_id"])

