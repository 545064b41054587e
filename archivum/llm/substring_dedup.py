"""Removal of 50-byte strings that occur in documents of smaller ids, exactly and without moving every suffix.

Of each 50-byte window the 20-byte string with the smallest hash is its anchor, so equal windows have equal anchors.
Anchor hashes meet in one shuffle of (hash, doc_id), packed bucket by bucket into blocks of half the bytes of rows; those
of one document are dropped.  For the rest, the surroundings
that can matter (30 bytes on both sides) meet by hash.  Equal surroundings need one comparison; where they differ, the
suffixes that start at each possible window are sorted by the hash-compared mergesort, and equal runs tell the smallest
document of each window.  Groups of very many different surroundings are dealt out by window instead of being held.
Spans are put together for each document and cut from its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import BROADCAST_ROWS, anti_join, materialize
from archivum.llm.hashing import U, chunks, mix
from archivum.llm.suffix_sort import SuffixSorter, powers, prefix_hashes

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM
#: Rows of surroundings that a task sorts at once.
BATCH = 10_000
#: Different surroundings of one anchor that are held; further ones go on as windows.
HELD = 100_000
#: Bytes of texts, or of a long text, whose anchors are looked for together: a task needs some fifty bytes of arrays for each.
SLICE = 1 << 18
#: Bytes of texts whose equal surroundings are combined, and of cut texts that are put out together.
GATHER = 1 << 20
#: Tasks that the rows of a key go to which are known to be shared before they meet.
SALTS = 1023
#: Bits of an anchor's hash that say whether it is shared; texts that share no more than these are told apart by their bytes.
KEY = U((1 << 48) - 1)
#: Buckets of anchors for each partition of their shuffle.
BUCKETS = 4
#: Bytes of a packed anchor: six of the key, one that tells salted rows, eight of the id (its distance from the one before).
WIDE = 15
#: Anchors of a bucket that are compared together; of a larger bucket only some keys at a time.
UNPACKED = 500_000
#: Rows of texts that are decoded together.
DECODED = 500


def anchors(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash) of the anchors of some texts; a long text is read in slices that share LENGTH - 1 bytes."""
    if len(part) > 1 and sum(map(len, part)) > SLICE:
        found = [(text + lo, at, h) for lo, _, some in chunks(pa.array(part, pa.binary()), SLICE) for text, at, h in [anchors(some)]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    if len(part) == 1 and len(part[0]) > SLICE + LENGTH:
        found = [(at + lo, h) for lo in range(0, len(part[0]) - LENGTH + 1, SLICE) for _, at, h in [anchors([part[0][lo : lo + SLICE + LENGTH - 1]])]]
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        fresh = np.concatenate(([True], at[1:] != at[:-1]))
        return np.zeros(int(fresh.sum()), np.int64), at[fresh], h[fresh]
    sizes = np.array([len(p) for p in part])
    first = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(part), np.uint8)
    n = len(buf) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    h = prefix_hashes(buf)
    _, back = powers(len(buf) + 1)
    value = mix((h[GRAM:] - h[:-GRAM]) * back[: len(h) - GRAM])
    best, at = value, np.arange(len(value), dtype=np.int32)
    width, windows = 1, LENGTH - GRAM + 1
    while width < windows:
        step = min(width, windows - width)
        a, b = best[:-step], best[step:]
        left = a <= b  # the leftmost of equal ones
        best, at = np.where(left, a, b), np.where(left, at[:-step], at[step:])
        width += step
    inside = np.zeros(n, bool)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        inside[lo : max(lo, hi - LENGTH + 1)] = True
    at = at[:n][inside]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    at = at.astype(np.int64)
    text = np.searchsorted(first, at, "right") - 1
    return text, at - first[text], value[at]


def pack(bucket: np.ndarray, key: np.ndarray, salted: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """(bucket, block): the rows of each bucket by id, byte by byte, so that what ids have in common is a run of zeros."""
    order = np.lexsort((own, bucket))
    bucket, own = bucket[order], own[order]
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    gap = np.diff(own, prepend=own[:1])
    gap[begin] = own[begin]
    rows = np.empty((len(own), WIDE), np.uint8)
    rows[:, :6] = key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    rows[:, 6] = salted[order]
    rows[:, 7:] = gap.astype("<i8").view(np.uint8).reshape(-1, 8)
    block = [rows[lo:hi].T.tobytes() for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(own)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(block, pa.binary())], ["bucket", "block"])


def unpack(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, salted, doc_id) of the rows of some blocks."""
    key, salted, own = [], [], []
    for block in blocks:
        rows = np.frombuffer(block, np.uint8).reshape(WIDE, -1)
        wide = np.zeros((rows.shape[1], 8), np.uint8)
        wide[:, :6] = rows[:6].T
        key.append(wide.view("<i8").ravel())
        salted.append(rows[6])
        own.append(np.cumsum(np.ascontiguousarray(rows[7:].T).view("<i8").ravel()))
    return np.concatenate(key), np.concatenate(salted), np.concatenate(own)


def _anchor_blocks(buckets: int):
    """Texts -> (bucket, block).  Of a key that several texts of a chunk have, two rows go where the key goes, the others elsewhere."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, part in chunks(batch.column("text")):
                text, _, key = anchors(part)
                if len(key):
                    key = key & KEY
                    order = np.lexsort((text, key))
                    text, key = text[order], key[order]
                    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
                    text, key = text[fresh], key[fresh]
                    own = ids[lo + text]
                    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    size = np.diff(np.append(begin, len(key)))
                    nth = np.arange(len(key)) - np.repeat(begin, size)
                    salt = np.where(nth < 2, U(0), U(1) + mix(own.view(U) + key) % U(SALTS))
                    yield pack(mix(key + mix(salt)) % U(buckets), key, nth >= 2, own)

    return rows


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket -> (doc_id, key) of anchors that several texts have.

    That is, of a bucket's rows, the salted ones and those whose key stands in another row without a salt.  Unpacking and
    comparing are one function, so a task has one Python worker.
    """

    def rows(blocks: list[bytes], turn: int, turns: int) -> list[np.ndarray]:
        """(key, salted, doc_id) of the keys of a turn."""
        found, lo, size = [], 0, 0
        for i, block in enumerate(blocks):
            size += len(block)
            if size >= WIDE * UNPACKED or i + 1 == len(blocks):
                some = unpack(blocks[lo : i + 1])
                if turns > 1:
                    mine = some[0] % turns == turn
                    some = tuple(x[mine] for x in some)
                found.append(some)
                lo, size = i + 1, 0
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def shared(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        turns = -(-sum(map(len, blocks)) // (WIDE * UNPACKED))
        for turn in range(turns):
            key, salted, own = rows(blocks, turn, turns)
            plain = np.flatnonzero(salted == 0)
            plain = plain[np.argsort(key[plain])]
            same = key[plain[1:]] == key[plain[:-1]]
            twice = np.zeros(len(plain), bool)
            twice[1:] |= same
            twice[:-1] |= same
            keep = np.concatenate((np.flatnonzero(salted), plain[twice]))
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(key[keep])], ["doc_id", "key"])

    bucket, blocks = None, []
    for batch in batches:
        for at, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
            if at != bucket:
                yield from shared(blocks)
                bucket, blocks = at, []
            blocks.append(block.as_py())
    yield from shared(blocks)


_BODY = "doc_id long, row long, body binary"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        body = [z.compress(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(body, pa.binary())], ["doc_id", "row", "body"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, around, doc_id, row, at): up to SIDE bytes before the anchor, the anchor, up to SIDE behind; first byte: how many before.

    Equal surroundings of some texts are combined here: those of the smallest id go on, the others are spans to remove
    (merged, without surroundings; their key deals them out evenly).
    """
    z = zstandard.ZstdDecompressor()

    def found(docs: list[int], rows: list[int], texts: list[bytes], keys: list[np.ndarray]) -> pa.RecordBatch:
        text, at, key = anchors(texts)
        # a key counts only in the text that it was asked for
        asked = mix(np.concatenate(keys).view(U)) + mix(np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(U) + U(1))
        held = np.flatnonzero(np.isin(mix(key & KEY) + mix(text.astype(U) + U(1)), asked))
        text, spots, key = text[held], at[held], key[held].view(np.int64)
        around = [bytes((min(a, SIDE),)) + texts[t][max(0, a - SIDE) : a + GRAM + SIDE] for t, a in zip(text.tolist(), spots.tolist(), strict=True)]
        doc, row = np.array(docs)[text], np.array(rows)[text]
        least: dict[tuple[int, bytes], int] = {}
        for k in zip(key.tolist(), around, doc.tolist(), strict=True):
            if least.setdefault(k[:2], k[2]) > k[2]:
                least[k[:2]] = k[2]
        late = np.array([least[k, a] < d for k, a, d in zip(key.tolist(), around, doc.tolist(), strict=True)], bool)
        sizes = np.array([len(a) - 1 for a in around], np.int32)
        lo = spots - np.array([a[0] for a in around], np.int64)
        hi, gone, stay = lo + sizes, np.flatnonzero(late), np.flatnonzero(~late)
        cut = np.flatnonzero(np.concatenate(([True], (text[gone][1:] != text[gone][:-1]) | (lo[gone][1:] > hi[gone][:-1])))) if len(gone) else gone  # overlapping spans of a text are one
        begin, end = gone[cut], gone[np.append(cut[1:], len(gone)) - 1] if len(gone) else gone
        every = np.concatenate((stay, begin))
        key = np.concatenate((key[stay], (mix(row[begin].view(U)) + lo[begin].view(U)).view(np.int64)))
        body = pa.array([*(around[k] for k in stay.tolist()), *([None] * len(begin))], pa.binary())
        at, hi = np.concatenate((spots[stay], lo[begin])), np.concatenate((hi[stay], hi[end]))
        return pa.RecordBatch.from_arrays([pa.array(key), body, pa.array(doc[every]), pa.array(row[every]), pa.array(at, pa.int32()), pa.array(hi, pa.int32())], ["key", "around", "doc_id", "row", "at", "hi"])

    for batch in batches:
        docs, rows, texts, keys, size = [], [], [], [], 0
        for doc, row, body, own in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("body"), batch.column("keys"), strict=True):
            text = z.decompress(body.as_py())
            if texts and size + len(text) > GATHER:
                yield found(docs, rows, texts, keys)
                docs, rows, texts, keys, size = [], [], [], [], 0
            docs.append(doc)
            rows.append(row)
            texts.append(text)
            keys.append(own.values.to_numpy())
            size += len(text)
        if texts:
            yield found(docs, rows, texts, keys)


_OUT = "doc_id long, row long, lo int, hi int, window binary"


def _rows(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: list[bytes] | None = None) -> pa.RecordBatch:
    last = pa.nulls(len(doc), pa.binary()) if window is None else pa.array(window, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), last], ["doc_id", "row", "lo", "hi", "window"])


def _judge(group: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, around: list[bytes]) -> pa.RecordBatch | None:
    """Groups of several kinds of surroundings: sort the suffixes at each possible window and cut what a smaller id has."""
    bodies = [a[1:] for a in around]
    size = np.array([len(b) for b in bodies])
    base = np.concatenate(([0], np.cumsum(size)))
    before = np.array([a[0] for a in around])
    kind, shift = np.divmod(np.arange(len(around) * (SIDE + 1)), SIDE + 1)  # the window starts ``shift`` bytes before the anchor
    ok = (shift <= before[kind]) & (before[kind] - shift + LENGTH <= size[kind])
    kind, shift = kind[ok], shift[ok]
    segment = group[kind] * (SIDE + 1) + shift
    order = np.argsort(segment, kind="stable")
    kind, shift, segment = kind[order], shift[order], segment[order]
    sorter = SuffixSorter(np.frombuffer(b"".join(bodies), np.uint8), LENGTH)
    starts = base[kind] + before[kind] - shift
    shared = sorter.shared(starts, segment)  # most windows around a common anchor stand alone
    kind, shift, segment, starts = kind[shared], shift[shared], segment[shared], starts[shared]
    order, equal = sorter.groups(starts, segment)
    if not len(order):
        return None
    owner = doc[kind[order]]
    least = np.full(int(equal[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, equal, owner)
    hit = order[least[equal] < owner]
    if not len(hit):
        return None
    hit = hit[np.lexsort((-shift[hit], kind[hit]))]
    k, s = kind[hit], at[kind[hit]] - shift[hit]
    cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] - s[:-1] > LENGTH))))
    last = np.append(cut[1:], len(k)) - 1
    return _rows(doc[k[cut]], row[k[cut]], s[cut], s[last] + LENGTH)


def _as_windows(table: pa.Table) -> pa.RecordBatch:
    """Every window of some surroundings with its bytes, to be judged by a shuffle."""
    doc, row, lo, window = [], [], [], []
    for a, d, r, at in zip(*(table.column(c).to_pylist() for c in ("around", "doc_id", "row", "at")), strict=True):
        for i in range(len(a) - LENGTH):
            doc.append(d)
            row.append(r)
            lo.append(at - a[0] + i)
            window.append(a[1 + i : 1 + i + LENGTH])
    return _rows(np.array(doc, np.int64), np.array(row, np.int64), np.array(lo, np.int64), np.array(lo, np.int64) + LENGTH, window)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, around, doc_id, at) -> spans to remove, or windows (with their bytes) that are still to be judged.

    A task holds the rows of one batch and what it still needs of the open key: a row for each different surroundings,
    HELD at most; a key with more goes on window by window.
    """

    def collapse(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.RecordBatch]:
        """Rows of the smallest document of each kind of surroundings, with the kinds' numbers; and what others lose."""
        key, doc, row, at = (table.column(c).to_numpy() for c in ("key", "doc_id", "row", "at"))
        around = table.column("around").combine_chunks()
        size = pc.binary_length(around).to_numpy()
        same = np.concatenate(([False], (key[1:] == key[:-1]) & pc.equal(around[1:], around[:-1]).to_numpy(zero_copy_only=False)))
        kind = np.cumsum(~same) - 1
        own = doc == doc[np.flatnonzero(~same)][kind]
        late = np.flatnonzero(~own)
        first = np.frombuffer(around.buffers()[2], np.uint8)[np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around)]] if len(around) else np.zeros(0, np.uint8)
        lo = at[late] - first[late].astype(np.int64)
        rows = np.flatnonzero(own)
        return table.take(pa.array(rows)), kind[rows], _rows(doc[late], row[late], lo, lo + size[late] - 1)

    def finish(table: pa.Table, wide: int | None) -> Iterator[pa.RecordBatch]:
        table, kind, lost = collapse(table)
        yield lost
        key = table.column("key").to_numpy()
        if wide is not None and len(key) and key[0] == wide:
            n = int(np.searchsorted(key != wide, True)) if (key != wide).any() else len(key)
            yield _as_windows(table.slice(0, n))
            table, kind, key = table.slice(n), kind[n:], key[n:]
        if not len(key):
            return
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        several = (kind[np.append(begin[1:], len(key)) - 1] > kind[begin])[group]
        rows = np.flatnonzero(several)
        for lo, hi in _parts(group[rows]):
            own = table.take(pa.array(rows[lo:hi]))
            if (out := _judge(group[rows[lo:hi]], own.column("doc_id").to_numpy(), own.column("row").to_numpy(), own.column("at").to_numpy().astype(np.int64), own.column("around").to_pylist())) is not None:
                yield out

    held: pa.Table | None = None
    wide = None
    for batch in batches:
        known = batch.column("around").is_null()
        if known.true_count:
            gone = batch.filter(known)
            yield _rows(*(gone.column(c).to_numpy() for c in ("doc_id", "row", "at", "hi")))
            batch = batch.filter(pc.invert(known))
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        key = table.column("key").to_numpy()
        n = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
        if n:
            yield from finish(table.slice(0, n), wide)
            wide = wide if wide == key[-1] else None
        held = table.slice(n)
        if len(held) > HELD:
            held, _, lost = collapse(held)
            yield lost
            if 2 * len(held) > HELD:
                wide = int(key[-1])
                yield _as_windows(held)
                held = None
    if held is not None and len(held):
        yield from finish(held, wide)


def _parts(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of about BATCH rows."""
    lo = 0
    while lo < len(group):
        hi = min(len(group), lo + BATCH)
        if hi < len(group):
            start = int(np.searchsorted(group, group[hi]))
            hi = start if start > lo else int(np.searchsorted(group, group[hi], "right"))
        yield lo, hi
        lo = hi


def merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the maximal runs of overlapping or touching spans of each row, in order."""
    base = row.astype(np.int64) << 32  # spans are shorter
    order = np.argsort(base + lo, kind="stable")
    lo, reach = (base + lo)[order], np.maximum.accumulate((base + hi)[order])
    begin = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1]))) if len(lo) else order
    row = row[order][begin]
    return row, lo[begin] - (row.astype(np.int64) << 32), reach[np.append(begin[1:], len(lo)) - 1] - (row.astype(np.int64) << 32) if len(lo) else reach


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with an id; ``row`` tells different texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).where("doc_id is not null")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, copies, spans) of ``docs`` (doc_id, text, ...): what each text is, which rows repeat a whole text, what to cut.

    facts: doc_id, row, n_bytes, sha; copies: doc_id, row of texts of LENGTH bytes or more that a smaller id has in full;
    spans: doc_id, row and spans (lo, hi in UTF-8 bytes) of the others.  Rows without an id are left out.
    """
    own = _identified(docs)
    body = F.col("text").cast("binary")
    facts = materialize(own.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("sha")), "facts")
    least = facts.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = facts.where(F.col("n_bytes") >= LENGTH).join(least, "sha").where("doc_id > least").select("doc_id", "row").distinct()
    copies = materialize(copies, "copies")

    single = anti_join(own, copies, ["doc_id", "row"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: blocks are small, what they hold isn't
    blocks = single.mapInArrow(_anchor_blocks(BUCKETS * parts), "bucket int, block binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    keys = blocks.mapInArrow(_several, "doc_id long, key long").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    bodies = single.mapInArrow(_compress, _BODY)
    # a merge join, as a broadcast would put two Python functions, and so two workers, into each task
    around = bodies.join(keys.hint("merge"), "doc_id").mapInArrow(_surroundings, "key long, around binary, doc_id long, row long, at int, hi int")
    found = around.repartition("key").sortWithinPartitions("key", "around", "doc_id", "at").mapInArrow(_spans, _OUT)
    found = materialize(found, "spans", free=True)
    windows = found.where("window is not null")
    late = windows.join(windows.groupBy("window").agg(F.min("doc_id").alias("least")), "window").where("doc_id > least")
    spans = found.where("window is null").select("doc_id", "row", "lo", "hi").unionByName(late.select("doc_id", "row", "lo", "hi"))
    return facts, copies, spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "row", "n_removed", "n_spans", "kept_sha256", "kept"])

    for batch in batches:
        spans = batch.column("spans")
        every = spans.flatten()
        own, lo, hi = merge(np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy()), every.field("lo").to_numpy(), every.field("hi").to_numpy())
        first = np.searchsorted(own, np.arange(len(spans) + 1)).tolist()
        rows, size = [], 0
        for i, (doc, row, packed) in enumerate(zip(*(batch.column(c) for c in ("doc_id", "row", "body")), strict=True)):
            body, kept, at = z.decompress(packed.as_py()), [], 0
            begin, end = lo[first[i] : first[i + 1]].tolist(), hi[first[i] : first[i + 1]].tolist()
            for a, b in zip(begin, end, strict=True):
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            left = b"".join(kept)
            rows.append((doc.as_py(), row.as_py(), sum(end) - sum(begin), len(end), hashlib.sha256(left).hexdigest(), left))
            size += len(left) + 200
            if size > GATHER:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)
    pa.default_memory_pool().release_unused()


def _cut_rows(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = materialize(spans, "merged", free=True)
    texts = _identified(docs)
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(spans.select("doc_id", "row")), ["doc_id", "row"], "left_semi")
    with_text = texts.mapInArrow(_compress, _BODY).join(spans.hint("merge"), ["doc_id", "row"])  # as in repeated_spans
    return with_text.mapInArrow(_cut, "doc_id long, row long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["doc_id", "row"])


def removed_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts count as empty.  Of rows with one doc_id, with equal or different texts, none removes from another; a
    row without a doc_id keeps all its bytes and removes nothing.  Texts shorter than 50 bytes keep all.  A very long
    text is searched slice by slice and held as bytes.  Further columns are ignored; an empty table gives no rows.
    """
    facts, copies, spans = repeated_spans(docs)
    cut = _cut_rows(docs, spans).drop("kept")
    joined = facts.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "row"], "left").join(cut, ["doc_id", "row"], "left")
    gone = F.col("copy").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    done = joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    body = F.coalesce("text", F.lit("")).cast("binary")
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"))
    return done.unionByName(nameless)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (and ``n_chars`` anew where there is such a column).

    Cut characters of several bytes are dropped as a whole.  Every row stays, with all its columns whatever their names;
    whole copies keep an empty text.  An empty table stays empty.
    """
    _, copies, spans = repeated_spans(docs)
    cut = _cut_rows(docs, spans).select("doc_id", "row", "kept").unionByName(copies.withColumn("kept", F.lit(b"")))
    ours, names = {}, docs.columns
    for column in ("doc_id", "row", "kept"):
        ours[column] = "cut_" + column
        while ours[column] in names:
            ours[column] += "_"
    cut = cut.select(*(F.col(a).alias(b) for a, b in ours.items()))
    schema = docs.schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, DECODED) for b in batches for lo in range(0, b.num_rows, DECODED)):
            text = [t if k is None else k.decode("utf-8", "ignore") for t, k in zip(batch.column("text").to_pylist(), batch.column(ours["kept"]).to_pylist(), strict=True)]
            cols = [pa.array(text, pa.string()) if n == "text" else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    same = (docs["doc_id"].cast("long") == cut[ours["doc_id"]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cut[ours["row"]])
    out = docs.join(cut, same, "left").select(*(docs[n] for n in names), ours["kept"]).mapInArrow(decode, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
