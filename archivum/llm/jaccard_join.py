"""N-gram Jaccard self-join of documents by parity sketches, with pigeonhole keys and exact verification.

A document's shingle set flips bits of a very wide parity sketch: two sketches differ in at most ``|A ^ B|`` bits.
Sets with a Jaccard similarity of at least 4/5 differ in at most ``(|A| + |B|) // 9`` shingles, so of ``k`` parts of the
sketch at least ``k - (|A| + |B|) // 9`` are equal.  Sizes fall in bands, each band has its own ``k``; a document gives
keys for its own band and for the bands that hold larger partners.  Ordered by key, with empty parts last, two linked
documents share one of their first ``(|A| + |B|) // 9 + 1`` parts, so only those are joined and no link is lost.

Equal sets are one node from the start.  Each node at a key is first verified against the smallest one there.  What is
left are keys of three nodes or more that lie in several components: inside tasks, in blocks, narrow parity sketches (a
folded form of the wide one) say which nodes have a node of another component within reach.  Only those get their
shingles; they are verified exactly where they meet, and of each block no more links come out than join its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.llm.common import BROADCAST_ROWS, discard, materialize, semi_join
from archivum.operators.components import connected_components
from archivum.llm.hashing import U, chunks, mix, shingles, word_hashes

#: Upper sizes of the bands grow by this factor.
BAND = 1.6
#: Bits of a narrow sketch for each shingle, a power of two: with 4, pairs below a similarity of about 0.79 stay out.
WIDTH = 4
#: Shingles of a block: the nodes of one key that a task holds are dealt out as pairs of blocks.
BLOCK = 1 << 20
#: The sample that tells very common keys: one document of so many, but as many as LEAST at the least; a key that COMMON of
#: them have is dealt out by (key, salt), as many salts as it has times COMMON of them.
EVERY, LEAST, COMMON = 64, 4000, 16
#: 64-bit words that a comparison of sketches works on at once.
TILE = 1 << 20


def _bands(limit: int = 1 << 40) -> list[int]:
    out = [4]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


BANDS = np.array(_bands())


def _node(s: np.ndarray) -> int:
    """A set's identity: a mixed hash of its size and all its shingles."""
    with np.errstate(over="ignore"):
        v = np.array([U(len(s)) * U(0xD6E8FEB86659FD93) + mix(s).sum(dtype=U)], U) ^ np.bitwise_xor.reduce(s)
    return int(mix(v).view(np.int64)[0])


def _keys(s: np.ndarray) -> np.ndarray:
    """The pigeonhole keys of a sorted shingle set."""
    n, out = len(s), []
    own = int(np.searchsorted(BANDS, n))
    for band in range(own, len(BANDS)):
        low, top = (int(BANDS[band - 1]) if band else 0), int(BANDS[band])
        if band > own and 4 * (low + 1) > 5 * n:  # no partner that large
            break
        first = (n + min(top, 5 * n // 4)) // 9 + 1
        most = 2 * top // 9
        k = most + 1 + (2 + most // 10 if most else 0)
        part = ((s >> U(32)) * U(k)) >> U(32)
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        key = np.sort(mix(np.bitwise_xor.reduceat(mix(s), cut) ^ mix(part[cut] + U(band << 40))))[:first]
        if len(key) < first:  # empty parts come last in the order
            empty = np.setdiff1d(np.arange(k, dtype=U), part[cut])[: first - len(key)]
            key = np.concatenate((key, mix(mix(empty + U(band << 40)) + U(1))))
        out.append(key)
    return np.concatenate(out)


def _sketch(s: np.ndarray) -> bytes:
    """The narrow parity sketch: about ``WIDTH`` bits for each shingle, a power of two."""
    bits = max(64, WIDTH << max(0, len(s) - 1).bit_length())
    at = mix(s) & U(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(a: np.ndarray, width: int) -> np.ndarray:
    while a.shape[-1] > width:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs [lo, hi) of rows with their shingle sets."""
    for lo, hi, part in chunks(batch.column("text")):
        yield lo, hi, list(shingles(*word_hashes(part)))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, sets in _sets(batch):
            size, node, sketch = ([f(s) if len(s) else e for s in sets] for f, e in ((len, 0), (_node, None), (_sketch, None)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # equal sets of a task give their keys once; forgetting some only repeats rows
    for batch in batches:
        for _, _, sets in _sets(batch):
            keys, nodes = [], []
            for s in sets:
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    keys.append(k := _keys(s))
                    nodes.append(np.full(len(k), node))
            if len(seen) > 500_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])


def _node_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents: node and shingle set."""
    for batch in batches:
        for _, _, sets in _sets(batch):
            own = [s for s in sets if len(s)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "items"])


def _near(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of n and m items may have a similarity of 4/5 if they differ in ``distance`` items at least."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * distance <= n + m)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 4/5."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _within_reach(n: np.ndarray, sketch: list[bytes], m: np.ndarray, other: list[bytes]) -> np.ndarray:
    """A matrix: whether the sketches leave a similarity of 4/5 possible."""
    out = np.zeros((len(n), len(m)), bool)

    def tables(every: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        widths = np.array([len(s) for s in every])
        places = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        return {w: (at, np.frombuffer(b"".join(every[i] for i in at), U).reshape(len(at), w // 8)) for w, at in places.items()}

    right = tables(other)
    for v, (rows, a) in tables(sketch).items():
        for w, (cols, b) in right.items():
            words = min(v, w) // 8
            if max(v, w) > 4 * min(v, w):  # one set is more than a quarter larger
                continue
            x, y = _fold(a, words), _fold(b, words)
            step = max(1, TILE // (len(cols) * words))
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                gap = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                out[np.ix_(own, cols)] = _near(n[own, None], m[None, cols], gap)
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """Rows sorted by (key, i, j) -> each group's (key, i, j) and the different rows of its blocks i and j."""

    def split(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        rows = list(dict.fromkeys(rows))
        _, i, j = group
        own = [r for r in rows if r[0] == i]
        return own, own if i == j else [r for r in rows if r[0] == j]

    group, held = None, []
    for batch in batches:
        for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "block", *columns)), strict=True):
            if (key, i, j) != group:
                if held:
                    yield group, *split(held)
                group, held = (key, i, j), []
            held.append(tuple(row))
    if held:
        yield group, *split(held)


def _reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups of (node, n, label, sketch): the rows that have a row of another component within reach."""
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "i", "j", "block", "node", "label"])

    for (key, i, j), own, other in _groups(batches, ("node", "n", "label", "sketch")):
        if not own or not other:
            continue
        n, m, label, there = (np.array([r[k] for r in x]) for k, x in ((2, own), (2, other), (3, own), (3, other)))
        near = _within_reach(n, [r[4] for r in own], m, [r[4] for r in other]) & (label[:, None] != there[None, :])
        hit = {(i, own[k][1], own[k][3]) for k in np.flatnonzero(near.any(axis=1))} | {(j, other[k][1], other[k][3]) for k in np.flatnonzero(near.any(axis=0))}
        out.extend((key, i, j, *x) for x in hit)
        if len(out) > 10_000:
            yield rows()
            out = []
    yield rows()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups of (node, label, items): verified links, as many as it takes to join what can be joined in the group."""
    for _, own, other in _groups(batches, ("node", "label", "items")):
        if not own or not other:
            continue
        mine, theirs = ([np.frombuffer(r[3], U) for r in x] for x in (own, other))
        number = {label: k for k, label in enumerate(dict.fromkeys(r[2] for r in (*own, *other)))}
        root = np.arange(len(number))
        label, there = (np.array([number[r[2]] for r in x]) for x in (own, other))
        near = _within_reach(np.array([len(x) for x in mine]), [_sketch(x) for x in mine], np.array([len(x) for x in theirs]), [_sketch(x) for x in theirs])
        found = []
        for k, x in enumerate(mine):
            todo = np.flatnonzero(near[k])
            todo = todo[root[there[todo]] != root[label[k]]]
            while len(todo):
                at, todo = int(todo[0]), todo[1:]
                if _similar(x, theirs[at]):
                    found.append((own[k][1], other[at][1]))
                    root[root == root[there[at]]] = root[label[k]]
                    todo = todo[root[there[todo]] != root[label[k]]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_similar(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        rows = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave a similarity of 4/5 possible."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            w = min(len(x), len(y))
            keep.append(max(len(x), len(y)) <= 4 * w and bool(_near(np.int64(n), np.int64(m), np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum(dtype=np.int64))))
        rows = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])


def _items(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the ``wanted`` nodes, read again from one document of each (and from all without an id)."""
    ids = members.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct()
    known = semi_join(docs, ids, "doc_id").unionByName(docs.where("doc_id is null"))  # a row without an id may hold a set of its own
    return known.mapInArrow(_node_items, "node long, items binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _shared_keys(docs: DataFrame, rows: int) -> DataFrame:
    """(key, salt, node, star, size) of keys that several nodes have; ``star``: the smallest node there.

    Keys that are common in a sample of the documents are dealt out by (key, salt).  The sample is a fixed share of large
    tables and the salts grow with a key's rows in it, so however large the table and however common the key, a (key,
    salt) has some COMMON * EVERY rows; the sample decides on no more than that.
    """
    sample = docs.sample(min(1.0, max(1 / EVERY, LEAST / max(1, rows))), 7).mapInArrow(_key_rows, "key long, node long")
    common = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    common = materialize(common.select("key", F.ceil(F.col("n") / COMMON).alias("salts")), "common-keys")
    few = common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = docs.mapInArrow(_key_rows, "key long, node long").join(F.broadcast(common) if few else common, "key", "left")
    keys = keys.select("key", "node", F.coalesce(F.pmod(F.xxhash64("node"), "salts") + 1, F.lit(0)).cast("int").alias("salt"))
    at_key = Window.partitionBy("key", "salt")
    shared = keys.withColumns({"star": F.min("node").over(at_key), "last": F.max("node").over(at_key), "size": F.count("*").over(at_key)}).where("star != last or salt > 0").drop("last")
    shared = materialize(shared, "shared-keys")
    discard(common)
    return shared


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id, one row per input row.

    Null, empty and blank texts have no shingles and are linked with nothing: component_id is their own doc_id.  Rows
    with equal sets are linked.  A row without a doc_id keeps a null doc_id; its component is named by the other rows'
    smallest id, null if there is none.  A very long text is hashed slice by slice; its set is held by one task at a
    time.  Further columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = materialize(docs.mapInArrow(_members, "doc_id long, n_shingles long, node long, sketch binary"), "members")
    shared = _shared_keys(docs, members.count())

    tops = shared.where("salt > 0").groupBy("key").agg(F.min("star").alias("a"))
    stars = shared.select(F.col("star").alias("a"), F.col("node").alias("b")).unionByName(shared.where("salt > 0").select("key", F.col("star").alias("b")).distinct().join(tops, "key").select("a", "b"))
    stars = materialize(stars.where("a != b").distinct(), "stars")
    several = shared.where("size > 2 or salt > 0").select("key", "node").distinct()
    several = materialize(several, "several")
    used = several.select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    facts = members.join(used, "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    facts = materialize(facts, "nodes")
    discard(shared)

    left, right = (facts.select(F.col("node").alias(k), F.col("n").alias(n), F.col("sketch").alias(x)) for k, n, x in (("a", "n", "x"), ("b", "m", "y")))
    close = materialize(stars.join(left, "a").join(right, "b").mapInArrow(_reach, "a long, b long"), "close")
    items = materialize(_items(docs, members, close.select(F.col("a").alias("node")).union(close.select("b")).distinct()), "items")
    left, right = (items.select(F.col("node").alias(k), F.col("items").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    links = materialize(close.join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long"), "links")
    discard(stars, close, items)
    labels = connected_components(links)

    # nodes of keys that still lie in several components, in pairs of blocks
    apart = several.join(facts.select("node", "n"), "node").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    apart = materialize(apart, "apart")
    keys = apart.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("lo != hi").select("key", "blocks")
    dealt = apart.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.join(facts.select("node", "sketch"), "node").select("key", "i", "j", "block", "node", "n", "label", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(dealt.mapInArrow(_reachable, "key long, i int, j int, block int, node long, label long"), "reachable")
    discard(several, apart, facts)
    items = materialize(_items(docs, members, found.select("node").distinct()), "items")
    held = found.join(items, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = materialize(held.mapInArrow(_block_links, "a long, b long").distinct(), "links")
    discard(found, items)
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))

    named = members.select("node", "doc_id").where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left")
    named = materialize(named.select("node", "doc_id", F.coalesce("label", "node").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "root").select("node", "component_id")
    return members.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
