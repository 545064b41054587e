"""Near duplicates by bands of a MinHash, and people who are the same person: rows that are linked, as groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators.components import connected_components
from archivum.operators.durable import discard, materialize

#: Words in a shingle, bands of the MinHash, hashes in a band.
WORDS, BANDS, IN_BAND = 5, 16, 4
#: Shingles of a block: what a task holds of a band is dealt out as pairs of blocks.
BLOCK = 1 << 20


def words_of(text: Column) -> Column:
    """The lower-cased words with one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: Constants of xxHash64, and how many shingles are hashed at a time.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
AT_ONCE = 1 << 14


def shingles(words: bytes) -> np.ndarray:
    """xxhash64 (seed 42, as Spark's) of the distinct runs of five words, ascending; the words stand with one space between.

    Fewer words are one shingle, no words have none.
    """
    if not words:
        return np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    begins, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(words)]
    found = [xxhash.xxh64_intdigest(words[i:j], 42) for i, j in zip(begins, ends[min(WORDS, len(ends)) - 1 :])]  # as many as there are ends
    return np.unique(np.array(found, np.uint64).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, set and digest of the rows whose texts have words."""
    for batch in batches:
        rows, sets, digests, held = [], [], [], 0
        for row, words in zip(batch.column("row").to_pylist(), batch.column("words"), strict=True):
            if not len(found := shingles(words.as_buffer().to_pybytes())):
                continue
            rows.append(row)
            sets.append(found)
            digests.append(hashlib.sha256(found.tobytes()).digest())
            held += len(found)
            if held >= BLOCK:
                yield _set_batch(rows, sets, digests)
                rows, sets, digests, held = [], [], [], 0
        if rows:
            yield _set_batch(rows, sets, digests)


def _set_batch(rows: list[int], sets: list[np.ndarray], digests: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))), pa.array(digests, pa.binary())], ["row", "set", "digest"])


def _hash_longs(mixed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs after ``seeds``; ``mixed`` is ``_mix`` of them."""
    h = (seeds + P5 + np.uint64(8)) ^ mixed
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * P1 + P4
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def _mix(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64) * P2
    return ((x << np.uint64(31)) | (x >> np.uint64(33))) * P1


def _int_seed(n: int) -> np.ndarray:
    """Spark's xxhash64 of the int ``n``, after which further values are hashed."""
    h = (np.array([42], np.uint64) + P5 + np.uint64(4)) ^ (np.array([n], np.uint64) * P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * P2 + P3
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


SEEDS = [_int_seed(n) for n in range(BANDS * IN_BAND)]


def bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, BANDS) numbers of sets that begin at ``starts`` of ``values``, none empty.

    A band's number is a hash of the least values (as signed numbers) that IN_BAND seeded hashes take over the set.
    """
    least = np.full((len(SEEDS), len(starts)), np.iinfo(np.int64).max)
    for lo in range(0, len(values), AT_ONCE):
        part = _mix(values[lo : lo + AT_ONCE])
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, lo + len(part)))
        cuts = np.maximum(starts[first:last] - lo, 0)
        for k, seed in enumerate(SEEDS):
            got = np.minimum.reduceat(_hash_longs(part, seed).view(np.int64), cuts)
            np.minimum(least[k, first:last], got, out=least[k, first:last])
    out = np.empty((len(starts), BANDS), np.int64)
    for band in range(BANDS):
        h = np.full(len(starts), 42, np.uint64)
        for k in range(band * IN_BAND, (band + 1) * IN_BAND):
            h = _hash_longs(_mix(least[k]), h)
        out[:, band] = h.view(np.int64)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, band and value of nodes with their sets."""
    for batch in batches:
        held = batch.column("set")
        if len(held):
            starts = held.offsets.to_numpy().astype(np.int64)
            value = bands(held.values.to_numpy()[starts[0] : starts[-1]], starts[:-1] - starts[0])
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(value))), pa.array(value.ravel())], ["node", "band", "value"])


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with the exact similarity of their sets, and whether it is enough."""
    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    likeness = both.select("a", "b", shared.alias("n"), (F.size("set_a") + F.size("set_b")).alias("both")).select("a", "b", (F.col("n") / (F.col("both") - F.col("n"))).alias("similarity"))
    return likeness.withColumn("linked", F.col("similarity") >= least)


def _group_links(rows: list[tuple], i: int, j: int, least: float) -> list[tuple[int, int, float]]:
    """Links of a band's nodes (block, node, open, set) between blocks i and j, where one side is open.

    As many as join what is joined here, and the weakest of each set of joined nodes.
    """
    own = [r for r in rows if r[0] == i]
    other = own if i == j else [r for r in rows if r[0] == j]
    root = {r[1]: r[1] for r in (*own, *other)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joining, links = [], []
    for k, (_, a, a_open, x) in enumerate(own):
        for _, b, b_open, y in other[k + 1 :] if i == j else other:
            if not (a_open or b_open) or min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            similarity = shared / (len(x) + len(y) - shared)
            if similarity >= least:
                links.append((min(a, b), max(a, b), similarity))
                if (ra := find(a)) != (rb := find(b)):
                    root[max(ra, rb)] = min(ra, rb)
                    joining.append(links[-1])
    weakest: dict[int, tuple[int, int, float]] = {}
    for link in links:
        label = find(link[0])
        if label not in weakest or link[2] < weakest[label][2]:
            weakest[label] = link
    return [*joining, *weakest.values()]


def _block_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: tuple, rows: list[tuple]) -> pa.RecordBatch:
            found = _group_links(rows, group[2], group[3], least)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

        group, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "value", "i", "j")), strict=True)
            facts = zip(*(batch.column(c).to_pylist() for c in ("block", "node", "open")), strict=True)
            for key, fact, items in zip(keys, facts, batch.column("set"), strict=True):
                if key != group:
                    if held:
                        yield out(group, held)
                    group, held = key, []
                held.append((*fact, np.sort(items.values.to_numpy())))
        if held:
            yield out(group, held)

    return run


def near_duplicates(df: DataFrame, row: str, text: str, least: float = 0.8) -> DataFrame:
    """(row, representative, similarity) of rows whose texts resemble another's: the representative is the smallest row
    of the group (rows joined by chains of links), similarity that of the weakest link that was read.

    Candidates share a band; each is decided by its exact Jaccard similarity.  Rows of equal sets are one node, so copies
    are never paired.  The nodes of a band are compared with its smallest node; only those it isn't like are compared
    with the band's others, so a group of near copies costs one comparison a member.  That comparison runs inside tasks, for
    pairs of blocks of a band, and gives the links that join its nodes and the weakest ones, never all pairs.  A very
    common band is combined before the shuffle and met by joins that can be split.  Texts without words and rows without an id are in no group; an
    empty table gives none.  ``row`` must be a long.
    """
    words = df.where(F.col(row).isNotNull()).select(F.col(row).cast("long").alias("row"), words_of(F.col(text)).alias("words"))
    held = materialize(words.mapInArrow(_sets, "row long, set array<long>, digest binary"), "near-sets")
    first = held.groupBy("digest").agg(F.min("row").alias("node"))
    members = materialize(held.select("row", "digest").join(first, "digest").select("row", "node"), "near-members")
    nodes = materialize(held.join(members.where("row = node").select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select(F.col("row").alias("node"), "set"), "near-nodes")
    keys = materialize(nodes.mapInArrow(_bands, "node long, band int, value long"), "near-bands")
    crowd = keys.groupBy("band", "value").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    held_keys = materialize(keys.join(crowd, ["band", "value"]), "near-keys")
    stars = materialize(_verified(held_keys.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), nodes, least), "near-stars")
    failed = stars.where("not linked").select(F.col("a").alias("centre"), F.col("b").alias("node"))
    open_ = held_keys.join(failed, ["centre", "node"], "left_semi").select("band", "value", "node", F.lit(True).alias("open"))
    crowded = open_.select("band", "value").distinct()
    inside = held_keys.where("node != centre").join(crowded, ["band", "value"], "left_semi").join(open_, ["band", "value", "node"], "left")
    inside = materialize(inside.join(nodes.select("node", F.size("set").alias("n")), "node").select("band", "value", "node", F.coalesce("open", F.lit(False)).alias("open"), "n"), "near-inside")
    blocks = inside.groupBy("band", "value").agg(F.count("*").alias("k"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("k > 1").drop("k")
    dealt = inside.join(blocks, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.join(nodes, "node").select("band", "value", "i", "j", "block", "node", "open", "set")
    rest = dealt.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j").mapInArrow(_block_links(least), "a long, b long, similarity double")
    links = materialize(stars.where("linked").select("a", "b", "similarity").unionByName(rest).distinct(), "near-links")
    label = connected_components(links.select("a", "b"))
    weakest = links.join(label.withColumnRenamed("node", "a"), "a").groupBy("label").agg(F.min("similarity").alias("similarity"))
    grouped = members.join(label, "node", "left").withColumn("representative", F.coalesce("label", "node"))
    several = grouped.groupBy("representative").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    scored = several.join(weakest.withColumnRenamed("label", "representative"), "representative", "left")
    out = materialize(grouped.join(scored, "representative").select(F.col("row").alias(row), "representative", F.coalesce("similarity", F.lit(1.0)).alias("similarity")), "near")
    discard(held, members, nodes, keys, held_keys, stars, inside, links)
    return out


def simple_name(name: Column) -> Column:
    """A name in small letters without a company's ending, without marks, its spaces squeezed."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for ending in (", inc.", " inc.", ", llc", " llc", " co.", ", co.", " corp.", ", corp."):  # fixed values, in this order
        out = F.regexp_replace(out, ending.replace(".", r"\.") + r"\z", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\s]", ""), r"\s+", " "))


def same_people(people: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``people`` (node: long, address, name, weight) -> (node, canonical): who stands for each of them.

    First, people of one base address are one; then people of one simplified name that share a domain or a neighbour
    (``neighbours``: node, neighbour).  The one of the greatest weight stands for a group, then of the longest name, then
    the smallest node.  The reference's names are compared inside groups of one simplified name, where they are equal.
    Nobody is paired: a group's people are tied to the smallest of them.
    """
    known = people.select("node", F.lower(F.trim("address")).alias("address"), "name", "weight").withColumn("base", mail.base_address(F.col("address")))
    # A struct's greatest value: weight, then length of the name, then the smallest node.
    rank = F.struct(F.col("weight"), F.length("name"), (-F.col("node")).alias("back"), "node")
    best = known.where("base != ''").groupBy("base").agg(F.max(rank)["node"].alias("first"))
    one = materialize(known.join(best, "base", "left").withColumn("first", F.coalesce("first", "node")), "people")
    left = one.where("node = first").select("node", simple_name(F.col("name")).alias("name"), F.substring_index("address", "@", -1).alias("domain"), F.col("address").contains("@").alias("mail")).where("name != ''")
    by_domain = left.where("mail and domain != ''").select("node", "name", F.concat(F.lit("@"), "domain").alias("tie"))
    by_neighbour = left.join(neighbours.select("node", F.concat(F.lit("#"), F.col("neighbour").cast("string")).alias("tie")), "node").select("node", "name", "tie")
    ties = materialize(by_domain.unionByName(by_neighbour), "people-ties")
    hub = ties.groupBy("name", "tie").agg(F.min("node").alias("hub"))
    label = connected_components(ties.join(hub, ["name", "tie"]).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    named = one.where("node = first").join(label, "node").groupBy("label").agg(F.max(rank)["node"].alias("canonical"))
    second = label.join(named, "label").select(F.col("node").alias("first"), "canonical")
    return one.join(second, "first", "left").select("node", F.coalesce("canonical", "first").alias("canonical"))
