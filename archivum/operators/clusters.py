"""Topic clusters: hashed TF-IDF vectors, seeds by k-means|| and spherical k-means, all rows assigned.

Vectors are unit vectors in whole multiples of 2**-26, and so are centres, so that every product and sum is exact in
64 bits: the same seed gives the same clusters however rows are partitioned and in whatever order partial sums arrive.
A pass over the rows gives each task's sums for each cluster, which are added up; only they leave the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import discard, materialize

#: One in fixed-point vectors; sums of 10^11 rows fit into 64 bits.
ONE = 1 << 26
#: Seeding: passes, and rows that a pass is expected to take for each cluster.
PASSES, OVERSAMPLING = 5, 2.0
#: The reference's rule for the number of topics: a twentieth of the sample, from 2 to 8.
LEAST, MOST, SHARE, SAMPLE = 2, 8, 20, 500
ITERATIONS = 25
WORD = re.compile(r"[^\W\d_]{3,}")


def topic_count(rows: int) -> int:
    """Number of topics for so many rows, of which at most SAMPLE are looked at."""
    return min(MOST, max(LEAST, min(rows, SAMPLE) // SHARE))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length ONE and rounded to whole numbers (still as doubles); rows of zeros, or not finite, are zeros."""
    x = np.where(np.isfinite(x).all(1, keepdims=True), x, 0.0)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.rint(np.divide(x, size, out=np.zeros_like(x), where=size > 0) * ONE)


def unit_vectors(df: DataFrame, id_: str, vector: str, dims: int) -> DataFrame:
    """(id, q): fixed-point unit vectors of ``dims`` numbers; rows whose vector is null, of another size or zero are left out."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                q = unit(x)
                kept = np.flatnonzero(q.any(1))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), _lists(q[kept])], ["id", "q"])

    kind = df.schema[id_].dataType.simpleString()
    rows = df.select(F.col(id_).alias("id"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dims)).mapInArrow(scale, f"id {kind}, q array<int>")


def _lists(q: np.ndarray) -> pa.Array:
    bounds = pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.array(q.astype(np.int32).ravel()))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().astype(float).reshape(-1, dims)


def hashed_text_vectors(df: DataFrame, id_: str, text: str, dims: int = 256) -> DataFrame:
    """(id, q): unit vectors of a text's words, hashed into ``dims`` places and weighted by 1 + log tf and inverse document frequency.

    Words are runs of three letters or more in lower case.  Document frequencies are those of the places, over all rows.
    Texts without words are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dims), np.int64)
            for i, value in enumerate(batch.column("text")):
                if len(place) > 500_000:
                    place.clear()
                for w in WORD.findall((value.as_py() or "").lower()):
                    p = place.get(w)
                    if p is None:
                        p = place[w] = zlib.crc32(w.encode()) % dims
                    out[i, p] += 1
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(out)], ["id", "q"])

    kind = df.schema[id_].dataType.simpleString()
    counts = materialize(df.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, q array<int>"), "word-places")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            rows += int(x.any(1).sum())
            held += (x > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(dims)]), pa.array(np.r_[rows, held])], ["place", "n"])

    found = {r["place"]: r["n"] for r in counts.select("q").mapInArrow(places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # a number a place
    df_ = np.array([found.get(i, 0) for i in range(dims)], float)
    idf = np.log((1 + found.get(-1, 0)) / (1 + df_)) + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, dims)
                q = unit(np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf)
                kept = np.flatnonzero(q.any(1))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), _lists(q[kept])], ["id", "q"])

    return counts.mapInArrow(weigh, f"id {kind}, q array<int>")


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, product) of each row; of equal ones the first cluster."""
    product = x @ centres.T
    best = product.argmax(1)
    return best, product[np.arange(len(x)), best]


def _far(product: np.ndarray) -> np.ndarray:
    """1 - cosine as a whole multiple of 2**-26, at least 0."""
    return np.maximum(ONE - np.rint(product / ONE), 0).astype(np.int64)


def seeds(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """``k`` centres by k-means||: PASSES passes, each taking rows with a chance in proportion to their distance.

    The chance of a row comes from a hash of seed, pass and vector, so equal rows are taken together (and count once).
    The rows taken, some OVERSAMPLING * k a pass, are weighted by the rows nearest to them and reduced to k by the same rule.
    """
    hash_ = F.xxhash64(F.lit(seed), "q")
    first = vectors.orderBy(hash_, "q").select("q").limit(1).collect()
    if not first:
        return np.zeros((0, dims))
    centres = np.array([first[0]["q"]], float)

    def total(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
        far, n = 0, np.zeros(len(held), np.int64)
        for batch in batches:
            best, product = _nearest(_matrix(batch, dims), held)
            far += int(_far(product).sum())
            n += np.bincount(best, minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array([far]), pa.array([n.tolist()], pa.list_(pa.int64()))], ["far", "n"])

    for turn in range(PASSES):
        cost = vectors.select("q").mapInArrow(lambda b, c=centres: total(b, c), "far long, n array<long>").agg(F.sum(F.col("far").cast("decimal(38,0)"))).first()[0]
        if not cost:
            break
        rate = OVERSAMPLING * k / float(cost)

        def take(batches: Iterator[pa.RecordBatch], held=centres, rate=rate) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, product = _nearest(_matrix(batch, dims), held)
                luck = batch.column("luck").to_numpy()
                kept = np.flatnonzero(luck < rate * _far(product))
                if len(kept):
                    yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(kept))], ["q"])

        luck = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), "q"), 11) / F.lit(float(1 << 53))).alias("luck")
        taken = sorted(tuple(r["q"]) for r in vectors.select("q", luck).mapInArrow(take, "q array<int>").distinct().collect())  # some 2k rows
        if taken:
            centres = np.vstack([centres, np.array(taken, float)])
    parts = vectors.select("q").mapInArrow(lambda b, c=centres: total(b, c), "far long, n array<long>").select(F.posexplode("n").alias("place", "n"))
    weight = np.zeros(len(centres))
    for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        weight[r["place"]] = r["n"]
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(centres)):
        far = _far(_nearest(centres, centres[chosen])[1]) * weight
        if not far.any():
            break
        chosen.append(int(rng.choice(len(centres), p=far / far.sum())))
    return centres[chosen]


def spherical_kmeans(vectors: DataFrame, k: int, dims: int, seed: int = 0, iterations: int = ITERATIONS, tolerance: float = 1e-4) -> tuple[np.ndarray, list[int]]:
    """(centres, inertia before each step and at the end): stops when inertia falls by less than ``tolerance`` of itself.

    Inertia is the sum of 1 - cosine to the nearest centre, in multiples of 2**-26.  A step replaces each centre by the
    direction of the sum of its rows (one without rows stays), unless that, once rounded, would raise inertia.
    """
    centres = seeds(vectors, k, dims, seed)
    history: list[int] = []
    if not len(centres):
        return centres, history

    def sums(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
        far, total, n = 0, np.zeros((len(held), dims), np.int64), np.zeros(len(held), np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            best, product = _nearest(x, held)
            far += int(_far(product).sum())
            for c in np.unique(best).tolist():
                total[c] += x[best == c].sum(0).astype(np.int64)
            n += np.bincount(best, minlength=len(held))
        rows = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, rows]), pa.array([[far], *total[rows].tolist()], pa.list_(pa.int64()))], ["cluster", "total"])

    best = centres
    for _ in range(iterations + 1):
        parts = vectors.select("q").mapInArrow(lambda b, c=centres: sums(b, c), "cluster long, total array<long>")
        added = parts.select("cluster", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect()  # k * dims numbers
        total = np.zeros((len(centres), dims))
        inertia = 0
        for r in added:
            if r["cluster"] < 0:
                inertia = r["x"]
            else:
                total[r["cluster"], r["at"]] = r["x"]
        if history and inertia > history[-1]:
            break
        settled = bool(history) and history[-1] - inertia < tolerance * max(1, history[-1])
        history.append(inertia)
        best = centres
        if settled:
            break
        moved = unit(total)
        centres = np.where(moved.any(1, keepdims=True), moved, centres)
    return best, history


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster, similarity, margin): each row's nearest centre, and by how much it is nearer than the second."""
    dims = centres.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                product = _matrix(batch, dims) @ centres.T / float(ONE) ** 2
                best = product.argmax(1)
                top = product[np.arange(len(best)), best]
                product[np.arange(len(best)), best] = -2.0
                second = product.max(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(top), pa.array(np.where(second < -1.5, 0.0, top - second))], ["id", "cluster", "similarity", "margin"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(nearest, f"id {kind}, cluster int, similarity double, margin double")


def topic_clusters(vectors: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """(id, cluster, similarity, margin) of every vector, by as many topics as ``topic_count`` gives for all rows.

    Clusters are numbered by falling size.  An empty table gives no rows; equal vectors share a cluster.
    """
    kept = materialize(vectors, "unit-vectors")
    rows = kept.count()
    if not rows:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("margin"))
    centres, _ = spherical_kmeans(kept, topic_count(rows), dims, seed)
    found = materialize(assign(kept, centres), "clusters")
    order = {r["cluster"]: i for i, r in enumerate(found.groupBy("cluster").count().orderBy(F.desc("count"), "cluster").collect())}
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    discard(kept)
    return found.withColumn("cluster", number[F.col("cluster")])


def cluster_report(found: DataFrame) -> DataFrame:
    """cluster, rows, coherence (mean similarity to the centre) and separation (mean margin to the next centre)."""
    return found.groupBy("cluster").agg(F.count("*").alias("rows"), F.round(F.avg("similarity"), 6).alias("coherence"), F.round(F.avg("margin"), 6).alias("separation"))


def cluster_words(df: DataFrame, id_: str, text: str, found: DataFrame, top: int = 5) -> DataFrame:
    """cluster, word, n, weight: the ``top`` words of each cluster by their share in it times log(1 + mean / all occurrences)."""
    from pyspark.sql import Window

    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0)))
    seen = df.select(F.col(id_).alias("id"), words.alias("word")).join(found.select("id", "cluster"), "id").groupBy("cluster", "word").agg(F.count("*").alias("n"))
    seen = materialize(seen, "cluster-words")
    size = seen.groupBy("cluster").agg(F.sum("n").alias("size"))
    every = seen.groupBy("word").agg(F.sum("n").alias("all"))
    mean = size.agg(F.avg("size").alias("mean"))
    weighed = seen.join(every, "word").join(F.broadcast(size), "cluster").crossJoin(F.broadcast(mean))  # a row for each cluster, and one
    weighed = weighed.withColumn("weight", F.round(F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("all")), 9))
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "word")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster", "rank", "word", "n", "weight")
