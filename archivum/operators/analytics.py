"""Aggregates, daily series, duplicates, comparison and retrieval over message-like tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators.durable import materialize


def top_k(df: DataFrame, key: str, k: int, out: str = "n") -> DataFrame:
    """The k most frequent keys, ties by key; a partial top-k in each task."""
    return df.groupBy(key).agg(F.count("*").alias(out)).orderBy(F.desc(out), key).limit(k)


def top_k_with_rest(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys, and one row (null key) for all others: their number of keys and rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(k)
    rest = counts.join(F.broadcast(top.select(key)), key, "left_anti").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.select(key, F.lit(1).cast("long").alias("keys"), "n").unionByName(rest.select(F.lit(None).cast(df.schema[key].dataType).alias(key), "keys", "n"))


def daily(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, ts: str) -> DataFrame:
    """weekday (1 = Sunday) x three-hour slot, all 56 cells, zero-filled."""
    spark = df.sparkSession
    grid = spark.range(56).select((F.floor(F.col("id") / 8) + 1).cast("int").alias("weekday"), (F.col("id") % 8).cast("int").alias("slot"))
    found = df.groupBy(F.dayofweek(ts).alias("weekday"), F.floor(F.hour(ts) / 3).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(found), ["weekday", "slot"], "left").select("weekday", "slot", F.coalesce("n", F.lit(0)).alias("n"))


def spikes(days: DataFrame, ratio: float = 2.0, least_days: int = 8) -> DataFrame:
    """Each active day's ratio to the mean of the seven active days before it; ``days`` has one row a day.

    The window runs over days, not messages: its size is the archive's span in days.
    """
    w = Window.orderBy("day")
    mean = F.avg("n").over(w.rowsBetween(-7, -1))
    seen = F.row_number().over(w)
    total = F.count("*").over(Window.partitionBy())
    share = F.when((seen > 7) & (total >= least_days), F.try_divide("n", mean))
    return days.select("day", "n", share.alias("ratio"), F.coalesce(share > ratio, F.lit(False)).alias("spike"))


def bursts(days: DataFrame, factor: float = 3.0, least_days: int = 7) -> DataFrame:
    """Days of more than ``factor`` times the mean of active days."""
    mean = days.agg(F.avg("n").alias("mean"), F.count("*").alias("days"))
    return days.crossJoin(F.broadcast(mean)).where((F.col("days") >= least_days) & (F.col("n") > factor * F.col("mean"))).select("day", "n", "mean")


def gaps(df: DataFrame, key: str, ts: str, least: int = 10) -> DataFrame:
    """Of each key, pauses longer than mean + 3 population deviations and than three days."""
    w = Window.partitionBy(key).orderBy(ts)
    step = df.select(key, F.col(ts).alias("until"), F.lag(ts).over(w).alias("since"))
    step = step.where("since is not null").withColumn("days", F.timestamp_diff("MICROSECOND", F.col("since"), F.col("until")) / 86_400_000_000)
    stats = step.groupBy(key).agg(F.avg("days").alias("mean"), F.stddev_pop("days").alias("sd"), F.count("*").alias("steps"))
    return step.join(stats, key).where((F.col("steps") + 1 >= least) & (F.col("days") > F.col("mean") + 3 * F.col("sd")) & (F.col("days") > 3)).select(key, "since", "until", "days")


def trend(days: DataFrame) -> DataFrame:
    """Direction of a series by least squares: increasing, decreasing, volatile or stable."""
    x = F.row_number().over(Window.orderBy("day")).cast("double")
    s = days.select(x.alias("x"), F.col("n").cast("double").alias("y")).agg(F.regr_slope("y", "x").alias("slope"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    rate = F.coalesce("slope", F.lit(0.0)) / F.greatest(F.lit(1.0), "mean")
    cv = F.try_divide("sd", "mean")
    return s.select(rate.alias("rate"), F.when(rate > 0.1, "increasing").when(rate < -0.1, "decreasing").when(cv > 0.5, "volatile").otherwise("stable").alias("direction"))


def new_since(df: DataFrame, key: str, ts: str, bound: Column) -> DataFrame:
    """Keys whose first row is not before the bound: one pass instead of a query for each."""
    return df.groupBy(key).agg(F.min(ts).alias("first"), F.count("*").alias("n")).where(F.col("first") >= bound)


def pair_volume(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of each unordered pair."""
    return df.groupBy(F.least(a, b).alias("one"), F.greatest(a, b).alias("other")).agg(F.count("*").alias("n"))


def exact_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows with the number of their copies and whether they are kept: the first of each group by ``order``.

    Groups are summed before any row moves; the row that stays is found by ``min_by``, so a group of copies of any size
    needs no single task.
    """
    first = F.min(F.struct(*order)).alias("first")
    groups = df.groupBy(*keys).agg(F.count("*").alias("copies"), first)
    joined = df.join(groups, keys)
    kept = joined["first"] == F.struct(*[F.col(c) for c in order])
    return joined.withColumn("kept", kept).drop("first")


def compare(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """One-to-one matching of two archives on a key, the n-th row of a key with the n-th: side is both, a or b."""
    number = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    left = number(a).select(key, "nth", F.col(order).alias("a_id"))
    right = number(b).select(key, "nth", F.col(order).alias("b_id"))
    both = left.join(right, [key, "nth"], "full_outer")
    side = F.when(F.col("a_id").isNull(), "b").when(F.col("b_id").isNull(), "a").otherwise("both")
    return both.select(key, "nth", side.alias("side"))


def nearest(df: DataFrame, id_: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to a query by cosine, ties by id; a top-k in each task."""
    from archivum.functions.mail import cosine

    target = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_, F.round(cosine(F.col(vector), target), 6).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), id_).limit(k)


def bm25(df: DataFrame, id_: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi scores of rows that hold a query word; corpus statistics over all rows, one pass of counts for each word."""
    from archivum.functions.mail import tokens

    words = df.select(id_, tokens(F.col(text)).alias("w"))
    held = lambda q: F.size(F.filter("w", lambda x: x == q))
    counts = [held(q).alias(f"tf_{i}") for i, q in enumerate(query)]
    rows = materialize(words.select(id_, F.size("w").alias("dl"), *counts), "counts")  # read twice: texts are split once
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query))])
    both = rows.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
        score = score + idf * F.col(f"tf_{i}") * (k1 + 1) / (F.col(f"tf_{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    return both.select(id_, F.round(score, 6).alias("score")).where("score > 0")


def reciprocal_rank_fusion(ranked: list[DataFrame], id_: str, rank: str = "rank", c: int = 60) -> DataFrame:
    """Sum of 1 / (c + rank) over ranked lists."""
    parts = [r.select(id_, (1.0 / (c + F.col(rank))).alias("part")) for r in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_).agg(F.sum("part").alias("score"))


def keyset_page(df: DataFrame, ts: str, id_: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page by (ts, id) descending that begins after a cursor."""
    if after is not None:
        t, i = F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1])
        df = df.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(id_) < i)))
    return df.orderBy(F.desc(ts), F.desc(id_)).limit(size)


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of (row, v): their numbers, and their vectors one after the other, scaled to length 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("row").to_numpy().tobytes()]), pa.array([v.tobytes()])], ["rows", "vectors"])

    return df.mapInArrow(pack, "rows binary, vectors binary")


def nearest_of_queries(df: DataFrame, queries: DataFrame, row: str, vector: str, k: int, digits: int = 6, block: int = 1000) -> DataFrame:
    """query, row, similarity, rank: of each query vector, the ``k`` rows of the highest cosine similarity (ties: smallest id).

    Rows and queries are packed into blocks of at most ``block`` each.  Blocks of rows are dealt out to groups, each of
    which gets all blocks of queries, so that a task holds one block of both at a time and nothing goes through the
    driver; of a pair of blocks only a query's k best (with ties) go on, and ranks are taken over those.
    """
    spark = df.sparkSession
    both = [x.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("v")).where("row is not null and v is not null") for x in (df, queries)]
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _packed(both[0], block).withColumn("group", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int"))
    asked = _packed(both[1], block).select(F.col("rows").alias("names"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors, names, q in zip(*[batch.column(c) for c in ("rows", "vectors", "names", "q")], strict=True):
                rows, names = (np.frombuffer(x.as_py(), np.int64) for x in (rows, names))
                vectors, q = (np.frombuffer(x.as_py()).reshape(len(n), -1) for x, n in ((vectors, rows), (q, names)))
                s = np.round(q @ vectors.T, digits)
                at = max(0, s.shape[1] - k)
                i, j = np.nonzero(s >= np.partition(s, at, axis=1)[:, at][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(rows[j]), pa.array(s[i, j])], ["query", "row", "similarity"])

    found = rows.join(asked, "group").select("rows", "vectors", "names", "q").mapInArrow(best, "query long, row long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weekdays(df: DataFrame, ts: str) -> DataFrame:
    """weekday (Sunday is 1), n: all seven, those without rows too; rows without a time don't count."""
    found = df.where(F.col(ts).isNotNull()).groupBy(F.dayofweek(ts).cast("long").alias("weekday")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(1, 8).select(F.col("id").alias("weekday")).join(F.broadcast(found), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def size_classes(df: DataFrame, size: Column) -> DataFrame:
    """bucket, n of all five size classes, those without rows too."""
    names = df.sparkSession.createDataFrame([(n,) for n, _ in mail.SIZES], "bucket string")
    counts = df.groupBy(mail.size_bucket(size).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_sweep(df: DataFrame, text: str, words: list[str]) -> DataFrame:
    """word, documents, hits of each word that occurs (as a part of words too, A-Z without case).

    A text is read once: its counts are an array, so no text is copied and each pattern is compiled once.
    """
    low = F.lower(text)
    counts = F.array(*(F.struct(F.lit(w).alias("word"), F.regexp_count(low, F.lit(re.escape(w.lower()))).alias("n")) for w in words))
    return df.select(F.inline(F.filter(counts, lambda x: x["n"] > 0))).groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("hits"))


def tally(df: DataFrame, parts: dict[str, Column], top: dict[str, int] | None = None) -> DataFrame:
    """kind, key, n: how often each key of each part occurs, in one pass and one shuffle; ``parts`` are arrays of strings.

    ``top`` keeps the most frequent keys of a part, ties by key.  Null and empty arrays count nothing.
    """

    def named(name: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda k: F.struct(F.lit(name).alias("kind"), k.alias("key")))

    every = F.flatten(F.array(*(named(name, c) for name, c in parts.items())))
    counts = df.select(F.inline(every)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    return most_frequent(counts, top) if top else counts


def most_frequent(counts: DataFrame, top: dict[str, int]) -> DataFrame:
    """Of (kind, key, n) the most frequent keys of each kind in ``top``, ties by key, and all rows of other kinds.

    Each kind's are taken by a limit, so every task passes on that many and no task sees all keys.
    """
    counts = materialize(counts, "counts")
    out = counts.where(~F.col("kind").isin(*top))
    for kind, most in top.items():
        out = out.unionByName(counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(most))
    return out


def grouped_counts(df: DataFrame, parts: dict[str, Column], top: dict[str, int] | None = None, total: str = "total") -> DataFrame:
    """kind, key, n: rows by each of several keys and in all, by grouping sets over one reading of the table.

    A row has one key of each part, null included (``key`` is null then); ``top`` as in ``most_frequent``.
    """
    keyed = df.select(*[c.cast("string").alias(n) for n, c in parts.items()])
    sets = keyed.groupingSets([[], *[[F.col(n)] for n in parts]], *parts).agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
    width = len(parts)
    every = F.lit((1 << width) - 1)
    kind = F.when(F.col("set") == every, F.lit(total))
    key = F.lit(None).cast("string")
    for i, name in enumerate(parts):
        own = F.col("set") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        kind, key = kind.when(own, name), F.when(own, F.col(name)).otherwise(key)
    counts = sets.select(kind.alias("kind"), key.alias("key"), "n")
    return most_frequent(counts, top) if top else counts


def anomalies(df: DataFrame, row: str, sender: str, ts: str, recipients: str, attachments: str, night: int = 5, most: int = 10, factor: float = 3.0) -> DataFrame:
    """kind, who, n: senders with more than ``night`` messages from 0 to 5 o'clock, messages to more than ``most``
    recipients, and messages with more attachments than three and ``factor`` times the mean of those that have any."""
    late = df.where(F.hour(ts).between(0, 5)).groupBy(F.col(sender).cast("string").alias("who")).agg(F.count("*").alias("n")).where(F.col("n") > night)
    many = df.where(F.col(recipients) > most).select(F.col(row).cast("string").alias("who"), F.col(recipients).cast("long").alias("n"))
    mean = df.where(F.col(attachments) > 0).agg(F.avg(attachments).alias("mean"))
    heavy = df.crossJoin(F.broadcast(mean)).where(F.col(attachments) > F.greatest(factor * F.col("mean"), F.lit(3.0))).select(F.col(row).cast("string").alias("who"), F.col(attachments).cast("long").alias("n"))
    out = late.select(F.lit("unusual hours").alias("kind"), "who", "n")
    for kind, found in (("many recipients", many), ("many attachments", heavy)):
        out = out.unionByName(found.select(F.lit(kind).alias("kind"), "who", "n"))
    return out


def in_period(ts: Column, period: str, now: datetime, since: datetime | None = None, until: datetime | None = None) -> Column:
    """Whether a time lies in ``today``, the last 7 days (``week``), the last 30 (``month``) or a ``custom`` period up to ``now``."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    begin = {"today": midnight, "week": now - timedelta(days=7), "month": now - timedelta(days=30), "custom": since}[period]
    end = min(until, now) if period == "custom" and until else now
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    return F.coalesce((ts >= stamp(begin) if begin else F.lit(True)) & (ts <= stamp(end)), F.lit(False))
