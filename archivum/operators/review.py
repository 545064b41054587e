"""Numbering, sampling, review, contacts, predictive coding and graphs over message-like tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.functions.mail import PATTERNS, cosine, findings, tokens
from archivum.operators.durable import checkpoint, materialize


def number_rows(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Number all rows from 1 by ``order``, which must name every row uniquely, without one task that sees them all.

    Rows are dealt out by ranges and written to the checkpoint folder, so that a lost task can't change the ranges; each
    range is numbered by itself and shifted by the rows of the ranges before it (one row a range goes through one task).
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(shift), "_range").withColumn(out, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def number_within(df: DataFrame, key: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Number the rows of each ``key`` from 1 by ``order``; both together must name every row uniquely.

    All rows are numbered by ranges and a key's first number is taken off, so a key of very many rows is no task of its own.
    """
    numbered = number_rows(df, [*key, *order], "_all")
    first = numbered.groupBy(*key).agg(F.min("_all").alias("_first"))
    return numbered.join(first, key).withColumn(out, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")


def stamp(df: DataFrame, order: list[str], prefix: str, digits: int = 8, start: int = 1) -> DataFrame:
    """Add ``label``: prefix and running number by ``order``."""
    number = (F.col("_n") + (start - 1)).cast("string")
    return number_rows(df, order, "_n").withColumn("label", F.concat(F.lit(prefix), F.lpad(number, digits, "0"))).drop("_n")


def even_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Every k-th row in order, k = max(1, rows // size), at most ``size`` rows."""
    step = max(1, df.count() // size)
    return number_rows(df, order, "_n").where(((F.col("_n") - 1) % step == 0) & (F.col("_n") <= step * size)).drop("_n")


def new_keys(df: DataFrame, key: str, order: list[str], least: int = 3) -> DataFrame:
    """Keys that occur at least ``least`` times in the newest tenth of rows and never before; none under ten rows."""
    rows = df.count()
    newest = max(rows // 10, 1)
    found = number_rows(df.select(key, *order), order, "_n").groupBy(key).agg(F.count("*").alias("hits"), F.min("_n").alias("first"))
    return found.where((F.col("first") > rows - newest) & (F.col("hits") >= least) & F.lit(rows >= 10)).select(key, "hits")


def volume_trend(months: DataFrame) -> DataFrame:
    """``months`` (month, n; one row a month) -> means of the last three and of the earlier ones; no row under three."""
    w = Window.orderBy("month")
    placed = months.select("n", F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy()).alias("all"))
    out = placed.where("all >= 3").agg(F.avg(F.when(F.col("at") > F.col("all") - 3, F.col("n"))).alias("recent"), F.avg(F.when(F.col("at") <= F.greatest(F.lit(1), F.col("all") - 3), F.col("n"))).alias("earlier"))
    return out.where("recent is not null").select("recent", "earlier", (F.try_divide(F.col("recent") - F.col("earlier"), F.col("earlier"))).alias("change"))


def routines(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys with at least four rows that fall on at most two weekdays, or with at least eight."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.dayofweek(ts)).alias("weekdays"))
    return found.where("n >= 4 and (weekdays <= 2 or n >= 8)")


def reply_times(df: DataFrame, replies: DataFrame, id_: str, ts: str, reply_to: str, reply_ts: str, by: str) -> DataFrame:
    """Mean hours from a row to its replies, of those within 30 days; of repeated ids the latest row answers."""
    first = df.groupBy(F.col(id_).alias("_id")).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(by).alias("by"))).alias("o"))
    hours = (F.timestamp_diff("SECOND", F.col("o.t"), F.col(reply_ts)) / 3600).alias("hours")
    pairs = replies.select(reply_to, reply_ts).join(first, F.col(reply_to) == F.col("_id")).select(F.col("o.by").alias(by), hours)
    return pairs.where("hours > 0 and hours < 720").groupBy(by).agg(F.count("*").alias("replies"), F.avg("hours").alias("hours"))


def contacts(df: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """First, last, number and activity: 0.6 x min(n / 50, 1) + 0.4 x max(0, 1 - days since the last / 365)."""
    days = F.timestamp_diff("DAY", F.col("last"), now)
    score = 0.6 * F.least(F.col("n") / 50, F.lit(1.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - days / 365)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn("activity", score)


def cleanup(df: DataFrame, text: str, large: int = 100_000) -> DataFrame:
    """Rows, repeated texts beyond the first, large texts and empty ones; texts are compared by SHA-256."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    part = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.length(text) > large).alias("large"), F.count_if(blank).alias("blank"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return part.agg(whole("n").alias("rows"), whole(F.col("n") - 1).alias("duplicates"), whole("large").alias("large"), whole("blank").alias("blank"))


def indicators(df: DataFrame, id_: str, text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Distinct indicators, lower-cased, with the number of rows that hold them: distinct in the row before the shuffle."""
    def found(kind: str) -> Column:
        values = F.array_distinct(F.transform(findings(F.col(text), kind), F.lower))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = F.explode(F.flatten(F.array(*[found(k) for k in kinds])))
    return df.select(id_, each.alias("f")).groupBy("f.kind", "f.value").agg(F.count("*").alias("documents"))


def responsiveness(df: DataFrame, id_: str, subject: Column, body: Column, weights: dict[str, float]) -> DataFrame:
    """Sum over terms of weight x min(occurrences, 5), plus 2 for a subject that holds it, over 5 a term; at most 1."""
    score = F.lit(0.0)
    for term, w in weights.items():
        hits = F.regexp_count(F.lower(F.coalesce(body, F.lit(""))), F.lit(r"\Q" + term.lower() + r"\E"))
        score = score + F.least(hits, F.lit(5)) * float(w) + F.when(F.contains(F.lower(F.coalesce(subject, F.lit(""))), F.lit(term.lower())), 2.0).otherwise(0.0)
    return df.select(id_, F.least(score / (5 * len(weights)), F.lit(1.0)).alias("score"))


def naive_bayes(df: DataFrame, codes: DataFrame, id_: str, text: str, code: str) -> DataFrame:
    """Log odds of code 1 for every row, from the words of the coded rows, each word counted once a row, smoothed by 1.

    Words that no coded row holds tell nothing.  The word model is joined by a shuffle; a very common word is a skewed key
    whose partition adaptive execution splits.
    """
    words = df.select(id_, F.explode(F.array_distinct(tokens(F.coalesce(text, F.lit(""))))).alias("w"))
    coded = words.join(codes.where(F.col(code).isNotNull()).select(id_, F.col(code).alias("_c")), id_)
    counts = coded.groupBy("w").agg(F.count_if(F.col("_c") == 1).alias("yes"), F.count_if(F.col("_c") == 0).alias("no"))
    total = counts.agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), F.count("*").alias("v"))
    weight = F.log((F.col("yes") + 1) / (F.col("all_yes") + F.col("v"))) - F.log((F.col("no") + 1) / (F.col("all_no") + F.col("v")))
    model = counts.crossJoin(F.broadcast(total)).select("w", weight.alias("weight"))
    prior = codes.agg((F.log(F.count_if(F.col(code) == 1) + 1) - F.log(F.count_if(F.col(code) == 0) + 1)).alias("prior"))
    sums = words.join(model, "w").groupBy(id_).agg(F.sum("weight").alias("s"))
    return df.select(id_).join(sums, id_, "left").crossJoin(F.broadcast(prior)).select(id_, (F.coalesce("s", F.lit(0.0)) + F.col("prior")).alias("log_odds"))


def _word_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, w, tf of rows (id, words with one space between) in order of id: a word's count over the id's greatest count."""
    held: list[list] = [[], [], []]
    schema, last, counts = None, None, Counter()

    def flush() -> None:
        most = max(counts.values(), default=1)
        held[0].extend([last] * len(counts))
        held[1].extend(counts)
        held[2].extend(n / most for n in counts.values())

    for batch in batches:
        schema = pa.schema([batch.schema.field(0), ("w", pa.string()), ("tf", pa.float64())])
        for id_, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if id_ != last:
                flush()
                last, counts = id_, Counter()
                if len(held[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, schema.types, strict=True)], schema=schema)
                    held = [[], [], []]
            counts.update(w for w in words.split(" ") if len(w) >= 2)
    if schema is not None:
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, schema.types, strict=True)], schema=schema)


def predictive_coding(df: DataFrame, codes: DataFrame, id_: str, text: str, code: str, vectors: DataFrame, vector: str) -> DataFrame:
    """bayes, cosine and score (0.6 of one, 0.4 of the other) of every row, learned from the rows coded 1 and 0.

    bayes: naive Bayes over words of two letters or more, a row's word weighing its count over the row's greatest count
    times ln(rows / (rows with it + 1)) + 1, sums smoothed by 1; words that no coded row has count by the smoothing alone.
    cosine: likeness to the mean vector of the relevant rows less that of the others, brought to 0 to 1; 0.5 for rows
    without a vector.  Whole texts are read, once: they are dealt out by id, and repeated ids are counted together.  Word rows
    are shuffled once, to meet the word model, by a join that adaptive execution can split; what must be broadcast is one row.
    """
    coded = codes.where(F.col(code).isin(0, 1)).groupBy(id_).agg(F.max(code).alias("_c"))
    # texts are dealt out by id once and counted id by id; the words of a partition are never held together
    words = F.array_join(tokens(F.coalesce(text, F.lit(""))), " ")
    dealt = df.select(id_, words.alias("words")).where(F.col(id_).isNotNull()).repartition(id_).sortWithinPartitions(id_)
    schema = T.StructType([T.StructField(id_, df.schema[id_].dataType), T.StructField("w", T.StringType()), T.StructField("tf", T.DoubleType())])
    tf = materialize(dealt.mapInArrow(_word_shares, schema), "terms")
    # a row's weight of a word is tf times the word's idf, so all sums by word are those of tf, combined before the shuffle
    part = lambda c: F.sum(F.when(F.col("_c") == c, F.col("tf")))
    by_word = tf.join(coded, id_, "left").groupBy("w").agg(F.count("*").alias("rows"), F.count("_c").alias("coded"), part(1).alias("yes"), part(0).alias("no"))
    every = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("all"))
    idf = F.log(F.col("all") / (F.col("rows") + 1)) + 1
    model = by_word.crossJoin(F.broadcast(every)).select("w", "coded", idf.alias("idf"), *((F.coalesce(c, F.lit(0.0)) * idf).alias(c) for c in ("yes", "no")))
    model = materialize(model, "words")
    words = F.greatest(F.count("*"), F.lit(1))
    totals = model.where("coded > 0").agg((F.coalesce(F.sum("yes"), F.lit(0.0)) + words).alias("all_yes"), (F.coalesce(F.sum("no"), F.lit(0.0)) + words).alias("all_no"))
    relevant, others = F.greatest(F.count_if(F.col("_c") == 1), F.lit(1)), F.greatest(F.count_if(F.col("_c") == 0), F.lit(1))
    prior = coded.agg((F.log(relevant) - F.log(others)).alias("prior"))
    lean = F.col("idf") * (F.log(F.col("yes") + 1) - F.log(F.col("no") + 1))
    each = tf.join(model.select("w", "idf", lean.alias("lean")), "w").groupBy(id_).agg(F.sum(F.col("tf") * F.col("lean")).alias("s"), F.sum(F.col("tf") * F.col("idf")).alias("weight"))
    odds = F.coalesce("s", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)) * (F.log("all_yes") - F.log("all_no")) + F.col("prior")
    bayes = df.select(id_).join(each, id_, "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(prior)).select(id_, (1 / (1 + F.exp(-odds))).alias("bayes"))
    mean = centroids(vectors.join(coded, id_), "_c", vector)
    means = mean.agg(F.max(F.when(F.col("_c") == 1, F.col("centre"))).alias("yes"), F.max(F.when(F.col("_c") == 0, F.col("centre"))).alias("no"))
    apart = (cosine(F.col(vector), F.col("yes")) - F.coalesce(cosine(F.col(vector), F.col("no")), F.lit(0.0)) + 1) / 2
    near = vectors.crossJoin(F.broadcast(means)).select(id_, apart.alias("apart")).where("apart is not null").select(id_, F.greatest(F.least("apart", F.lit(1.0)), F.lit(0.0)).alias("cosine"))
    out = bayes.join(near, id_, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.5)))
    return out.withColumn("score", F.col("bayes") * 0.6 + F.col("cosine") * 0.4)


def uncertain(predictions: DataFrame, codes: DataFrame, id_: str, k: int = 20) -> DataFrame:
    """The k uncoded rows whose score, between 0.25 and 0.75, is nearest to 0.5; ties by id."""
    open_ = predictions.where("score > 0.25 and score < 0.75").join(codes.select(id_), id_, "left_anti")
    return open_.orderBy(F.round(F.abs(F.col("score") - 0.5), 6), id_).limit(k)


def coding_quality(predictions: DataFrame, codes: DataFrame, id_: str, code: str) -> DataFrame:
    """f1 over the coded rows (null unless both codes occur, or nothing is found right) and richness, the share above 0.5."""
    both = predictions.join(codes.where(F.col(code).isin(0, 1)).groupBy(id_).agg(F.max(code).alias("_c")), id_, "left")
    yes, found = F.col("_c") == 1, F.col("score") > 0.5
    n = both.agg(F.count_if(yes & found).alias("tp"), F.count_if((F.col("_c") == 0) & found).alias("fp"), F.count_if(yes & ~found).alias("fn"), F.count_if(F.col("_c") == 0).alias("no"), F.avg(found.cast("double")).alias("richness"))
    f1 = F.when((F.col("tp") > 0) & (F.col("no") > 0), 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return n.select(f1.alias("f1"), F.coalesce("richness", F.lit(0.0)).alias("richness"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label: (label, place, mean) sums are combined before the shuffle."""
    each = df.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda p: p["mean"]).alias("centre"))


def nearest_centroid(df: DataFrame, id_: str, vector: str, centres: DataFrame, label: str, most: int = 1000) -> DataFrame:
    """The nearest of at most ``most`` centroids by cosine; ties go to the smallest label."""
    held = centres.select(label, "centre").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} centroids")
    table = F.array(*[F.struct(F.lit(r[0]).alias("label"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("centre")) for r in held])
    best = F.array_max(F.transform(table, lambda c: F.struct(F.round(cosine(F.col(vector), c["centre"]), 6).alias("similarity"), (-c["label"]).alias("tie"))))
    return df.select(id_, (-best["tie"]).alias(label), best["similarity"].alias("similarity"))


def edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected weighted edges (a, b, weight), both ways round; weights add up on repeats."""
    one = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("w")).where("a != b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def hops(graph: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of the start nodes (column ``node``), with their distance: one join a step.

    Each step is written, so lineage stays short and a small front is known to be small: then the graph is read and not
    shuffled.  Edges may repeat (weights don't matter) and must hold both directions; a shortest path's length is the
    distance of its end.
    """
    seen = fresh = materialize(start.select("node", F.lit(0).alias("distance")), "hops")
    for step in range(1, depth + 1):
        found = graph.select("a", "b").join(fresh.select("node").distinct(), F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = materialize(found.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step)), "hops")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def merge_codes(decisions: DataFrame, state: DataFrame, id_: str) -> DataFrame:
    """Review answers against the archive: applied, same, conflict (the stored code stays) or absent (no such row)."""
    both = decisions.select(id_, F.col("code").alias("new")).join(state.select(id_, "code", F.lit(True).alias("known")), id_, "left")
    outcome = F.when(F.col("known").isNull(), "absent").when(F.col("code").isNull(), "applied").when(F.col("code") == F.col("new"), "same").otherwise("conflict")
    return both.select(id_, F.coalesce("code", "new").alias("code"), outcome.alias("outcome"))
