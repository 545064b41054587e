"""Archive upkeep over message-like tables: selection, matching, policies, tags, rules, topics, integrity, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.operators.durable import materialize

from archivum.functions.mail import tokens
from archivum.operators.review import number_rows


def newest(df: DataFrame, ts: str, id_: str, n: int) -> DataFrame:
    """The newest n rows by (ts, id): a partial top-n in each task."""
    return df.orderBy(F.desc(ts), F.desc(id_)).limit(n)


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key has at least ``least`` rows: counts are combined before the shuffle, then a semi join."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def one_to_one(a: DataFrame, b: DataFrame, key: str, id_: str) -> DataFrame:
    """Pairs (a_id, b_id) of equal keys, each row used once: the nth of a key meets the nth, in order of id."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(id_))
    left, right = (df.where(F.col(key).isNotNull()).select(key, F.col(id_).alias(out), nth.alias("_nth")) for df, out in ((a, "a_id"), (b, "b_id")))
    return left.join(right, [key, "_nth"]).select("a_id", "b_id")


def dedup_policy(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Add ``kept``: the first row in order of its key, the first of ``keys`` that isn't null; rows without any stay.

    The first row of a key is a minimum that is combined before the shuffle, so a crowded key costs one row a task.
    """
    keyed = df.withColumn("_key", F.coalesce(*keys))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_key", "left").withColumn("kept", F.coalesce(F.col(order) == F.col("_first"), F.lit(True))).drop("_key", "_first")


def add_tags(tags: DataFrame, rows: DataFrame, id_: str, tag: str) -> DataFrame:
    """``tags`` (id, tag) with a tag for all rows; adding it again changes nothing."""
    return tags.select(id_, "tag").unionByName(rows.select(id_, F.lit(tag).alias("tag"))).distinct()


def remove_tags(tags: DataFrame, rows: DataFrame, id_: str, tag: str) -> DataFrame:
    """``tags`` without a tag of the rows."""
    return tags.join(rows.select(id_, F.lit(tag).alias("tag")), [id_, "tag"], "left_anti")


def apply_rules(df: DataFrame, rules: list[tuple[list[Column], str]], out: str = "actions") -> DataFrame:
    """Add the actions of the rules that fire (one of a rule's conditions holds), each once, in the order of the rules."""
    fired = [F.when(F.greatest(*[F.coalesce(c, F.lit(False)) for c in when], F.lit(False)), action) for when, action in rules]
    return df.withColumn(out, F.array_distinct(F.array_compact(F.array(*fired))))


def expand_threads(df: DataFrame, hits: DataFrame, thread: str) -> DataFrame:
    """All rows of the threads that have a hit."""
    return df.join(hits.select(thread).distinct(), thread, "left_semi")


def topics(df: DataFrame, id_: str, text: str, stop: list[str], k: int = 5, shortest: int = 4) -> DataFrame:
    """The k words of each row with the largest count x ln(rows / rows with it): seen twice at least, in under 7 rows of 10.

    A row's text is counted inside the row, so only its distinct words are shuffled.
    """
    rows = df.count()
    kept = F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: (F.length(w) >= shortest) & ~w.isin(stop))
    each = df.select(id_, F.explode(kept).alias("word")).groupBy(id_, "word").agg(F.count("*").alias("n"))
    spread = each.groupBy("word").agg(F.count("*").alias("rows")).where(F.col("rows") < F.floor(F.lit(0.7 * rows)))
    scored = each.where("n >= 2").join(spread, "word").withColumn("score", F.col("n") * F.log(F.lit(rows) / F.col("rows")))
    place = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(F.round("score", 9)), "word"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(id_, "place", "word", "score")


def integrity_tree(df: DataFrame, id_: str, content: str, digits: int = 4, levels: int = 1) -> DataFrame:
    """(node, hash): nodes over the leaves by their first hex digits, ``levels`` of ``digits`` digits each, and ``root``.

    A leaf is SHA-256 of the id and the content's SHA-256; a node is that of its children in order.  No node has more
    than 16 ** ``digits`` children above the lowest level; choose ``levels`` so that a lowest node's leaves fit a task.
    """
    inner = F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)
    leaf = F.sha2(F.concat_ws(":", F.col(id_).cast("string"), inner).cast("binary"), 256)
    over = lambda c: F.sha2(F.array_join(c, "").cast("binary"), 256)
    level = df.select(leaf.alias("leaf")).groupBy(F.substring("leaf", 1, digits * levels).alias("node")).agg(over(F.sort_array(F.collect_list("leaf"))).alias("hash"))
    level = out = materialize(level, "tree")  # every level above reads it
    for k in range(levels - 1, -1, -1):
        name = F.substring("node", 1, digits * k) if k else F.lit("root")
        level = level.groupBy(name.alias("up")).agg(over(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda b: b["hash"])).alias("hash")).withColumnRenamed("up", "node")
        out = out.unionByName(level)
    return out


def verify_tree(df: DataFrame, tree: DataFrame, id_: str, content: str, digits: int = 4, levels: int = 1) -> DataFrame:
    """node, was, is_now of the nodes that differ from a stored ``tree``; none if nothing was changed, added or lost."""
    now = integrity_tree(df, id_, content, digits, levels).withColumnRenamed("hash", "is_now")
    both = tree.withColumnRenamed("hash", "was").join(now, "node", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is_now")))


def review_batches(df: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Add ``batch`` (from 0): runs of ``size`` rows by ``order``, which must name every row uniquely."""
    return number_rows(df, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def tone_shift(df: DataFrame, key: str, order: str, tone: str, drop: float, least: int = 10) -> DataFrame:
    """Keys with ``least`` rows or more whose mean tone falls by more than ``drop`` from their first half to their second."""
    placed = df.select(key, tone, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("at"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    half = F.floor(F.col("n") / 2)
    out = placed.groupBy(key).agg(F.max("n").alias("n"), F.avg(F.when(F.col("at") <= half, F.col(tone))).alias("before"), F.avg(F.when(F.col("at") > half, F.col(tone))).alias("after"))
    return out.where((F.col("n") >= least) & (F.col("before") - F.col("after") > drop))


def missing_or_stale(rows: DataFrame, derived: DataFrame, id_: str, version: str) -> DataFrame:
    """Rows that no derived record of at least their version covers: the work of an incremental run."""
    done = derived.select(F.col(id_).alias("_id"), F.col(version).alias("_v"))
    return rows.join(done, (F.col(id_) == F.col("_id")) & (F.col("_v") >= F.col(version)), "left_anti")


def ego_contacts(df: DataFrame, me: str, sender: str, recipient: str, ts: str, k: int = 40) -> DataFrame:
    """Whom ``me`` writes to and hears from: sent, received and last time of the k busiest, ties by name."""
    mine = (F.col(sender) == me) | (F.col(recipient) == me)
    other = F.when(F.col(sender) == me, F.col(recipient)).otherwise(F.col(sender))
    found = df.where(mine & (F.col(sender) != F.col(recipient))).groupBy(other.alias("contact"))
    counted = found.agg(F.count_if(F.col(sender) == me).alias("sent"), F.count_if(F.col(recipient) == me).alias("received"), F.max(ts).alias("last"))
    return counted.orderBy(F.desc(F.col("sent") + F.col("received")), "contact").limit(k)
