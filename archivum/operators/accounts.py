"""Accounts that look taken over, health of sender checks, how threads will end, bridges, regular expressions, page cursors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from archivum.operators.review import number_within


def compromised(df: DataFrame, row: str, account: str, ts: str, recipients: str, tone_shift: Column, least: int = 5) -> DataFrame:
    """account, n, confidence, indicators, since, until of accounts with ``least`` messages or more and a confidence of 0.3 or more.

    ``recipients``: array of addresses; ``tone_shift``: whether a message is part of one.  Points and bounds are fixed values:
    0.25 for three messages or more from midnight to five; 0.2 for a tone shift; 0.3 if, of ten dated messages or more, those of the
    later half reach five recipients or more whom the earlier half doesn't, and more than half as many as it reaches; 0.2 if three
    or more of the last twenty have more than ten recipients.  Messages are numbered by ranges, so an account with very many is no
    task of its own; only distinct (account, recipient) pairs are brought together.
    """
    to = F.array_distinct(F.coalesce(recipients, F.array().cast("array<string>")))
    rows = df.where(F.col(account).isNotNull() & (F.col(account) != "")).select(F.col(row).alias("row"), F.col(account).alias("account"), F.col(ts).alias("ts"), to.alias("to"), F.coalesce(tone_shift, F.lit(False)).alias("shift"))
    every = rows.groupBy("account").agg(F.count("*").alias("n"), F.count("ts").alias("dated"), F.count_if(F.hour("ts") < 5).alias("night"), F.max("shift").alias("shift"), F.min("ts").alias("since"), F.max("ts").alias("until")).where(F.col("n") >= least)
    placed = number_within(rows.where("ts is not null").select("row", "account", "ts", "to"), ["account"], ["ts", "row"], "at").join(every.select("account", "dated"), "account")
    wide = placed.where("at > dated - 20 and size(to) > 10").groupBy("account").agg(F.count("*").alias("wide"))
    half = F.floor(F.col("dated") / 2)
    pairs = placed.where("dated >= 10").select("account", F.explode("to").alias("to"), (F.col("at") <= half).alias("early")).groupBy("account", "to").agg(F.max("early").alias("early"))
    reach = pairs.groupBy("account").agg(F.count_if("early").alias("known"), F.count_if(~F.col("early")).alias("new"))
    found = every.join(wide, "account", "left").join(reach, "account", "left")
    signs = [(F.col("night") >= 3, 0.25, "hours"), (F.col("shift"), 0.2, "tone"), ((F.col("new") >= 5) & (F.col("known") > 0) & (F.col("new") / F.col("known") > 0.5), 0.3, "recipients"), (F.col("wide") >= 3, 0.2, "groups")]
    confidence = sum((F.when(c, p).otherwise(0.0) for c, p, _ in signs), F.lit(0.0))
    indicators = F.array_compact(F.array(*[F.when(c, n) for c, _, n in signs]))
    return found.select("account", "n", F.round(F.least(F.lit(1.0), confidence), 6).alias("confidence"), indicators.alias("indicators"), "since", "until").where("confidence >= 0.3")


def authentication_health(df: DataFrame, authentication: Column, key: str | None = None) -> DataFrame:
    """checks and passes of SPF, DKIM and DMARC, and health (passes over checks, null without checks), in all or for each ``key``."""
    text = F.lower(F.coalesce(authentication, F.lit("")))
    checks = sum((text.contains(f"{n}=").cast("int") for n in ("spf", "dkim", "dmarc")), F.lit(0))
    passes = sum((text.contains(f"{n}=pass").cast("int") for n in ("spf", "dkim", "dmarc")), F.lit(0))
    found = df.groupBy(*([key] if key else [])).agg(F.sum(checks).cast("long").alias("checks"), F.sum(passes).cast("long").alias("passes"))
    return found.withColumn("health", F.round(F.try_divide("passes", "checks"), 6))


def thread_outcomes(df: DataFrame, thread: str, row: str, sender: str, ts: str, tone: str, now: Column, newest: int = 20, least: int = 3) -> DataFrame:
    """thread, n, outcome, confidence, trajectory of the ``newest`` threads with ``least`` messages or more.

    The later half of a thread's messages is compared with the earlier one by mean tone, and by how many of its senders still
    write.  More than 14 days without a message: resolved; more than 7 with less than half of the senders: stalled; a tone
    that falls by more than 0.3 to below -0.2: conflict; one that rises by more than 0.2 to above 0.1: consensus; else active.
    Bounds and confidences are fixed values.  A message without a time comes first and has no age.
    """
    size = df.groupBy(thread).agg(F.count("*").alias("n"), F.max(ts).alias("last")).where(F.col("n") >= least)
    kept = size.orderBy(F.desc_nulls_last("last"), thread).limit(newest)
    rows = df.join(F.broadcast(kept), thread)  # at most ``newest`` threads
    order = Window.partitionBy(thread).orderBy(F.asc_nulls_first(ts), row)
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    placed = rows.withColumn("at", F.row_number().over(order)).select(thread, "n", "last", F.lower(sender).alias("who"), F.col(tone).alias("tone"), (F.col("at") <= half).alias("older"), (F.col("at") > F.col("n") - half).alias("recent"))
    found = placed.groupBy(thread).agg(F.first("n").alias("n"), F.first("last").alias("last"), F.avg(F.when(F.col("older"), F.col("tone"))).alias("was"), F.avg(F.when(F.col("recent"), F.col("tone"))).alias("is_now"), F.countDistinct("who").alias("all"), F.countDistinct(F.when(F.col("recent"), F.col("who"))).alias("active"))
    delta, age = F.col("is_now") - F.col("was"), F.coalesce(F.floor(F.timestamp_diff("SECOND", F.col("last"), now) / 86_400), F.lit(999))
    engaged = F.coalesce(F.try_divide("active", "all"), F.lit(0.0))
    conflict, consensus = (delta < -0.3) & (F.col("is_now") < -0.2), (delta > 0.2) & (F.col("is_now") > 0.1)
    outcome = F.when(age > 14, "resolved").when((age > 7) & (engaged < 0.5), "stalled").when(conflict, "conflict").when(consensus, "consensus").otherwise("active")
    sure = F.when(age > 14, 0.6).when((age > 7) & (engaged < 0.5), 0.7).when(conflict | consensus, F.least(0.5 + F.abs(delta), F.lit(0.9))).otherwise(0.5)
    trajectory = F.when(delta > 0.15, "improving").when(delta < -0.15, "declining").otherwise("stable")
    return found.select(thread, "n", outcome.alias("outcome"), F.round(sure, 6).alias("confidence"), trajectory.alias("trajectory"))


def bridges(edges: DataFrame, domain: Column, top: int = 3, least: int = 3, each: int = 2) -> DataFrame:
    """node, domains: the ``top`` nodes whose neighbours (``b``) come from ``least`` domains or more, ``each`` or more of each; ties by node."""
    near = edges.where("a != b").select("a", "b").distinct().withColumn("domain", domain).where(F.col("domain").isNotNull())
    wide = near.groupBy("a", "domain").agg(F.count("*").alias("n")).where(F.col("n") >= each)
    return wide.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("domains")).where(F.col("domains") >= least).orderBy(F.desc("domains"), "node").limit(top)


#: Longest pattern that is searched for.
LONGEST = 1000


def regex_search(df: DataFrame, line: str, fields: list[str]) -> DataFrame:
    """Rows whose ``fields``, joined by line feeds, hold a pattern, any case: ``/…/`` is a regular expression, else ``*`` stands for anything in a line.

    A pattern of more than LONGEST characters, an empty or an invalid one finds nothing.
    """
    from archivum.functions.mail import readable_rules

    pattern = line[1:-1] if len(line) > 1 and line[0] == line[-1] == "/" else ".*".join(re.escape(p) for p in line.split("*"))
    if not line or not pattern or len(pattern) > LONGEST or not readable_rules([(pattern, "")]):
        return df.where(F.lit(False))
    return df.where(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in fields]).rlike(f"(?i){pattern}"))


@F.pandas_udf(DecimalType(20, 0))
def fnv1a(texts: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, unsigned; a null text has none."""
    from decimal import Decimal

    def one(text: str | None) -> Decimal | None:
        if text is None:
            return None
        h = 0xCBF29CE484222325  # fixed values: the published basis and prime
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return Decimal(h)

    return texts.map(one)


def page_cursor(query: str, last: tuple) -> str:
    """A cursor that belongs to a query: its fingerprint and the last row's keys."""
    import hashlib
    import json

    return json.dumps([hashlib.sha256(query.encode()).hexdigest()[:16], *map(str, last)])


def next_page(df: DataFrame, query: str, keys: list[str], size: int, cursor: str | None = None) -> DataFrame:
    """The ``size`` rows after a cursor by descending ``keys``; an error if the cursor is another query's."""
    import json

    if cursor is not None:
        mark, *last = json.loads(cursor)
        if mark != json.loads(page_cursor(query, ()))[0]:
            raise ValueError("the cursor belongs to another query; begin again")
        here = F.struct(*[F.col(k) for k in keys])
        df = df.where(here < F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, last, strict=True)]))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(size)
