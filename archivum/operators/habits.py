"""Who sends in bulk and how often, when an archive's messages come, and headers that don't fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.signals import any_of

#: Domains of mailing platforms and of social media, words of a promotion and of a transaction, rare charsets.
PLATFORMS = [
    "mailchimp.com", "sendgrid.net", "amazonses.com", "constantcontact.com", "hubspot.com", "mailgun.org", "sparkpostmail.com", "em.mailjet.com",
    "cmail19.com", "cmail20.com", "createsend.com", "mcsv.net", "substack.com", "beehiiv.com", "convertkit.com", "drip.com",
]
SOCIAL = [
    "facebookmail.com", "linkedin.com", "twitter.com", "x.com", "instagram.com", "pinterest.com", "reddit.com", "tiktok.com",
    "youtube.com", "discord.com", "slack.com", "medium.com",
]
PROMOTION, TRANSACTION = ["sale", "% off", "discount", "promo"], ["order", "receipt", "invoice", "shipping"]
RARE_CHARSETS = ["utf-7", "hz-gb", "viscii"]
DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
DAY = 86400


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def _domain(address: Column) -> Column:
    """The name after the first ``@``, in small letters; null if there is none."""
    found = F.regexp_extract(F.lower(address), r"^[^@]*@([\p{L}\p{M}\p{N}.\-]+)", 1)
    return F.when(found != "", found)


def subscriptions(df: DataFrame, order: str, sender: Column, ts: Column, body: Column, message_id: Column, reply_to: Column, unsubscribe: Column, bulk: Column, route: Column) -> DataFrame:
    """(domain, n, category, cadence, has_unsubscribe, last, engagement) of the domains that send in bulk.

    ``unsubscribe``: the message has an unsubscribe header; ``bulk``: a list id or bulk precedence; ``route``: its Received
    and mailer headers.  A domain of two messages or more counts if one of them has such a header, the word in its text
    or a platform's name in its route, if the domain is a social medium, or from five messages on.  The category comes from
    the message that is first by ``order``; cadence from the mean gap of the dated messages; engagement is the share of the
    domain's messages that a message of the same domain answers (by equal ids).

    Texts become flags before the shuffle, and both groupings combine in the map tasks.  Messages without a domain are
    left out; null fields are absent headers; an empty table gives no rows.
    """
    text = F.lower(F.coalesce(body, F.lit("")))
    path = F.lower(F.coalesce(route, F.lit("")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    m = df.select(
        F.col(order).alias("order"), _domain(sender).alias("domain"), ts.alias("ts"), message_id.alias("id"), reply_to.alias("reply"),
        flag(unsubscribe).alias("header"), (flag(unsubscribe) | flag(bulk)).alias("listed"), text.contains("unsubscribe").alias("word"),
        any_of(text, PROMOTION).alias("promotion"), any_of(text, TRANSACTION).alias("transaction"), any_of(path, PLATFORMS).alias("platform"),
    ).where("domain is not null")
    has = lambda c: F.bool_or(c).alias(c)
    first = F.min_by(F.struct("promotion", "transaction"), "order").alias("first")
    by_domain = m.groupBy("domain").agg(F.count("*").alias("n"), has("listed"), has("platform"), F.bool_or(F.col("header") | F.col("word")).alias("has_unsubscribe"), first, F.min("ts").alias("since"), F.max("ts").alias("last"), F.count("ts").alias("dated"))
    answers = m.where("reply is not null").select("domain", F.col("reply").alias("id")).distinct()
    answered = m.where("id is not null").groupBy("domain", "id").agg(F.count("*").alias("k")).join(answers, ["domain", "id"], "left_semi").groupBy("domain").agg(F.sum("k").alias("answered"))
    social = F.col("domain").isin(SOCIAL)
    kept = by_domain.where(F.col("n") >= 2).where(F.col("listed") | F.col("has_unsubscribe") | F.col("platform") | social | (F.col("n") >= 5))
    gap = (_seconds(F.col("last")) - _seconds(F.col("since"))) / (F.col("dated") - 1) / DAY
    category = F.when(social, "social").when(F.col("listed") & ~F.col("has_unsubscribe"), "notification").when(F.col("first.promotion"), "promotion")
    category = category.when(F.col("first.transaction"), "transaction").when(F.col("listed") | F.col("platform"), "newsletter").otherwise("unknown")
    cadence = F.when(F.col("dated") < 2, "irregular").when(gap < 2, "daily").when(gap < 10, "weekly").when(gap < 35, "monthly").otherwise("irregular")
    engagement = F.coalesce("answered", F.lit(0)) / F.col("n")
    return kept.join(answered, "domain", "left").select("domain", "n", category.alias("category"), cadence.alias("cadence"), "has_unsubscribe", "last", engagement.alias("engagement"))


def habits(df: DataFrame, ts: str) -> DataFrame:
    """One row: peak_hour and its messages, peak_day and its messages, weekend messages and percent, the mean of the last three
    months that have messages and of the three before (whole numbers), and the change between them in percent.

    Ties go to the earlier hour and day.  Each row gives three counts that combine in the map tasks, so what is shuffled has 24
    hours, 7 days and the archive's months.  Rows without a date count nowhere; without any, all columns are null or 0.
    """
    t = F.col(ts)
    keys = [("hour", F.hour(t)), ("day", F.dayofweek(t)), ("month", F.year(t) * 12 + F.month(t))]
    every = F.array(*[F.struct(F.lit(name).alias("kind"), value.alias("key")) for name, value in keys])
    counts = df.where(t.isNotNull()).select(F.inline(every)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    peak = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct(F.col("n"), (-F.col("key")).alias("back"))))
    days = lambda c: F.coalesce(F.sum(F.when((F.col("kind") == "day") & c, F.col("n"))), F.lit(0))
    months = F.sort_array(F.collect_list(F.when(F.col("kind") == "month", F.struct("key", "n"))), asc=False)
    one = counts.agg(peak("hour").alias("h"), peak("day").alias("d"), days(F.col("key").isin(1, 7)).alias("weekend"), days(F.lit(True)).alias("all"), months.alias("months"))
    mean = lambda part: F.floor(F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["n"]) / F.size(part))
    recent, older = F.slice("months", 1, 3), F.slice("months", 4, 3)
    one = one.withColumn("recent", F.when(F.size(recent) > 0, mean(recent))).withColumn("older", F.when(F.size(older) > 0, mean(older)).otherwise(F.col("recent")))
    names = F.array(*[F.lit(x) for x in DAY_NAMES])
    return one.select(
        (-F.col("h.back")).alias("peak_hour"), F.col("h.n").alias("peak_hour_n"), F.when(F.col("d").isNotNull(), F.element_at(names, (-F.col("d.back")).cast("int"))).alias("peak_day"), F.col("d.n").alias("peak_day_n"),
        "weekend", F.when(F.col("all") > 0, F.floor(100 * F.col("weekend") / F.col("all"))).alias("weekend_percent"), "recent", "older",
        F.when(F.col("older") > 0, ((F.col("recent") - F.col("older")) / F.col("older") * 100).cast("long")).alias("change_percent"),
    )


def metadata_anomalies(df: DataFrame, message_id: Column, sender: Column, return_path: Column, date_text: Column, date: Column, received: Column, subject: Column, content_type: Column) -> DataFrame:
    """``df`` with ``anomaly`` and ``severity`` (in place of columns of these names), a row for each anomaly of a message.

    missing_id 0.6; domain_mismatch of sender and return path 0.7; date_ahead by more than a day of a Received time (its
    share of 7 days, 1 at most) or date_behind by more than 7 days (its share of 30 days), by the first of the times
    (``received``: an array of timestamps) that differ so; stripped: two or three of sender, date and subject are missing or
    empty, 0.7 or 0.8; rare_charset 0.5.  One projection, nothing is shuffled; null fields are absent headers.
    """
    gap = F.transform(F.filter(received, lambda r: r.isNotNull()), lambda r: _seconds(date) - _seconds(r))
    off = F.element_at(F.concat(F.filter(gap, lambda g: (g > DAY) | (g < -7 * DAY)), F.array(F.lit(None).cast("double"))), 1)
    absent = sum(((F.coalesce(c, F.lit("")) == "").cast("int") for c in (sender, date_text, subject)), F.lit(0))
    kind = F.coalesce(content_type, F.lit(""))
    rules = [
        ("missing_id", F.lit(0.6), message_id.isNull()),
        ("domain_mismatch", F.lit(0.7), _domain(sender) != _domain(return_path)),
        ("date_ahead", F.least(F.lit(1.0), off / (7 * DAY)), off > DAY),
        ("date_behind", F.least(F.lit(1.0), -off / (30 * DAY)), off < -7 * DAY),
        ("stripped", 0.5 + absent * 0.1, absent >= 2),
        ("rare_charset", F.lit(0.5), kind.contains("charset") & any_of(F.lower(kind), RARE_CHARSETS)),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("anomaly"), s.cast("double").alias("severity"))) for n, s, c in rules])
    held = F.filter(found, lambda x: x.isNotNull())
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("anomaly", "severity")]
    return df.select(*rest, F.inline(held))
