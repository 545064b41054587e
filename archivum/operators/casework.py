"""Case work: custodians, snapshots, attachment groups, fallback matching, verification, review progress, contacts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import materialize
from archivum.operators.review import number_rows, number_within


def attachment_group(attachments: Column, name: str | None = None, kind: str | None = None, content: str | None = None) -> Column:
    """Whether one and the same attachment (name, kind, content) meets all that is asked for; a missing value never does."""

    def holds(a: Column) -> Column:
        out = F.lit(True)
        for field, asked in (("name", name), ("content", content)):
            if asked is not None:
                out = out & F.coalesce(F.lower(a[field]).contains(asked.lower()), F.lit(False))
        return out & F.coalesce(F.lower(a["kind"]) == kind.lower(), F.lit(False)) if kind is not None else out

    return F.coalesce(F.exists(attachments, holds), F.lit(False))


#: An attachment family's parts of a media type and its file endings.
FAMILIES = {
    "pdf": (["pdf"], ["pdf"]),
    "images": (["image/"], ["png", "jpg", "jpeg", "gif", "heic", "tiff", "tif", "bmp", "webp"]),
    "office": (["officedocument", "msword", "ms-excel", "ms-powerpoint", "opendocument"], ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf"]),
    "archives": (["zip", "compressed"], ["zip", "gz", "tgz", "7z", "rar", "tar"]),
    "text": (["text/"], ["txt", "csv", "md", "log", "json", "xml", "html", "htm"]),
}
_OTHER_NAMES = {"image": "images", "office documents": "office", "documents": "office", "archive": "archives", "zip": "archives"}


def attachment_family(name: Column, media_type: Column, kind: str) -> Column:
    """Whether an attachment is of a family (by media type or ending), or else has the ending ``kind``, taken literally."""
    kind = kind.lower()
    file, media = F.coalesce(F.lower(name), F.lit("")), F.coalesce(F.lower(media_type), F.lit(""))
    family = FAMILIES.get(_OTHER_NAMES.get(kind, kind))
    if family is None:
        return file.endswith("." + kind.strip(". "))
    out = F.lit(False)
    for part in family[0]:
        out = out | (media.startswith(part) if part.endswith("/") else media.contains(part))
    for ending in family[1]:
        out = out | file.endswith("." + ending)
    return out


def snapshot(df: DataFrame, sequence: str, bound: int) -> DataFrame:
    """Rows that were there when ``bound`` was the highest sequence number: later rows can't slip into a long export."""
    return df.where(F.col(sequence) <= bound)


def custodian(df: DataFrame, who: list[str], sender: Column, recipients: Column, ts: Column, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows whose sender or recipients contain one of the names (A-Z without case); rows without a date pass the period."""
    named = F.lit(False)
    for w in who:
        named = named | F.coalesce(F.lower(sender).contains(w.lower()), F.lit(False)) | F.coalesce(F.lower(recipients).contains(w.lower()), F.lit(False))
    inside = F.lit(True)
    for bound, later in ((since, True), (until, False)):
        if bound is not None:
            stamp = F.lit(bound).cast("timestamp_ntz")
            inside = inside & (ts >= stamp if later else ts <= stamp)
    return df.where(named & (ts.isNull() | inside))


def _pair_off(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """a, b, how: the n-th row of a key on one side with its n-th row on the other, by row; null keys are left out."""
    left = number_within(a.where(F.col(key).isNotNull()).select("a", F.col(key).alias("k")), ["k"], ["a"])
    right = number_within(b.where(F.col(key).isNotNull()).select("b", F.col(key).alias("k")), ["k"], ["b"])
    return left.join(right, ["k", "n"]).select("a", "b", F.lit(how).alias("how"))


def match_with_fallback(left: DataFrame, right: DataFrame, row: str, key: str, fallback: str) -> DataFrame:
    """a, b, how: rows of equal ``key``; of rows on both sides that this leaves unmatched, those of equal ``fallback``.

    Every row is in one pair at most: the rows of a key are paired off in order of ``row``, which must be unique on its
    side.  Null keys match nothing.
    """
    a = left.select(F.col(row).alias("a"), F.col(key).alias("k"), F.col(fallback).alias("f"))
    b = right.select(F.col(row).alias("b"), F.col(key).alias("k"), F.col(fallback).alias("f"))
    first = materialize(_pair_off(a, b, "k", "key"), "matched")
    return first.unionByName(_pair_off(a.join(first.select("a"), "a", "left_anti"), b.join(first.select("b"), "b", "left_anti"), "f", "fallback"))


def verify_groups(df: DataFrame, group: str, raw: Column) -> DataFrame:
    """group, n, verdict of groups of two or more: ``byteIdentical``, ``contentEquivalent`` (line ends apart), ``candidate``.

    A member without bytes keeps its group a candidate.  Only hashes are compared, so a large group is combined before
    the shuffle.
    """
    hashed = df.select(F.col(group).alias("group"), F.sha2(raw.cast("binary"), 256).alias("whole"), F.sha2(F.replace(raw, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256).alias("plain")).where("group is not null")
    every = hashed.groupBy("group").agg(F.count("*").alias("n"), F.count("whole").alias("known"), *(f(c).alias(f"{n}_{c}") for c in ("whole", "plain") for n, f in (("lo", F.min), ("hi", F.max)))).where("n > 1")
    known = F.col("known") == F.col("n")
    verdict = F.when(known & (F.col("lo_whole") == F.col("hi_whole")), "byteIdentical").when(known & (F.col("lo_plain") == F.col("hi_plain")), "contentEquivalent").otherwise("candidate")
    return every.select("group", "n", verdict.alias("verdict"))


def review_progress(df: DataFrame, tag: Column, seconds_per_tag: float) -> DataFrame:
    """total, coded, remaining, progress and minutes left of a review whose coders need so many seconds for a document."""
    counts = df.agg(F.count("*").alias("total"), F.count_if(tag.isNotNull()).alias("coded"))
    left = F.col("total") - F.col("coded")
    return counts.select("total", "coded", left.alias("remaining"), F.when(F.col("total") > 0, F.col("coded") / F.col("total")).otherwise(0.0).alias("progress"), (left * seconds_per_tag / 60).alias("minutes_left"))


def contact_activity(df: DataFrame, who: str, ts: str, now: datetime) -> DataFrame:
    """who, n, first, last and activity: six tenths for volume (full at 50 messages), four for recency (none after a year)."""
    found = df.groupBy(who).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    days = F.timestamp_diff("SECOND", F.col("last"), F.lit(now).cast("timestamp_ntz")) / 86400
    return found.withColumn("activity", 0.6 * F.least(F.col("n") / 50, F.lit(1.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - days / 365))


def side_statistics(df: DataFrame, side: str, sender: str, ts: str) -> DataFrame:
    """side, n, first, last and distinct senders (trimmed, lower-cased) of each side of a comparison."""
    return df.groupBy(side).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.countDistinct(F.lower(F.trim(F.col(sender)))).alias("senders"))


def hubs(df: DataFrame, sender: str, recipient: str, least: int = 10, k: int = 5) -> DataFrame:
    """The ``k`` senders with the most different recipients, of those with ``least`` or more; ties by sender."""
    found = df.where(F.col(sender).isNotNull()).groupBy(F.col(sender).alias("sender")).agg(F.countDistinct(recipient).alias("recipients"))
    return found.where(F.col("recipients") >= least).orderBy(F.desc("recipients"), "sender").limit(k)


def number_unnumbered(df: DataFrame, number: str, order: list[str], start: int = 1) -> DataFrame:
    """Rows without a number get the ones after the highest stored, or from ``start``; numbered rows never change."""
    top = df.agg(F.max(number)).first()[0]
    begin = max(start, (top or 0) + 1)
    fresh = number_rows(df.where(F.col(number).isNull()).drop(number), order, "_n")
    return df.where(F.col(number).isNotNull()).unionByName(fresh.withColumn(number, (F.col("_n") + (begin - 1)).cast(df.schema[number].dataType)).drop("_n"))


def thread_id(references: Column, reply_to: Column, message_id: Column, subject: Column, sender: Column, date: Column, body: Column) -> Column:
    """First reference, else the message replied to, else the id, else SHA-1 of subject, sender, date and 80 characters."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    own = F.sha1(F.concat(empty(subject), empty(sender), empty(date), F.left(empty(body), F.lit(80))).cast("binary"))
    some = lambda c: F.when(c != "", c)
    return F.coalesce(F.substring_index(some(references), " ", 1), some(reply_to), some(message_id), own)


def fallback_time(received: Column, envelope: Column) -> Column:
    """The time after the last ``;`` of a Received line, else the envelope's; null if neither can be read."""
    late = F.try_to_timestamp(F.trim(F.substring_index(received, ";", -1)), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(late.cast("timestamp_ntz"), envelope)
