"""Scores that are sums of signals: priority, privilege, phishing; and what authentication headers say.

A signal is (name, points, condition).  ``weigh`` turns a list of them into a score and the names of those that hold, in
one projection, so a report of any number of signals reads its table once and shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Signal = tuple[str, float, Column]

#: Words and phrases of the reports, with their points where these differ.
URGENT = ["urgent", "asap", "important", "critical", "deadline", "time-sensitive", "action required", "immediate"]
REQUESTS = ["please", "could you", "can you", "need you to", "requesting", "follow up", "waiting for"]
PRESSURE = ["urgent", "act now", "immediately", "suspended", "verify your account", "confirm your identity", "unusual activity", "security alert", "unauthorized", "compromised", "locked", "expire", "limited time", "within 24 hours", "within 48 hours"]
HARVESTING = ["click here to verify", "enter your password", "update your payment", "confirm your details", "click the link below", "your account will be", "won a prize", "lottery", "inherit", "million dollars", "wire transfer", "western union", "send money", "bitcoin wallet", "cryptocurrency", "social security number", "bank account details"]
BRANDS = ["paypal", "apple", "amazon", "microsoft", "google", "netflix", "bank of america", "wells fargo", "chase", "citibank", "facebook", "instagram", "linkedin", "dropbox", "docusign"]
SHORTENERS = ["bit.ly", "tinyurl", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "shorturl"]
PRIVILEGE = {
    "attorney-client": 4.0, "privileged and confidential": 4.0, "legal advice": 3.0, "legal counsel": 3.0, "attorney work product": 4.0, "work product": 3.5, "prepared in anticipation of litigation": 4.0,
    "litigation strategy": 3.5, "joint defense agreement": 4.0, "joint defense": 3.0, "common interest agreement": 4.0, "common interest privilege": 3.5, "this communication is privileged": 3.0,
    "not for distribution": 2.0, "do not forward": 1.5, "confidential communication": 2.5, "legal opinion": 3.0, "legal matter": 2.0, "outside counsel": 2.5, "in-house counsel": 2.5, "retainer": 2.0,
    "settlement": 2.0, "deposition": 2.5, "discovery request": 2.5, "litigation hold": 3.0, "protective order": 2.5, "subpoena": 2.5, "regulatory inquiry": 2.0, "compliance review": 1.5, "esq": 1.5,
    "j.d.": 1.0, "bar number": 1.5,
}
DISCLAIMERS = ["this email and any attachments are privileged", "attorney-client privilege", "intended only for the addressee", "if you are not the intended recipient", "this message contains information that may be privileged", "confidential and protected by attorney"]
TITLES = ["esq", "attorney", "counsel", "solicitor", "barrister", "paralegal", "legal assistant"]


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row, however often they are used (a generator isn't inlined)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def weigh(df: DataFrame, signals: list[Signal], score: str = "score", reasons: str = "reasons") -> DataFrame:
    """``df`` with the points of the signals that hold and their names."""
    every = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("points"))) for n, p, c in signals))
    held = once(df, _held=F.filter(every, lambda x: x.isNotNull()))
    total = F.aggregate("_held", F.lit(0.0), lambda a, x: a + x["points"])
    return once(held, **{score: total, reasons: F.transform("_held", lambda x: x["name"])}).drop("_held")


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def priority(df: DataFrame, subject: Column, body: Column, in_thread: Column, sender_replies: Column, attachments: Column) -> DataFrame:
    """score, reasons and level (High from 5 points, Medium from 3) of each message."""
    df = once(df, _s=_text(subject), _b=_text(body))
    s, b = F.col("_s"), F.col("_b")
    questions = F.regexp_count(s, F.lit(r"\?")) + F.regexp_count(F.left(b, F.lit(500)), F.lit(r"\?"))
    signals = [
        ("urgency", 2, any_of(s, URGENT) | any_of(F.left(b, F.lit(300)), URGENT)),
        ("questions", 1, questions >= 2),
        ("request", 1, any_of(F.left(b, F.lit(500)), REQUESTS)),
        ("thread", 1, in_thread),
        ("frequent contact", 1, sender_replies >= 3),
        ("attachments", 1, attachments > 0),
    ]
    return weigh(df, signals).drop("_s", "_b").withColumn("level", F.when(F.col("score") >= 5, "High").when(F.col("score") >= 3, "Medium").otherwise("Low"))


def privilege(df: DataFrame, subject: Column, body: Column, participants: Column, law_sender: Column, law_recipient: Column) -> DataFrame:
    """score (0 to 1), reasons and class of each message; names of organisations in the text are not looked at."""
    df = once(df, _b=_text(body), _both=F.concat_ws(" ", _text(subject), _text(body)))
    b, both = F.col("_b"), F.col("_both")
    signals = [("law firm sends", 3, law_sender), ("law firm receives", 2, law_recipient), *((t, p, both.contains(t)) for t, p in PRIVILEGE.items()), ("disclaimer", 1.5, any_of(b, DISCLAIMERS)), ("legal title", 1.5, any_of(_text(participants), TITLES))]
    out = weigh(df, signals, "points").drop("_b", "_both")
    level = F.when(F.col("points") >= 10, "privileged, high").when(F.col("points") >= 6, "privileged, medium").when(F.col("points") >= 3, "needs review").otherwise("not privileged")
    return out.withColumns({"class": level, "score": F.least(F.lit(1.0), F.col("points") / 15)}).drop("points")


def authentication(header: Column) -> Column:
    """What an Authentication-Results header says: spf, dkim, dmarc, their domains and the selector; null where it is silent."""
    h = F.lower(header)
    fields = {"spf": r"spf=(\w+)", "spf_domain": r"smtp\.mailfrom=([^\s;]+)", "dkim": r"dkim=(\w+)", "dkim_domain": r"header\.d=([^\s;]+)", "selector": r"header\.s=([^\s;]+)", "dmarc": r"dmarc=(\w+)", "dmarc_domain": r"header\.from=([^\s;]+)"}
    return F.struct(*(F.nullif(F.regexp_extract(h, p, 1), F.lit("")).alias(n) for n, p in fields.items()))


def phishing(df: DataFrame, subject: Column, sender: Column, body: Column, authentication_results: Column, reply_to: Column) -> DataFrame:
    """score, reasons and risk (high from 8 points, medium from 4) of each message.

    Signals of the text, the sender's name and address, links, and authentication; risky top-level domains, encoded
    links, redirects and differing link texts are not looked at.  SPF and DKIM failures count once.
    """
    df = once(df, _s=_text(subject), _f=_text(sender), _b=_text(body), _start=F.left(_text(body), F.lit(1000)), _h=_text(authentication_results))
    s, f, b, h = (F.col(c) for c in ("_s", "_f", "_b", "_h"))
    shown = F.trim(F.substring_index(f, "<", 1))
    domain = F.substring_index(F.trim(F.replace(F.substring_index(f, "<", -1), F.lit(">"), F.lit(""))), "@", -1)
    named = F.substring_index(shown, "@", -1)
    start = F.col("_start")
    answer = F.substring_index(F.substring_index(_text(reply_to), "@", -1), ">", 1)
    brand = reduce(Column.__or__, (shown.contains(x) & ~domain.contains(x) for x in BRANDS))
    signals = [
        *((f"pressure: {w}", 2, s.contains(w) | start.contains(w)) for w in PRESSURE),
        *((f"harvesting: {w}", 3, b.contains(w)) for w in HARVESTING),
        ("name shows another domain", 3, (named != "") & (domain != "") & (named != domain) & named.contains(".")),
        ("brand in name", 4, brand),
        ("link with @", 3, b.rlike(r"https?://[^\s]*@[^\s]+")),
        ("link to an address", 3, b.rlike(r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")),
        ("short link", 1, any_of(b, SHORTENERS)),
        ("spf", 2, h.contains("spf=fail") | h.contains("spf=softfail")),
        ("dkim", 2, h.contains("dkim=fail")),
        ("dmarc", 3, h.contains("dmarc=fail")),
        ("answers go elsewhere", 2, (answer != "") & (domain != "") & (answer != domain)),
    ]
    out = weigh(df, signals).drop("_s", "_f", "_b", "_start", "_h")
    return out.withColumn("risk", F.when(F.col("score") >= 8, "high").when(F.col("score") >= 4, "medium"))


#: Words of urgency by their points, risky file endings and top-level domains.
NOW_WORDS = ["urgent", "asap", "immediately", "emergency", "critical", "deadline today"]
SOON_WORDS = ["time-sensitive", "by end of day", "eod", "before tomorrow", "action required", "action needed", "please respond", "waiting for your", "overdue"]
SOME_TIME_WORDS = ["follow up", "follow-up", "reminder", "fyi", "when you get a chance", "could you", "would you", "need your input"]
DANGEROUS = ["exe", "bat", "cmd", "scr", "pif", "js", "vbs", "wsf", "ps1", "msi", "dll", "com"]
RISKY_DOMAINS = ["xyz", "tk", "ml", "ga", "cf", "gq", "top", "buzz", "club", "icu", "work"]


def urgency(df: DataFrame, subject: Column, body: Column, ts: Column, tone: Column, now: Column) -> DataFrame:
    """score (at most 1), reasons and urgency of the messages whose points are above 0.05; ``tone`` below -0.3 adds points."""
    df = once(df, _all=F.concat_ws(" ", _text(subject), _text(body)), _s=_text(subject))
    text = F.col("_all")
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)
    signals = [
        *((w, 0.3, text.contains(w)) for w in NOW_WORDS),
        *((w, 0.2, text.contains(w)) for w in SOON_WORDS),
        *((w, 0.1, text.contains(w)) for w in SOME_TIME_WORDS),
        ("questions", 0.15, F.regexp_count(text, F.lit(r"\?")) >= 2),
        ("exclamation marks", 0.1, F.regexp_count(F.col("_s"), F.lit("!")) >= 2),
        ("today or yesterday", 0.1, days <= 1),
        ("within three days", 0.05, (days > 1) & (days <= 3)),
        ("tone", 0.1, tone < -0.3),
    ]
    points = F.round("score", 9)
    out = weigh(df, signals).drop("_all", "_s").where(points > 0.05)
    level = F.when(points >= 0.5, "critical").when(points >= 0.35, "high").when(points >= 0.2, "medium").otherwise("low")
    return out.withColumn("urgency", level).withColumn("score", F.least(points, F.lit(1.0)))


def correlate_threats(df: DataFrame, anomalies: DataFrame, row: str, body: Column, files: Column) -> DataFrame:
    """score (0 to 1), level and vector of the messages that have any sign of a threat.

    ``df`` has ``spf``, ``dkim``, ``dmarc``, and ``risk`` and ``reasons`` as ``phishing`` gives them (its score is replaced); ``anomalies``
    (row, severity) may name a message often and is summed before it is joined.
    """
    odd = anomalies.groupBy(row).agg(F.sum("severity").alias("_odd"))
    df = once(df.join(odd, row, "left"), _b=_text(body), _files=F.size(F.filter(files, lambda f: F.lower(F.regexp_extract(f, r"\.([^.]*)$", 1)).isin(DANGEROUS))))
    b, flagged, risky = F.col("_b"), F.col("risk").isNotNull() & (F.size("reasons") > 0), F.col("_files") > 0
    locked = b.contains("password") & any_of(b, ["attached", "enclosed", "zip"])
    bad = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    sender = bad("spf", "fail", "softfail") | bad("dkim", "fail") | bad("dmarc", "fail")
    points = (
        F.when(bad("spf", "fail"), 1.6).when(bad("spf", "softfail"), 1.0).otherwise(0.0) + F.when(bad("dkim", "fail"), 1.4).otherwise(0.0) + F.when(bad("dmarc", "fail"), 1.8).otherwise(0.0)
        + F.when(flagged, F.when(F.col("risk") == "high", 0.9).when(F.col("risk") == "medium", 0.6).otherwise(0.3) * F.size("reasons")).otherwise(0.0)
        + F.coalesce("_odd", F.lit(0.0)) + F.greatest(F.col("_files"), F.lit(0)) * 2.0 + F.when(locked, 1.0).otherwise(0.0)
    )
    content = flagged | locked
    vector = (
        F.when(any_of(b, ["wire transfer", "bank account", "routing number"]), "business email compromise").when(risky, "malware delivery")
        .when(any_of(b, ["password", "credential", "sign in", "verify your account"]), "credential harvesting").when(sender & content, "spear phishing").when(sender, "spoofing").when(content, "phishing")
    )
    out = once(df.where(sender | content | risky | F.col("_odd").isNotNull()).drop("score", "vector"), score=F.least(points / 10, F.lit(1.0)), vector=vector).drop("_odd", "_b", "_files")
    s = F.round("score", 9)
    return out.withColumn("level", F.when(s >= 0.8, "critical").when(s >= 0.6, "high").when(s >= 0.35, "medium").when(s >= 0.1, "low").otherwise("clean"))


def domain_reputation(df: DataFrame, domain: str, ts: str, checked: Column, passed: Column, flagged: Column, now: Column) -> DataFrame:
    """Each sending domain: messages, authentication and phishing rates, first and last time, score and class.

    ``checked``: the message says anything of its authentication; ``passed``: all of it passes; ``flagged``: phishing.
    One aggregate, combined before its shuffle.
    """
    held = df.where(F.coalesce(F.col(domain) != "", F.lit(False))).groupBy(domain).agg(
        F.count("*").alias("messages"), F.count_if(checked).alias("_checked"), F.count_if(checked & passed).alias("_passed"), F.count_if(flagged).alias("_flagged"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )
    n, rate, phish = F.col("messages"), F.col("authentication_rate"), F.col("phishing_rate")
    held = held.withColumns({"authentication_rate": F.when(F.col("_checked") > 0, F.col("_passed") / F.col("_checked")).otherwise(0.5), "phishing_rate": F.col("_flagged") / n})
    age = F.unix_timestamp(now) - F.unix_timestamp("first_seen")
    points = (
        0.5 + (rate - 0.5) * 0.3 - F.when((rate < 0.3) & (F.col("_checked") > 2), 0.15).otherwise(0.0) - F.when(phish > 0.3, 0.25).when(phish > 0.1, 0.1).otherwise(0.0)
        + F.when(n >= 20, 0.1).otherwise(0.0) - F.when(n < 3, 0.05).otherwise(0.0) + F.when(age < 7 * 86400, -0.15).when(age > 180 * 86400, 0.1).otherwise(0.0)
        - F.when(F.substring_index(domain, ".", -1).isin(RISKY_DOMAINS), 0.2).otherwise(0.0)
    )
    score = F.col("score")
    kind = F.when(n < 3, "new, unverified").when(score >= 0.75, "trusted").when(score >= 0.5, "known").when(score >= 0.3, "suspicious").otherwise("malicious")
    out = held.withColumn("score", F.round(F.greatest(F.least(points, F.lit(1.0)), F.lit(0.0)), 9)).withColumn("class", kind)
    return out.drop("_checked", "_passed", "_flagged")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """key, since, until, n: runs of a key's rows without a gap of ``gap`` or more; rows without a key or time don't count."""
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    found = rows.groupBy(F.col(key), F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("n"))
    return found.select(key, "since", "until", "n")


def coordinated(df: DataFrame, key: str, ts: str, least: int = 3, together: int = 2, unit: str = "hour") -> DataFrame:
    """since, members, n: hours (or another unit) in which ``together`` keys or more have ``least`` rows or more each."""
    each = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("since"), F.col(key)).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return each.groupBy("since").agg(F.count("*").alias("members"), F.sum("n").alias("n")).where(F.col("members") >= together)
