"""Security figures of messages, verification of duplicates field by field, recipients by role, holds and seals, contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.analytics import most_frequent
from archivum.operators.durable import materialize

#: Endings of domains that count as risky.
RISKY = (".xyz", ".top", ".click", ".buzz", ".tk", ".ml", ".ga", ".cf")
#: An address inside a field.
ADDRESS = r"[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+"


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def field_domain(field: Column) -> Column:
    """What follows the last @ of a field without its angle brackets; empty if there is none."""
    plain = F.translate(F.coalesce(field, F.lit("")), "<>", "")
    return F.when(F.contains(plain, F.lit("@")), F.trim(F.substring_index(plain, "@", -1))).otherwise("")


def uses_tls(received: Column) -> Column:
    """Whether one of the Received fields (an array) names TLS."""
    return F.exists(F.coalesce(received, F.array().cast("array<string>")), lambda r: F.lower(r).contains("tls") | F.lower(r).contains("esmtps"))


def threat_score(sender: Column, return_path: Column, reply_to: Column, authentication: Column, received: Column) -> Column:
    """0 to 10: failed or missing sender checks, domains that differ from the sender's, no TLS, a risky ending.

    Points (fixed values): SPF and DKIM 3 if failed and 1 if unknown, DMARC 2 if failed, 2 for each other domain, 1 without TLS, 2 for
    the ending.
    """
    auth = _text(authentication)

    def check(name: str, soft: bool = False) -> tuple[Column, Column]:
        passed = auth.contains(f"{name}=pass")
        failed = ~passed & (auth.contains(f"{name}=fail") | (auth.contains(f"{name}=softfail") if soft else F.lit(False)))
        return failed, ~passed & ~failed

    spf, dkim, dmarc = check("spf", True), check("dkim"), check("dmarc")
    own, back, reply = field_domain(sender), field_domain(return_path), field_domain(reply_to)
    points = [
        (spf[0], 3), (spf[1], 1), (dkim[0], 3), (dkim[1], 1), (dmarc[0], 2), ((back != "") & (back != own), 2), ((reply != "") & (reply != own), 2),
        (~uses_tls(received), 1), (reduce(Column.__or__, [own.endswith(e) for e in RISKY]), 2),
    ]
    return F.least(reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, n in points]), F.lit(10))


def security_statistics(df: DataFrame, score: Column, sender: Column, authentication: Column, received: Column, client: Column, attachments: Column, top: int = 10) -> DataFrame:
    """kind, key, n: messages in all, with passed checks, TLS and attachments, by level of threat; the commonest domains and clients.

    All kinds come from one reading: a message gives one (kind, key) for each that holds.
    """
    auth = _text(authentication)
    level = F.when(score >= 7, "high").when(score >= 4, "medium").when(score >= 1, "low").otherwise("clean")
    one = lambda kind, key, keep=None: F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    count = F.size(F.coalesce(attachments, F.array().cast("array<string>")))
    facts = [one("messages", F.lit("all")), one("threat", level), one("tls", F.lit("yes"), uses_tls(received)), one("attachments", F.lit("yes"), count > 0)]
    facts += [one("passed", F.lit(n), auth.contains(f"{n}=pass")) for n in ("spf", "dkim", "dmarc")]
    domain = field_domain(sender)
    facts += [one("domain", domain, domain != ""), one("client", client, client.isNotNull())]
    counts = df.select(F.inline(F.array_compact(F.array(*facts)))).groupBy("kind", "key").agg(F.count("*").alias("n"))
    return most_frequent(counts, {"domain": top, "client": top})


def addresses(field: Column) -> Column:
    """The addresses of a field in lower case, sorted; the field itself, its blanks joined, if it holds none."""
    found = F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(field, F.lit("")), F.lit(ADDRESS), F.lit(0)), F.lower))
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise(collapsed(F.lower(field)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def verify_fields(df: DataFrame, group: str, raw: Column, parsed: Column, fields: dict[str, Column], attachments: Column) -> DataFrame:
    """group, n, verdict, differences of groups of two or more.

    Equal bytes of all members: ``byteIdentical``; equal up to line ends: ``contentEquivalent``.  A member that wasn't
    ``parsed`` makes the group a ``candidate`` that differs in body and structure.  Else ``fields`` (text keys by name) are
    compared, and attachments (array of struct: digest first, null where bytes are missing) as a set with repeats, without
    digests if any is missing, which is a difference by itself; no difference is ``contentEquivalent``.  Only hashes are
    compared, by minima and maxima that combine before the shuffle.
    """
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    held = F.coalesce(attachments, F.array().cast(df.select(attachments.alias("x")).schema["x"].dataType))
    first = df.select(held.alias("x")).schema["x"].dataType.elementType.names[0]
    keys = {n: digest(c) for n, c in fields.items()}
    keys["_with"] = digest(F.to_json(F.array_sort(held)))
    keys["_without"] = digest(F.to_json(F.array_sort(F.transform(held, lambda a: a.dropFields(first)))))
    keys["_whole"], keys["_plain"] = F.sha2(raw.cast("binary"), 256), F.sha2(F.replace(raw, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)
    rows = df.select(F.col(group).alias("group"), parsed.alias("_parsed"), F.exists(held, lambda a: a[first].isNull()).alias("_missing"), *[c.alias(n) for n, c in keys.items()]).where("group is not null")
    sums = [F.count("*").alias("n"), F.count("_whole").alias("_known"), F.min("_parsed").alias("_all_parsed"), F.max("_missing").alias("_any_missing")]
    every = rows.groupBy("group").agg(*sums, *[(F.min(n) != F.max(n)).alias(f"{n}_differs") for n in keys]).where("n > 1")
    known = F.col("_known") == F.col("n")
    listed = F.array_compact(F.array(*[F.when(F.col(f"{n}_differs"), n) for n in fields], F.when(F.when(F.col("_any_missing"), F.col("_without_differs")).otherwise(F.col("_with_differs")), "attachments").when(F.col("_any_missing"), "attachmentBytes")))
    differences = F.when(known & (~F.col("_whole_differs") | ~F.col("_plain_differs")), F.array().cast("array<string>")).when(~F.col("_all_parsed"), F.array(F.lit("body"), F.lit("structure"))).otherwise(listed)
    verdict = F.when(known & ~F.col("_whole_differs"), "byteIdentical").when(F.size("differences") == 0, "contentEquivalent").otherwise("candidate")
    return every.withColumn("differences", differences).select("group", "n", verdict.alias("verdict"), "differences")


def participant(people: Column, value: str, roles: tuple[str, ...] = ("TO", "CC", "BCC"), equals: bool = False) -> Column:
    """Whether one of ``people`` (array of struct role, address, name) in one of ``roles`` has ``value``: as a part of the address or
    the name, or as the whole address; without case.  Addresses are in lower case."""
    low = F.lit(value.lower())

    def hit(p: Column) -> Column:
        part = F.contains(p["address"], low) | F.contains(_text(p["name"]), low)
        return p["role"].isin(*roles) & F.coalesce(p["address"] == low if equals else part, F.lit(False))

    return F.coalesce(F.exists(people, hit), F.lit(False))


def derived_filter(df: DataFrame, derived: DataFrame, id_: str, least_priority: int | None = None, phishing_only: bool = False, tone_below: float | None = None, classes: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose derived record (priority, phishing, tone, class) meets all that is asked; rows without one don't."""
    asked = F.lit(True)
    if least_priority is not None:
        asked = asked & (F.col("priority") >= least_priority)
    if phishing_only:
        asked = asked & F.col("phishing")
    if tone_below is not None:
        asked = asked & (F.col("tone") < tone_below)
    if classes:
        asked = asked & F.col("class").isin(*classes)
    return df.join(derived.where(asked).select(id_), id_, "left_semi")


def capture_filter(df: DataFrame, remote: DataFrame, id_: str, kind: str | None = None, state: str | None = None, account: str | None = None) -> DataFrame:
    """Rows by their captured copies (``remote``: id, account, present): ``kind`` connected or file, ``state`` onServer or
    removedOnServer, an account's; an unknown kind or state matches nothing."""
    if state is not None or account is not None:
        copies = remote.where({"onServer": "present", "removedOnServer": "not present", None: "true"}.get(state, "false"))
        copies = copies if account is None else copies.where(F.col("account") == account)
        df = df.join(copies.select(id_), id_, "left_semi")
    if kind is not None:
        df = df.join(remote.select(id_), id_, {"connected": "left_semi", "file": "left_anti"}[kind]) if kind in ("connected", "file") else df.where(F.lit(False))
    return df


def seals(df: DataFrame, held: DataFrame, sealed: DataFrame, id_: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(holds, seals) after a hold on the rows ``df``: ids once each, and for each id the digest of its content, set once."""
    rows = df.select(id_, F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256).alias("seal")).dropDuplicates([id_])
    return held.select(id_).unionByName(rows.select(id_)).distinct(), sealed.unionByName(rows.join(sealed.select(id_), id_, "left_anti"))


def verify_seals(df: DataFrame, sealed: DataFrame, id_: str, content: Column) -> DataFrame:
    """id, status of every sealed row: ``intact``, ``changed`` or ``missing``."""
    now = df.select(id_, F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256).alias("now"))
    both = sealed.join(now, id_, "left")
    return both.select(id_, F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("seal"), "intact").otherwise("changed").alias("status"))


def custodian_totals(df: DataFrame, assigned: DataFrame, held: DataFrame, id_: str, ts: str) -> DataFrame:
    """custodian, messages, held, first, last; messages without a custodian under null."""
    rows = df.join(assigned, id_, "left").join(held.select(id_, F.lit(True).alias("_held")), id_, "left")
    return rows.groupBy("custodian").agg(F.count("*").alias("messages"), F.count("_held").alias("held"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def relationships(df: DataFrame, contact: str, sent: Column, ts: str, now: Column, least: int = 2) -> DataFrame:
    """contact, n, reciprocity, recency, frequency, kind of contacts with ``least`` messages or more.

    Reciprocity is the smaller of sent and received over the larger (0.1 if one-way), recency falls to 0 over a year,
    frequency is n / 50 up to 1.  Kinds and bounds are fixed values.
    """
    found = df.groupBy(contact).agg(F.count("*").alias("n"), F.count_if(sent).alias("s"), F.max(ts).alias("last")).where(F.col("n") >= least)
    received = F.col("n") - F.col("s")
    mutual = F.when((F.col("s") == 0) | (received == 0), 0.1).otherwise(F.least("s", received) / F.greatest("s", received))
    days = F.timestamp_diff("SECOND", F.col("last"), now) / 86_400
    scored = found.select(contact, "n", mutual.alias("reciprocity"), F.coalesce(F.greatest(F.lit(0.0), 1 - days / 365), F.lit(0.0)).alias("recency"), F.least(F.lit(1.0), F.col("n") / 50).alias("frequency"))
    kind = F.when((F.col("reciprocity") > 0.4) & (F.col("frequency") > 0.3) & (F.col("recency") > 0.3), "Close").when((F.col("reciprocity") > 0.2) & (F.col("frequency") > 0.15), "Regular")
    kind = kind.when((F.col("reciprocity") < 0.15) & (F.col("n") >= 3), "One-Way").when((F.col("recency") < 0.2) & (F.col("n") >= 5), "Dormant").otherwise("Acquaintance")
    return scored.withColumn("kind", kind)


def hybrid(lexical: DataFrame, semantic: DataFrame, id_: str, take: int = 50, k: int = 60) -> DataFrame:
    """id, score, rank: rows of a lexical and a semantic ranking ((id, rank), the first ``take`` of each) by reciprocal ranks."""
    from archivum.operators.analytics import reciprocal_rank_fusion

    lists = [materialize(x.where(F.col("rank") <= take).select(id_, "rank"), "ranked") for x in (lexical, semantic)]
    return reciprocal_rank_fusion(lists, id_)


#: Named characters of readable text.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "bull": "•", "middot": "·", "amp": "&"}


def readable_html(html: Column) -> Column:
    """The text of a page: comments and invisible elements left out, lines where blocks end, other tags dropped, characters decoded."""
    text = F.coalesce(html, F.lit(""))
    for element in ("<!--.*?-->", *[rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ("head", "style", "script", "noscript", "template")]):
        text = F.regexp_replace(text, f"(?is){element}", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|tr|li|h[1-6]|blockquote|table|section|article)\s*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    # each & is read once: the pieces after it are decoded, so that what a name stands for isn't read again
    pieces = F.split(text, "&")

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z]{1,10}|#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8});", 1)
        table = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
        digits = F.regexp_extract(name, r"^#[xX]?([0-9A-Fa-f]+)$", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).cast("long")
        valid = (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.coalesce(F.try_element_at(table, F.lower(name)), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        return F.when((name != "") & sign.isNotNull(), F.concat(sign, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    text = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    for pattern, to in (("[ \\t\u00a0]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return text
