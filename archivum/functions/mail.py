"""Column functions over mail fields: addresses, subjects, threads, HTML, dates and identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_address(c: Column) -> Column:
    """What stands after the last ``<``, without ``>``, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.substring_index(c, "<", -1), ">", "")))


def address_domain(c: Column) -> Column:
    """What stands after the last ``@``; empty without one."""
    return F.when(c.contains("@"), F.substring_index(c, "@", -1)).otherwise(F.lit(""))


def base_address(c: Column) -> Column:
    """Lower case, without a ``+tag`` before the ``@``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\+[^@]*@", "@")


def plain_subject(c: Column) -> Column:
    """Without any run of reply and forward marks in front."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^((re|fwd?)(\[\d+\])?:\s*)+", ""))


def thread_key(references: Column, reply_to: Column, message_id: Column, subject: Column) -> Column:
    """First reference, else the message replied to, else the id, else the plain subject; null if all are missing."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    named = blank(plain_subject(subject))
    return F.coalesce(blank(F.get(F.split(F.trim(references), r"\s+"), F.lit(0))), blank(reply_to), blank(message_id), F.concat(F.lit("subj:"), named))


def effective_time(stamp: Column) -> Column:
    """The stamp, or null before 1900: such dates count as undated."""
    return F.when(stamp >= F.lit("1900-01-01").cast("timestamp_ntz"), stamp)


def index_text(html: Column) -> Column:
    """Tags become blanks; the four common entities are read; blanks are joined."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


#: Size classes in bytes, each with its end.
SIZES = [("< 1 KB", 1024), ("1-10 KB", 10240), ("10-100 KB", 102400), ("100 KB-1 MB", 1048576), ("> 1 MB", None)]


def size_bucket(size: Column) -> Column:
    """The five size classes of a mailbox report."""
    out = F
    for name, end in SIZES:
        out = out.when(size < end, name) if end else out.otherwise(name)
    return out


#: Patterns of personal data and indicators, without look-around, so that other engines can check them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "url": r"https?://[^\s<>\"]+",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
}


_EMAIL = PATTERNS["email"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
_IBAN = r"\b[A-Z]{2}\d{2}\s?[\dA-Z]{4}\s?[\dA-Z]{4}\s?[\dA-Z]{4}(?:\s?[\dA-Z]{4}){0,4}\s?[\dA-Z]{0,4}\b"
#: The nine kinds of personal data; cards also need a check digit, and addresses must not be private.
PERSONAL = {
    "email": _EMAIL,
    "phone": _PHONE,
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}\b",
    "card": _CARD,
    "ipv4": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "passport": r"(?i)(?:passport)\s*#?\s*:?\s*[A-Z]\d{8}\b",
    "birth": r"(?i)(?:d\.?o\.?b\.?|date\s*of\s*birth|born|birthday)\s*:?\s*\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}",
    "licence": r"(?i)(?:driver'?s?\s*(?:license|lic|licence)|DL)\s*#?\s*:?\s*[A-Z]?\d{6,14}\b",
    "iban": _IBAN,
}
#: The six replacements of redaction, in their order; without look-around, so that other engines can check them.
REPLACEMENTS = (("EMAIL", _EMAIL), ("PHONE", _PHONE), ("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"), ("CARD", _CARD), ("PASSPORT", r"\b[A-Z]\d{8}\b"), ("IBAN", _IBAN))


def findings(text: Column, kind: str) -> Column:
    """All matches of a kind of personal data or indicator, as array<string>; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.array().cast("array<string>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    plain = F.reverse(F.regexp_replace(digits, "[^0-9]", ""))
    each = F.transform(F.split(plain, ""), lambda d, i: F.when(i % 2 == 1, (2 * d.try_cast("int")) % 10 + F.floor(2 * d.try_cast("int") / 10)).otherwise(d.try_cast("int")))
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (F.length(plain) >= 12) & (total % 10 == 0)


def redact(text: Column) -> Column:
    """Addresses, numbers of persons, and network addresses replaced by their kind, in this order."""
    for kind in ("email", "ssn", "ipv4"):
        text = F.regexp_replace(text, PATTERNS[kind], f"[{kind.upper()}]")
    return text


def private_address(c: Column) -> Column:
    """Whether an address is private, of this host, or zero."""
    return c.rlike(r"^(?:127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$)")


def personal_data(text: Column) -> Column:
    """All different findings of the nine kinds, as array<struct<kind, value>>; empty for null."""
    out = []
    for kind, pattern in PERSONAL.items():
        found = F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
        if kind == "card":
            found = F.filter(found, luhn)
        elif kind == "ipv4":
            found = F.filter(found, lambda x: ~private_address(x))
        name = F.lit(kind).alias("kind")
        out.append(F.transform(found, lambda x: F.struct(name, x.alias("value"))))  # noqa: B023
    return F.concat(*out)


def redact_personal(text: Column) -> Column:
    """The six kinds of REPLACEMENTS replaced by their names, in their order."""
    for kind, pattern in REPLACEMENTS:
        text = F.regexp_replace(text, pattern, f"[{kind} REDACTED]")
    return text


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length, null where their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Accented small letters and what they fold to.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded_tokens(text: Column) -> Column:
    """Tokens without accents; empty for null."""
    return tokens(F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN))


def any_words(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text as a whole token."""
    return F.arrays_overlap(folded_tokens(text), F.array(*[F.lit(w) for w in words]))


def all_words(text: Column, words: list[str]) -> Column:
    """Whether each of the words stands in the text as a whole token."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in words]), folded_tokens(text))) == 0


def _joined(c: Column) -> Column:
    low = F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(low, r"(?U)\s+", " ")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in one section of the text: runs of blanks are one, A-Z are folded, U+001E parts sections."""
    wanted = _joined(F.lit(phrase.replace("\x1e", " ")))
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\x1e"), lambda part: _joined(part).contains(wanted))


def near(text: Column, a: str, b: str, between: int) -> Column:
    """Whether tokens a and b stand with at most ``between`` tokens between them, in one pass over the tokens."""
    none = F.lit(None).cast("int")
    placed = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i")))

    def step(s: Column, x: Column) -> Column:
        is_a, is_b = x["w"] == a, x["w"] == b
        best = F.least(s["best"], F.when(is_a, x["i"] - s["b"]), F.when(is_b, x["i"] - s["a"]))
        return F.struct(F.when(is_a, x["i"]).otherwise(s["a"]).alias("a"), F.when(is_b, x["i"]).otherwise(s["b"]).alias("b"), best.alias("best"))

    best = F.aggregate(placed, F.struct(none.alias("a"), none.alias("b"), none.alias("best")), step)["best"]
    return F.coalesce(best <= between + 1, F.lit(False))


def keyword_snippet(text: Column, word: str, around: int = 20) -> Column:
    """The first place of a word, any case, with ``around`` characters on each side; null where it isn't."""
    at = F.locate(word.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(len(word) + around) + F.least(at - 1, F.lit(around))))


def message_anomalies(sender: Column, recipients: Column, body: Column, subject: Column, date: Column, ts: Column, attachments: Column) -> Column:
    """What is odd about a message's fields, in a fixed order; ``date`` is the field as written, ``ts`` its time.

    A date that is written and can't be read is invalid, a missing one isn't; a body of white space is empty.
    """
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    odd = [  # fixed values: the names and bounds of the report
        (missing(sender), "Missing From header"), (missing(recipients), "Missing To header"), (F.coalesce(body, F.lit("")).rlike(r"^[\s\u0085\p{Z}]*$"), "Empty body"),
        (F.length(subject) > 200, "Long subject"), (date.isNotNull() & effective_time(ts).isNull(), "Invalid date"), (attachments > 10, "Too many attachments"),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in odd]))


def message_hash(addresses: Column, ts: Column, subject: Column, body: Column) -> Column:
    """SHA-256 over sorted lower-case addresses, UTC time, and subject and body with blanks joined, parted by U+001E."""
    people = F.array_join(F.array_sort(F.array_distinct(F.transform(addresses, F.lower))), ",")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n]+", " "))
    stamp = F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.sha2(F.concat_ws("\x1e", people, stamp, flat(subject), flat(body)).cast("binary"), 256)


def readable_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rules whose pattern can be read, as (pattern without case, replacement taken literally)."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    compiled, out = SparkSession.active()._jvm.java.util.regex.Pattern, []
    for pattern, replacement in rules:
        try:
            compiled.compile(f"(?i){pattern}")
        except IllegalArgumentException:
            continue
        out.append((f"(?i){pattern}", replacement.replace("\\", r"\\").replace("$", r"\$")))
    return out


def redact_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after (pattern, replacement) rules, each over what the one before left.

    Patterns ignore case, replacements are literal, a pattern that can't be read is skipped.
    """
    for pattern, replacement in readable_rules(rules):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def rule_hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """How many matches ``redact_rules`` replaces in a text; none in a null one."""
    hits, text = F.lit(0), F.coalesce(text, F.lit(""))
    for pattern, replacement in readable_rules(rules):
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, replacement)
    return hits.cast("long")


def redact_message(df: DataFrame, fields: list[str], names: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``fields`` (texts) and ``names`` (an array of texts) redacted, and ``redactions``: the matches in all of them."""
    hits = F.lit(0).cast("long")
    for f in fields:
        hits = hits + rule_hits(F.col(f), rules)
    hits = hits + F.aggregate(F.coalesce(names, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, x: n + rule_hits(x, rules))
    out = {f: redact_rules(F.coalesce(f, F.lit("")), rules) for f in fields}
    return df.withColumns({"redactions": hits, **out, names: F.transform(names, lambda x: redact_rules(x, rules))})
