"""Times hidden in message fields, as microseconds since 1970, and the hops of Received fields; column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601 (FILETIME) and 1582 (version-1 UUID) to 1970, and the bounds of what counts as a time.
FROM_1601, FROM_1582 = 11_644_473_600, 12_219_292_800
SINCE_1990, SINCE_2000, SINCE_GMAIL = 631_152_000, 946_684_800, 1_099_000_000
YEAR = 366 * 86_400
#: Forms of dates in Received and Date fields.
DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm Z", "EEE, d MMM yy HH:mm:ss Z")


def _number(hexadecimal: Column) -> Column:
    """A number of up to 63 bits in hexadecimal digits."""
    return F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")


def _within(micros: Column, since: int) -> Column:
    """``micros`` if later than ``since`` and not more than a year ahead."""
    latest = F.unix_micros(F.current_timestamp()) + F.lit(YEAR * 1_000_000)
    return F.when((micros > since * 1_000_000) & (micros < latest), micros)


def _filetime(ticks: Column) -> Column:
    """Microseconds of a count of 100 ns since 1601; null outside 1990 to next year."""
    micros = F.floor(ticks / F.lit(10).cast("decimal(20,0)")).cast("long") - FROM_1601 * 1_000_000
    return _within(micros, SINCE_1990)


def thread_index(value: Column) -> Column:
    """Times of a Thread-Index: the conversation's start, then each reply; empty if it can't be read.

    Six bytes hold the upper part of the start; each further five bytes begin with a flag and 31 bits, which count 2**18 or,
    with the flag, 2**23 ticks of 100 ns since the entry before.
    """
    digits = F.hex(F.try_to_binary(F.trim(value), F.lit("base64")))
    start = _number(F.substring(digits, 1, 12)) * F.lit(1 << 16).cast("decimal(20,0)")
    count = F.greatest(F.lit(0), F.floor((F.length(digits) / 2 - 22) / 5)).cast("int")
    words = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: _number(F.substring(digits, 45 + 10 * i, F.lit(8))))
    half = F.lit(1 << 31).cast("decimal(20,0)")
    steps = F.transform(words, lambda w: F.when(w < half, w * (1 << 18)).otherwise((w - half) * (1 << 23)).cast("decimal(20,0)"))
    sums = F.transform(steps, lambda s, i: F.aggregate(F.slice(steps, 1, i + 1), start.cast("decimal(30,0)"), lambda a, x: (a + x).cast("decimal(30,0)")))
    every = F.concat(F.array(start.cast("decimal(30,0)")), sums)
    times = F.filter(F.transform(every, lambda t: _filetime(t)), lambda t: t.isNotNull())
    return F.when((F.length(digits) >= 44) & _filetime(start).isNotNull(), times).otherwise(F.array().cast("array<long>"))


def uuid_time(token: Column) -> Column:
    """The time in the first version-1 UUID of a text."""
    found = F.regexp_extract(token, r"([0-9a-fA-F]{8})-([0-9a-fA-F]{4})-1([0-9a-fA-F]{3})-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}", 0)
    ticks = _number(F.concat(F.substring(found, 16, 3), F.substring(found, 10, 4), F.substring(found, 1, 8)))
    return F.when(found != "", _within(F.floor(ticks / F.lit(10).cast("decimal(20,0)")).cast("long") - FROM_1582 * 1_000_000, SINCE_1990))


def outlook_boundary(boundary: Column) -> Column:
    """The FILETIME of a boundary: eight hexadecimal digits, a dot, eight more."""
    found = F.regexp_extract(boundary, r"([0-9A-Fa-f]{8})\.([0-9A-Fa-f]{8})", 0)
    return F.when(found != "", _filetime(_number(F.replace(found, F.lit("."), F.lit("")))))


def gmail_boundary(boundary: Column) -> Column:
    """28 digits: twelve zeros, six digits A, eight digits B, two more; B and A are microseconds, of which milliseconds count."""
    low = F.lower(boundary)
    micros = _number(F.concat(F.substring(low, 19, 8), F.substring(low, 13, 6)))
    return F.when(low.rlike("^0{12}[0-9a-f]{16}$"), _within(F.floor(micros / 1000).cast("long") * 1000, SINCE_2000))


def gmail_id(value: Column) -> Column:
    """A message or thread id, decimal or hexadecimal: without its last five hexadecimal digits, milliseconds."""
    v = F.trim(value)
    digits = F.when(v.rlike(r"^\d{1,19}$"), F.conv(v, 10, 16)).when(v.rlike(r"^[0-9a-fA-F]{1,16}$"), v)
    millis = _number(F.substring(digits, F.lit(1), F.length(digits) - 5)).cast("long")
    return F.when(F.length(digits) > 5, _within(millis * 1000, SINCE_GMAIL))


def epoch_time(token: Column) -> Column:
    """A count of 13 digits (milliseconds) or else 10 (seconds) that begins with 1, not inside a longer number."""
    millis, seconds = (F.regexp_extract(token, rf"(?<!\d)(1\d{{{n}}})(?!\d)", 1) for n in (12, 9))
    return F.coalesce(_within(F.when(millis != "", millis).cast("long") * 1000, SINCE_2000), _within(F.when(seconds != "", seconds).cast("long") * 1_000_000, SINCE_2000))


def boundaries(raw: Column) -> Column:
    """The different MIME boundaries that a message's source names, in order."""
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(r'(?i)boundary="?([^";\r\n]+)'), F.lit(1)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mail_date(text: Column) -> Column:
    """The instant of a date as in mail fields, comments at its end left out; null if it has none of the known forms."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")), r"\s+", " ")
    plain = F.regexp_replace(plain, r" (GMT|UTC|UT)$", " +0000")
    # the day's name says nothing that the date doesn't
    plain = F.regexp_replace(plain, r"^[A-Za-z]{3}, ?", "")
    forms = dict.fromkeys(f.removeprefix("EEE, ") for f in DATES)
    # every form begins with a digit: what doesn't is not tried, as each trial that fails costs an exception
    return _bound(plain, lambda p: F.when(p.rlike("^[0-9]"), F.coalesce(*[F.try_to_timestamp(p, F.lit(f)) for f in forms])))


def received_hops(raw: Column) -> Column:
    """The hops of a message in the order it travelled: array of (from_, by, with_, micros, delay in seconds to the one before).

    Folded lines are joined; only the part before the first blank line counts.  ``delay`` is null where a time is missing.
    """
    head = F.substring_index(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n\n", 1)
    lines = F.split(F.regexp_replace(head, r"\n[ \t]+", " "), "\n")
    fields = F.reverse(F.transform(F.filter(lines, lambda x: F.lower(x).startswith("received:")), lambda x: F.trim(F.substring(x, F.lit(10), F.length(x)))))

    def clause(field: Column, word: str) -> Column:
        return F.regexp_extract(field, rf"(?i)\b{word}\s+([^\s;()]+)", 1)

    hops = F.transform(fields, lambda f: F.struct(clause(f, "from").alias("from_"), clause(f, "by").alias("by"), clause(f, "with").alias("with_"), F.unix_micros(mail_date(F.trim(F.element_at(F.split(f, ";"), -1)))).alias("micros")))
    return _bound(hops, lambda every: F.transform(every, lambda h, i: F.struct(h["from_"].alias("from_"), h["by"].alias("by"), h["with_"].alias("with_"), h["micros"].alias("micros"), ((h["micros"] - F.get(every, i - 1)["micros"]) / 1_000_000).alias("delay"))))
