import re

from pyspark.sql import functions as F

from archivum.functions import mail

TEXTS = [
    None,
    "",
    "a@b.org, a@b.org and c@d.com; call +1 555-123-4567 or (555) 123 4567",
    "ssn 123-45-6789, 000-12-3456, 666-12-3456, 123-00-4567",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "hosts 10.0.0.1 172.16.3.4 172.32.3.4 192.168.1.1 127.0.0.1 0.0.0.0 8.8.8.8 300.1.1.1",
    "Passport #: X12345678, X87654321; DOB: 1/2/1990, born 03.04.85",
    "driver's license: D1234567, DL 12345678; GB82 WEST 1234 5698 7654 32, DE89370400440532013000",
]


def _luhn(value):
    digits = [int(x) for x in re.sub("[^0-9]", "", value)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _public(value):
    a, b, *_ = octets = [int(x) for x in value.split(".")]
    return any(octets) and a not in (10, 127) and (a, b) != (192, 168) and not (a == 172 and 16 <= b <= 31)


def test_nine_kinds_of_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: {(f.kind, f.value) for f in r.found} for r in df.select("id", mail.personal_data(F.col("text")).alias("found")).collect()}
    for i, text in enumerate(TEXTS):
        want = {(k, m.group()) for k, p in mail.PERSONAL.items() for m in re.finditer(p, text or "", re.ASCII)}
        assert got[i] == {(k, v) for k, v in want if (k != "card" or _luhn(v)) and (k != "ipv4" or _public(v))}
    assert {k for x in got.values() for k, _ in x} == set(mail.PERSONAL)
    assert {v for x in got.values() for k, v in x if k == "ipv4"} == {"172.32.3.4", "8.8.8.8"}
    assert {v for x in got.values() for k, v in x if k == "card"} == {"4111 1111 1111 1111"}


def test_redaction_replaces_six_kinds(spark):
    text = "a@b.org, 555-123-4567, 123-45-6789, X12345678, 4111 1111 1111 1111, DE89 AAAA BBBB CCCC"
    got = spark.createDataFrame([(text,), (None,)], "text string").select(mail.redact_personal(F.col("text"))).collect()
    want = text
    for kind, pattern in mail.REPLACEMENTS:
        want = re.sub(pattern, f"[{kind} REDACTED]", want, flags=re.ASCII)
    assert [r[0] for r in got] == [want, None]
    assert not re.search(r"4111|X1234|555|6789|a@b|DE89", want)
