"""Threat scores, verification by fields, roles, capture filters, seals and readable pages on planted values."""

from pyspark.sql import functions as F

from archivum.operators import evidence as ev


def test_readable_pages(spark):
    pages = [
        ("<html><head><title>x</title></head><body><p>a &amp;lt; b</p><br/>c&nbsp;&#8364;&#x1F600;&#xD800;&bogus; & d</body>", "a &lt; b\n\nc €😀&#xD800;&bogus; & d"),
        ("<STYLE>p{}</STYLE><!-- a <p>b</p> -->x<script>\n1<2</script >y", "xy"),
        ("  <div> one </div>\n\n\n\n<div>two</div>", "one\n\ntwo"),
        ("&AMP;&Eacute;&lt;b&gt;", "&&Eacute;<b>"),
        (None, ""),
        ("", ""),
        ("no tags", "no tags"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(ev.readable_html(F.col("h"))).collect()]
    assert got == [t for _, t in pages]


def test_threat_scores(spark):
    rows = [
        ("a@x.org", None, None, "spf=pass dkim=pass dmarc=pass", ["by z with TLS1.3"], 0),
        ("A <a@x.xyz>", "<b@y.org>", "c@z.org", "SPF=softfail; DKIM=fail; DMARC=fail", None, 10),
        (None, None, None, None, [], 3),
        ("a@x.org", "<q@x.org>", "", "spf=fail spf=pass", ["esmtps"], 1),
    ]
    df = spark.createDataFrame(rows, "s string, r string, p string, a string, v array<string>, n int")
    assert all(r[0] == r[1] for r in df.select(ev.threat_score(*[F.col(c) for c in "srpav"]), "n").collect())


def _verdict(spark, rows):
    df = spark.createDataFrame(rows, "g string, raw string, parsed boolean, who string, files array<struct<digest:string,name:string>>")
    got = ev.verify_fields(df, "g", F.col("raw"), F.col("parsed"), {"from": ev.addresses(F.col("who"))}, F.col("files")).collect()
    return {r.group: (r.n, r.verdict, r.differences) for r in got}


def test_verification_by_fields(spark):
    rows = [
        ("bytes", "x", False, "a", None), ("bytes", "x", True, "b", None),
        ("ends", "x\r\n", True, "a", None), ("ends", "x\n", True, "a", None),
        ("unread", None, False, "a", None), ("unread", "y", True, "a", None),
        ("same", None, True, "B <b@x>, A@x", [("1", "f"), ("2", "g")]), ("same", "z", True, "a@x b@x", [("2", "g"), ("1", "f")]),
        ("swap", None, True, "a", [("1", "f"), ("2", "g")]), ("swap", None, True, "a", [("2", "f"), ("1", "g")]),
        ("lost", None, True, "a", [(None, "f")]), ("lost", None, True, "a", [("1", "f")]),
        ("who", None, True, "a@x", []), ("who", None, True, "c@x", []),
        ("one", "x", True, "a", None), (None, "x", True, "a", None), (None, "x", True, "a", None),
    ]
    assert _verdict(spark, rows) == {
        "bytes": (2, "byteIdentical", []), "ends": (2, "contentEquivalent", []), "unread": (2, "candidate", ["body", "structure"]), "same": (2, "contentEquivalent", []),
        "swap": (2, "candidate", ["attachments"]), "lost": (2, "candidate", ["attachmentBytes"]), "who": (2, "candidate", ["from"]),
    }


def test_roles_and_captured_copies(spark):
    people = [[("TO", "ann@x.org", "Ann"), ("BCC", "bob@x.org", None)], None, []]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(people)], "i long, p array<struct<role:string,address:string,name:string>>")
    find = lambda *a: [r.i for r in df.where(ev.participant(F.col("p"), *a)).collect()]
    assert find("ANN") == find("bob") == [0] and find("bob", ("TO", "CC")) == [] and find("ann@x", ("TO",), True) == [] and find("Ann@X.org", ("TO",), True) == [0]
    remote = spark.createDataFrame([(0, "k", True), (0, "m", False), (1, "k", False)], "i long, account string, present boolean")
    kept = lambda **k: sorted(r.i for r in ev.capture_filter(df, remote, "i", **k).collect())
    assert kept(kind="connected") == [0, 1] and kept(kind="file") == [2] and kept(kind="odd") == kept(state="odd") == []
    assert kept(state="removedOnServer") == [0, 1] and kept(state="onServer", account="m") == [] and kept(account="m", kind="connected") == [0]


def test_seals_are_set_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i long, t string")
    held, sealed = ev.seals(df.where("i < 3"), spark.createDataFrame([], "i long"), spark.createDataFrame([], "i long, seal string"), "i", F.col("t"))
    later = spark.createDataFrame([(1, "b"), (3, "c"), (2, "")], "i long, t string")
    held, sealed = ev.seals(later, held, sealed, "i", F.col("t"))
    assert sorted(r.i for r in held.collect()) == [1, 2, 3]
    assert {r.i: r.status for r in ev.verify_seals(later.where("i < 3"), sealed, "i", F.col("t")).collect()} == {1: "changed", 2: "intact", 3: "missing"}
