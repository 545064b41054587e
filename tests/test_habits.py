from pyspark.sql import functions as F

from archivum.operators import habits as hb

MAIL = "id long, sender string, ts timestamp_ntz, body string, message_id string, reply string, unsubscribe boolean, bulk boolean, route string"


def _subscriptions(spark, rows):
    df = spark.createDataFrame(rows, MAIL)
    return {r.domain: r for r in hb.subscriptions(df.withColumn("ts", F.col("ts")), "id", *(F.col(c) for c in ("sender", "ts", "body", "message_id", "reply", "unsubscribe", "bulk", "route"))).collect()}


def test_bulk_senders(spark):
    from datetime import datetime, timedelta

    t = lambda d: datetime(2024, 3, 1) + timedelta(days=d)
    rows = [
        (1, "Shop <a@SHOP.example>", t(0), "Big Sale", "s1", None, True, None, None), (2, "b@shop.example", t(3), "your order", "s2", "s1", None, None, None),
        (4, "x@store.example", None, "order 7", None, None, None, None, "Received: by X.SENDGRID.net"), (3, "x@store.example", t(1), "your RECEIPT", None, None, None, None, None),
        (5, "n@news.example", t(0), "hello", "n1", "n1", None, True, None), (6, "n@news.example", t(30), "unsubscribe here", "n1", None, None, None, None),
        (7, "one@rare.example", t(0), "sale", "r", None, True, True, None), (8, "a@friend.example", t(0), "hi", "f1", None, None, None, None), (9, "a@friend.example", t(1), "hi", "f2", None, None, None, None),
        (10, None, t(0), None, None, None, None, None, None), (11, "no address", t(0), "sale", None, None, True, None, None),
        *((20 + i, "p@many.example", t(i), None, None, None, None, None, None) for i in range(5)),
    ]
    found = _subscriptions(spark, rows)
    assert {d: (r.n, r.category, r.cadence, r.has_unsubscribe, r.engagement) for d, r in found.items()} == {
        "shop.example": (2, "promotion", "weekly", True, 0.5), "store.example": (2, "transaction", "irregular", False, 0.0),
        "news.example": (2, "newsletter", "monthly", True, 1.0), "many.example": (5, "unknown", "daily", False, 0.0),
    }
    assert _subscriptions(spark, []) == {}


def test_habits_of_few_rows(spark):
    rows = [("2024-01-06 09:10:00",), ("2024-01-07 08:00:00",), ("2024-03-04 08:30:00",), ("2024-03-05 09:00:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp_ntz("t").alias("ts"))
    assert tuple(hb.habits(df, "ts").first()) == (8, 2, "Sun", 1, 2, 50, 2, 2, 0)
    assert tuple(hb.habits(df.where("ts is null"), "ts").first()) == (None, None, None, None, 0, None, None, None, None)


def test_headers_that_do_not_fit(spark):
    rows = [(1, None, "a@x.example", "b@y.example", None, None, [], "s", "text/plain; charset=VISCII"), (2, "m", None, None, "", None, None, "", None), (3, "m", "a@x.example", "<a@X.example>", "d", "2024-01-10", ["2024-01-10", None, "2024-01-01", "2024-02-20"], "s", "charset=utf-8")]
    df = spark.createDataFrame(rows, "id int, m string, f string, p string, text string, d string, r array<string>, s string, kind string")
    df = df.withColumns({"d": F.to_timestamp_ntz("d", F.lit("yyyy-MM-dd")), "r": F.transform("r", lambda x: F.to_timestamp_ntz(x, F.lit("yyyy-MM-dd"))), "severity": F.lit("clash")})
    got = hb.metadata_anomalies(df, *(F.col(c) for c in ("m", "f", "p", "text", "d", "r", "s", "kind")))
    assert sorted((r.id, r.anomaly, round(r.severity, 6)) for r in got.collect()) == [(1, "domain_mismatch", 0.7), (1, "missing_id", 0.6), (1, "rare_charset", 0.5), (2, "stripped", 0.8), (3, "date_ahead", 1.0)]
    assert got.where("false").count() == 0
