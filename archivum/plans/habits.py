"""Queries of bulk senders, habits and headers that don't fit together."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.operators import habits as hb
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t


@_query("t28_subscriptions", """WITH m AS (SELECT doc_id, CASE source WHEN 'src3' THEN 'reddit.com' WHEN 'src5' THEN 'linkedin.com' ELSE source || '.example' END AS domain, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id * (1 + doc_id % 20)) AS ts, lower(coalesce(text, '')) AS t, 'm' || doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'm' || (doc_id - 20) END AS reply,
doc_id % 400 = 7 AS unsub, doc_id % 400 IN (1, 7) AS bulk, CASE WHEN doc_id % 100 = 9 THEN 'by mail7.sendgrid.net' ELSE '' END AS route FROM documents WHERE source IS NOT NULL),
g AS (SELECT domain, count(*) AS n, bool_or(unsub OR bulk) AS listed, bool_or(contains(route, 'sendgrid.net')) AS platform, bool_or(unsub OR contains(t, 'unsubscribe')) AS has_unsubscribe, min(ts) AS since, max(ts) AS last, arg_min(contains(t, 'sale') OR contains(t, '% off') OR contains(t, 'discount') OR contains(t, 'promo'), doc_id) AS promo, arg_min(contains(t, 'order') OR contains(t, 'receipt') OR contains(t, 'invoice') OR contains(t, 'shipping'), doc_id) AS trans FROM m GROUP BY 1),
a AS (SELECT domain, count(*) AS k FROM m WHERE EXISTS (SELECT 1 FROM m r WHERE r.domain = m.domain AND r.reply = m.id) GROUP BY 1), x AS (SELECT *, date_diff('second', since, last) / 86400.0 / (n - 1) AS gap FROM g LEFT JOIN a USING (domain) WHERE n >= 2 AND (listed OR has_unsubscribe OR platform OR domain IN ('reddit.com', 'linkedin.com') OR n >= 5))
SELECT domain, n, CASE WHEN domain IN ('reddit.com', 'linkedin.com') THEN 'social' WHEN listed AND NOT has_unsubscribe THEN 'notification' WHEN promo THEN 'promotion' WHEN trans THEN 'transaction' WHEN listed OR platform THEN 'newsletter' ELSE 'unknown' END AS category, CASE WHEN gap < 2 THEN 'daily' WHEN gap < 10 THEN 'weekly' WHEN gap < 35 THEN 'monthly' ELSE 'irregular' END AS cadence, has_unsubscribe, last, round(coalesce(k, 0) / n, 6)::DOUBLE AS engagement FROM x""")
def _(s, d):
    k, source = F.col("doc_id"), F.col("source")
    name = F.when(source == "src3", "Reddit@REDDIT.com").when(source == "src5", "news@linkedin.com").otherwise(F.concat(F.lit("Info <info@"), source, F.lit(".example>")))
    m = _t(s, d, "documents").withColumn("hours", (k * (1 + k % 20)).cast("int"))
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hours"))
    reply = F.when(k % 4 == 1, F.concat(F.lit("m"), (k - 20).cast("string")))
    found = hb.subscriptions(m, "doc_id", name, ts, F.col("text"), F.concat(F.lit("m"), k.cast("string")), reply, k % 400 == 7, k % 400 == 1, F.when(k % 100 == 9, "by mail7.sendgrid.net"))
    return found.withColumn("engagement", F.round("engagement", 6))


@_query("t28_habits", """WITH m AS (SELECT o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24 * (o_custkey % 3) // 2) AS ts FROM orders), h AS (SELECT hour(ts) AS k, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, k LIMIT 1), d AS (SELECT dayofweek(ts) AS k, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, k LIMIT 1),
w AS (SELECT count(*) FILTER (dayofweek(ts) IN (0, 6)) AS weekend, count(*) AS n FROM m), b AS (SELECT date_trunc('month', ts) AS k, count(*) AS n, row_number() OVER (ORDER BY date_trunc('month', ts) DESC) AS rn FROM m GROUP BY 1), r AS (SELECT sum(n) FILTER (rn <= 3) // 3 AS recent, sum(n) FILTER (rn BETWEEN 4 AND 6) // 3 AS older FROM b)
SELECT h.k AS peak_hour, h.n AS peak_hour_n, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][d.k + 1] AS peak_day, d.n AS peak_day_n, weekend, 100 * weekend // w.n AS weekend_percent, recent::BIGINT AS recent, older::BIGINT AS older, trunc((recent - older) / older * 100)::BIGINT AS change_percent FROM h, d, w, r""")
def _(s, d):
    c = F.col("o_custkey")
    hours = F.floor(c % 24 * (c % 3) / 2).cast("int")
    return hb.habits(_t(s, d, "orders").withColumn("hours", hours).select((F.col("o_orderdate") + F.make_dt_interval(hours=F.col("hours"))).alias("ts")), "ts")


@_query("t09_metadata_anomalies", """WITH m AS (SELECT o_orderkey AS k, o_orderdate AS t, CASE WHEN o_orderkey % 11 > 0 THEN 'm' END AS id, CASE WHEN o_orderkey % 19 > 0 THEN 'o' || o_custkey % 7 || '.example' END AS f, CASE WHEN o_orderkey % 5 < 2 THEN 'o' || o_custkey % 14 || '.example' END AS p, o_orderkey % 17 > 0 AS dated, o_orderkey % 3 > 0 AS titled, o_orderkey % 23 = 4 AS rare FROM orders),
g AS (SELECT *, CASE WHEN NOT dated THEN NULL WHEN (k % 13 - 6) * 16 < -24 THEN (6 - k % 13) * 16 WHEN k % 29 * 18 > 168 THEN k % 29 * -18 END AS gap, f IS NULL AND NOT dated AND NOT titled AS three, (f IS NULL)::INT + (NOT dated)::INT + (NOT titled)::INT AS gone FROM m)
SELECT k AS o_orderkey, 'missing_id' AS anomaly, 0.6::DOUBLE AS severity FROM g WHERE id IS NULL UNION ALL SELECT k, 'domain_mismatch', 0.7 FROM g WHERE f <> p UNION ALL SELECT k, 'date_ahead', round(least(1.0, gap / 168.0), 6)::DOUBLE FROM g WHERE gap > 0 UNION ALL SELECT k, 'date_behind', round(least(1.0, gap / -720.0), 6)::DOUBLE FROM g WHERE gap < 0
UNION ALL SELECT k, 'stripped', round(0.5 + gone * 0.1, 6)::DOUBLE FROM g WHERE gone >= 2 UNION ALL SELECT k, 'rare_charset', 0.5 FROM g WHERE rare""")
def _(s, d):
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    o = _t(s, d, "orders").withColumns({"first": (-(k % 13 - 6) * 16).cast("int"), "second": (k % 29 * 18).cast("int")})
    received = F.array(t - F.make_dt_interval(hours=F.col("first")), t + F.make_dt_interval(hours=F.col("second")))
    sender = F.when(k % 19 > 0, F.concat(F.lit("A <a@O"), (c % 7).cast("string"), F.lit(".Example>")))
    path = F.when(k % 5 < 2, F.concat(F.lit("<back@o"), (c % 14).cast("string"), F.lit(".example>")))
    date = F.when(k % 17 > 0, t)
    found = hb.metadata_anomalies(o, F.when(k % 11 > 0, F.lit("m")), sender, path, date.cast("string"), date, received, F.when(k % 3 > 0, F.lit("hello")).otherwise(""), F.when(k % 23 == 4, F.lit("text/plain; charset=UTF-7")).otherwise("text/plain; charset=utf-8"))
    return found.select("o_orderkey", "anomaly", F.round("severity", 6).alias("severity"))
