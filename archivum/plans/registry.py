"""The queries of the library's operators on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators import analytics as an
from archivum.operators import durable
from archivum.operators import review as rv
from archivum.operators import search as se
from archivum.sources import exports
from archivum.plans import casework, depth, finding, habits, inquiry, insight, proof, upkeep, watch  # noqa: F401  (fill the table)
from archivum.plans.base import QUERIES as _Q
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t
from archivum.streaming import capture


@_query("a01_count_and_span", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS senders FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return _t(s, d, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.countDistinct("o_custkey").alias("senders"))


@_query("a04_top_senders", "SELECT o_custkey AS sender, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, sender LIMIT 20")
def _(s, d):
    return an.top_k(_t(s, d, "orders").withColumnRenamed("o_custkey", "sender"), "sender", 20)


@_query("a06_sender_rollups", "SELECT o_custkey AS sender, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def _(s, d):
    return _t(s, d, "orders").groupBy(F.col("o_custkey").alias("sender")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("latest"))


@_query("a10_monthly_volume", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return _t(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@_query("a11_type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return _t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@_query("a13_size_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN b < 1024 THEN '< 1 KB' WHEN b < 10240 THEN '1-10 KB' WHEN b < 102400 THEN '10-100 KB' WHEN b < 1048576 THEN '100 KB-1 MB' ELSE '> 1 MB' END AS bucket FROM (SELECT octet_length(encode(text)) AS b FROM documents)) GROUP BY 1")
def _(s, d):
    return _t(s, d, "documents").groupBy(mail.size_bucket(F.octet_length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@_query("a14_heatmap", "SELECT CAST(w AS INTEGER) AS weekday, CAST(k AS INTEGER) AS slot, coalesce(n, 0) AS n FROM range(1, 8) a(w) CROSS JOIN range(0, 8) b(k) LEFT JOIN (SELECT dayofweek(ts) + 1 AS w2, hour(ts) // 3 AS k2, count(*) AS n FROM events GROUP BY 1, 2) ON w = w2 AND k = k2")
def _(s, d):
    return an.heatmap(_t(s, d, "events"), "ts")


@_query("a15_pair_volume", "SELECT least(o_custkey, l_suppkey) AS one, greatest(o_custkey, l_suppkey) AS other, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def _(s, d):
    return an.pair_volume(_t(s, d, "orders").join(_t(s, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_suppkey")


@_query("a16_hours", "SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(0, 24) a(h) LEFT JOIN (SELECT hour(ts) AS k, count(*) AS n FROM events GROUP BY 1) ON h = k")
def _(s, d):
    found = _t(s, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return s.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(found), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@_query("a17_running_stat", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    return _t(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@_query("a18_top_with_rest", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, user_id LIMIT 10) SELECT user_id, CAST(1 AS BIGINT) AS keys, n FROM t UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE user_id NOT IN (SELECT user_id FROM t)")
def _(s, d):
    return an.top_k_with_rest(_t(s, d, "events"), "user_id", 10)


@_query("w01_spikes", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT day, n, CASE WHEN row_number() OVER (ORDER BY day) > 7 AND count(*) OVER () >= 8 THEN n / avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS ratio FROM d) SELECT day, n, round(ratio, 6) AS ratio, coalesce(ratio > 2, false) AS spike FROM r")
def _(s, d):
    return an.spikes(an.daily(_t(s, d, "events"), "ts")).withColumn("ratio", F.round("ratio", 6))


@_query("w02_gaps", "WITH g AS (SELECT user_id, ts AS until, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events), k AS (SELECT *, date_diff('microsecond', since, until) / 86400000000.0 AS days FROM g WHERE since IS NOT NULL), z AS (SELECT user_id, avg(days) AS m, stddev_pop(days) AS sd, count(*) AS c FROM k GROUP BY 1) SELECT user_id, since, until, round(days, 6) AS days FROM k JOIN z USING (user_id) WHERE c + 1 >= 10 AND days > m + 3 * sd AND days > 3")
def _(s, d):
    return an.gaps(_t(s, d, "events"), "user_id", "ts").withColumn("days", F.round("days", 6))


@_query("w05_bursts", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT avg(n) AS mean, count(*) AS days FROM d) SELECT day, n, round(mean, 6) AS mean FROM d, m WHERE days >= 7 AND n > 2 * mean")
def _(s, d):
    return an.bursts(an.daily(_t(s, d, "orders"), "o_orderdate"), 2.0).withColumn("mean", F.round("mean", 6))


@_query("w06_trend", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), x AS (SELECT CAST(row_number() OVER (ORDER BY day) AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM d), t AS (SELECT regr_slope(y, x) AS slope, avg(y) AS mean, stddev_pop(y) AS sd FROM x) SELECT round(coalesce(slope, 0) / greatest(1, mean), 8) AS rate, CASE WHEN slope / greatest(1, mean) > 0.1 THEN 'increasing' WHEN slope / greatest(1, mean) < -0.1 THEN 'decreasing' WHEN sd / mean > 0.5 THEN 'volatile' ELSE 'stable' END AS direction FROM t")
def _(s, d):
    return an.trend(an.daily(_t(s, d, "events"), "ts")).withColumn("rate", F.round("rate", 8))


@_query("w08_new_senders", "SELECT o_custkey AS sender, min(o_orderdate) AS first, count(*) AS n FROM orders GROUP BY 1 HAVING min(o_orderdate) >= TIMESTAMP '1999-01-01'")
def _(s, d):
    return an.new_since(_t(s, d, "orders").withColumnRenamed("o_custkey", "sender"), "sender", "o_orderdate", F.lit("1999-01-01").cast("timestamp_ntz"))


@_query("w09_thread_positions", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS size FROM conversations")
def _(s, d):
    w = Window.partitionBy("conv_id")
    return _t(s, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("place"), F.count("*").over(w).alias("size"))


@_query("w13_cadence", "SELECT o_custkey AS sender, CASE WHEN g < 2 THEN 'daily' WHEN g < 10 THEN 'weekly' WHEN g < 35 THEN 'monthly' ELSE 'rare' END AS cadence FROM (SELECT o_custkey, date_diff('microsecond', min(o_orderdate), max(o_orderdate)) / 86400000000.0 / (count(*) - 1) AS g FROM orders GROUP BY 1 HAVING count(*) >= 2)")
def _(s, d):
    g = _t(s, d, "orders").groupBy(F.col("o_custkey").alias("sender")).agg((F.timestamp_diff("MICROSECOND", F.min("o_orderdate"), F.max("o_orderdate")) / 86_400_000_000).alias("span"), F.count("*").alias("n")).where("n >= 2")
    gap = F.col("span") / (F.col("n") - 1)
    return g.select("sender", F.when(gap < 2, "daily").when(gap < 10, "weekly").when(gap < 35, "monthly").otherwise("rare").alias("cadence"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Orders as messages: sender, type, date and attachments (lines)."""
    lines = _t(s, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("attachments"))
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("sender"), F.col("c_mktsegment").alias("subject"), F.col("o_orderpriority").alias("message_type"), F.col("o_orderdate").alias("ts"))
    return o.join(lines, "id", "left")


@_query("f25_operator_search", "SELECT o_orderkey AS id, c_name AS sender, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment ILIKE '%machin%' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-06-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND NOT c_name ILIKE '%77%'")
def _(s, d):
    return se.search(_messages(s, d), "subject:machin has:attachment after:1998-01-01 before:06/01/1999 -from:77", "subject").select("id", "sender", "ts")


@_query("f28_boolean_text", r"SELECT doc_id FROM documents WHERE (regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])idiot($|[^\p{L}\p{N}])') OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])scum')) AND NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])clown($|[^\p{L}\p{N}])')")
def _(s, d):
    return se.search(_t(s, d, "documents"), "idiot OR scum -clown", "text").select("doc_id")


@_query("f21_confirmed_unresolved", "SELECT doc_id, CASE WHEN l.toxic IS NULL THEN 'unresolved' ELSE 'confirmed' END AS answer FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR (d.lang = 'en' AND NOT coalesce(l.toxic = 1, false))")
def _(s, d):
    df = _t(s, d, "documents").select("doc_id", "lang").join(_t(s, d, "labels"), "doc_id", "left")
    groups = [se.Group("all", [[se.Condition(F.col("lang") == "en")]]), se.Group("exclude", [[se.Condition(F.col("toxic") == 1, reads_text=True)]])]
    yes, open_ = se.confirm(df, groups, F.col("toxic").isNotNull())
    return yes.select("doc_id", F.lit("confirmed").alias("answer")).unionByName(open_.select("doc_id", F.lit("unresolved").alias("answer")))


@_query("f31_regex_search", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bth[a-z]*tion\b')")
def _(s, d):
    return _t(s, d, "documents").where(F.col("text").rlike(r"(?i)\bth[a-z]*tion\b")).select("doc_id")


@_query("j04_only_in_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '1998-06-01')")
def _(s, d):
    return _t(s, d, "customer").join(_t(s, d, "orders").where("o_orderdate >= timestamp_ntz'1998-06-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@_query("j05_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def _(s, d):
    return _t(s, d, "supplier").join(_t(s, d, "lineitem").where("l_quantity >= 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@_query("j12_nearest", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM embeddings, q) SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 10")
def _(s, d):
    e = _t(s, d, "embeddings")
    return an.nearest(e, "vec_id", "embedding", e.where("vec_id = 0").first()["embedding"], 10)


@_query("t01_exact_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return an.exact_duplicates(docs, ["sha"], ["doc_id"]).select("doc_id", "copies", "kept")


@_query("t12_compare", "WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') SELECT o_custkey, CAST(nth AS INTEGER) AS nth, CASE WHEN a.nth IS NULL THEN 'b' WHEN b.nth IS NULL THEN 'a' ELSE 'both' END AS side FROM a FULL OUTER JOIN b USING (o_custkey, nth)")
def _(s, d):
    o = _t(s, d, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return an.compare(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey", "o_orderkey")


@_query("t13_personal_data", "SELECT doc_id, len(regexp_extract_all(text, '" + mail.PATTERNS["email"] + "')) AS emails, len(regexp_extract_all(text, '" + mail.PATTERNS["ipv4"] + "')) AS addresses FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.size(mail.findings(F.col("text"), "email")).cast("long").alias("emails"), F.size(mail.findings(F.col("text"), "ipv4")).cast("long").alias("addresses"))


@_query("t14_keyword_sweep", "SELECT w AS word, count(*) AS documents, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT w, len(regexp_extract_all(lower(text), w)) AS n FROM documents, (VALUES ('idiot'), ('license'), ('the')) v(w)) WHERE n > 0 GROUP BY 1")
def _(s, d):
    return an.keyword_sweep(_t(s, d, "documents"), "text", ["idiot", "license", "the"])


@_query("x07_index_text", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def _(s, d):
    return _t(s, d, "pages").select("page_id", F.md5(mail.index_text(F.col("html")).cast("binary")).alias("text_md5"))


@_query("x20_redact", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '" + mail.PATTERNS["email"] + "', '[EMAIL]', 'g'), '" + mail.PATTERNS["ssn"] + "', '[SSN]', 'g'), '" + mail.PATTERNS["ipv4"] + "', '[IPV4]', 'g')) AS redacted FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(mail.redact(F.col("text")).cast("binary")).alias("redacted"))


@_query("o02_bm25", r"WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents), r AS (SELECT doc_id, len(w) AS dl, len([x FOR x IN w IF x = 'idiot']) AS a, len([x FOR x IN w IF x = 'scum']) AS b FROM w), t AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r), z AS (SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score FROM r, t) SELECT doc_id, score FROM z WHERE score > 0")
def _(s, d):
    return an.bm25(_t(s, d, "documents"), "doc_id", "text", ["idiot", "scum"])


@_query("s10_keyset_page", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s, d):
    return an.keyset_page(_t(s, d, "events").select("event_id", "ts"), "ts", "event_id", 50, ("2024-01-15", 5000))


@_query("s12_even_sample", "SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn, greatest(1, count(*) OVER () // 500) AS step FROM events) WHERE (rn - 1) % step = 0 AND rn <= 500 * step")
def _(s, d):
    return rv.even_sample(_t(s, d, "events").select("event_id", "ts"), ["ts", "event_id"], 500)


@_query("w12_stamps", "SELECT o_orderkey, 'DOC' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 8, '0') AS label FROM orders")
def _(s, d):
    return rv.stamp(_t(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "DOC").select("o_orderkey", "label")


@_query("w03_new_keys", "WITH k AS (SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-02-01' AND o_orderkey % 10 = 0 THEN 1000000 + o_orderkey % 7 ELSE o_custkey END AS key, o_orderdate, o_orderkey FROM orders), r AS (SELECT key, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS c FROM k) SELECT key, count(*) AS hits FROM r GROUP BY key, c HAVING min(rn) > c - greatest(c // 10, 1) AND c >= 10 AND count(*) >= 3")
def _(s, d):
    o = _t(s, d, "orders")
    late = (F.col("o_orderdate") >= F.lit("2001-02-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 10 == 0)
    return rv.new_keys(o.withColumn("key", F.when(late, 1_000_000 + F.col("o_orderkey") % 7).otherwise(F.col("o_custkey"))), "key", ["o_orderdate", "o_orderkey"], 3)


@_query("w07_volume_trend", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT n, row_number() OVER (ORDER BY month) AS a, count(*) OVER () AS c FROM m), t AS (SELECT avg(n) FILTER (a > c - 3) AS recent, avg(n) FILTER (a <= greatest(1, c - 3)) AS earlier FROM p WHERE c >= 3) SELECT round(recent, 6) AS recent, round(earlier, 6) AS earlier, round((recent - earlier) / earlier, 6) AS change FROM t WHERE recent IS NOT NULL")
def _(s, d):
    months = _t(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return rv.volume_trend(months).select(*[F.round(c, 6).alias(c) for c in ("recent", "earlier", "change")])


@_query("w14_routines", "SELECT o_custkey, count(*) AS n, count(DISTINCT dayofweek(o_orderdate)) AS weekdays FROM orders GROUP BY 1 HAVING count(*) >= 4 AND (count(DISTINCT dayofweek(o_orderdate)) <= 2 OR count(*) >= 8)")
def _(s, d):
    return rv.routines(_t(s, d, "orders"), "o_custkey", "o_orderdate")


@_query("j07_reply_times", "WITH h AS (SELECT o_custkey, date_diff('microsecond', o_orderdate, l_shipdate) // 1000000 / 3600 AS hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_custkey, count(*) AS replies, round(avg(hours), 6) AS hours FROM h WHERE hours > 0 AND hours < 720 GROUP BY 1")
def _(s, d):
    return rv.reply_times(_t(s, d, "orders"), _t(s, d, "lineitem"), "o_orderkey", "o_orderdate", "l_orderkey", "l_shipdate", "o_custkey").withColumn("hours", F.round("hours", 6))


@_query("a25_contacts", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(0.6 * least(count(*) / 50, 1.0) + 0.4 * greatest(0.0, 1 - date_diff('microsecond', max(o_orderdate), TIMESTAMP '2000-01-01') // 86400000000 / 365), 6) AS activity FROM orders GROUP BY 1")
def _(s, d):
    return rv.contacts(_t(s, d, "orders"), "o_custkey", "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz")).withColumn("activity", F.round("activity", 6))


@_query("a22_cleanup", "SELECT count(*) AS rows, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates, count(*) FILTER (length(text) > 10000) AS large, count(*) FILTER (coalesce(trim(text) = '', true)) AS blank FROM documents")
def _(s, d):
    return rv.cleanup(_t(s, d, "documents"), "text", 10_000)


@_query("a19_set_fingerprint", "WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), l AS (SELECT " + ", ".join(f"CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT) AS l{i}" for i in range(4)) + " FROM h) SELECT count(*) AS n, " + ", ".join(f"CAST(coalesce(sum(l{i}), 0) % 18446744073709551616 AS VARCHAR) AS lane_{i}" for i in range(4)) + " FROM l")
def _(s, d):
    return exports.set_fingerprint(_t(s, d, "documents"), "doc_id")


@_query("t15_indicators", "SELECT kind, value, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{mail.PATTERNS[k]}')])) AS value FROM documents" for k in ("email", "ipv4", "md5")) + ") GROUP BY 1, 2")
def _(s, d):
    return rv.indicators(_t(s, d, "documents"), "doc_id", "text", ("email", "ipv4", "md5"))


@_query("t17_responsiveness", "SELECT doc_id, round(least((least(len(regexp_extract_all(lower(coalesce(text, '')), 'license')), 5) * 2.0 + least(len(regexp_extract_all(lower(coalesce(text, '')), 'report')), 5) * 1.0 + CASE WHEN contains(source, 'license') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(source, 'report') THEN 2.0 ELSE 0.0 END) / 10, 1.0), 6) AS score FROM documents")
def _(s, d):
    return rv.responsiveness(_t(s, d, "documents"), "doc_id", F.col("source"), F.col("text"), {"license": 2.0, "report": 1.0}).withColumn("score", F.round("score", 6))


@_query("t23_predictive_coding", r"WITH w AS (SELECT doc_id, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''])) AS w FROM documents), c AS (SELECT w, count(*) FILTER (toxic = 1) AS y, count(*) FILTER (toxic = 0) AS n FROM w JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT sum(y) AS ay, sum(n) AS an, count(*) AS v FROM c), m AS (SELECT w, ln((y + 1) / (ay + v)) - ln((n + 1) / (an + v)) AS g FROM c, t), z AS (SELECT doc_id, sum(g) AS g FROM w JOIN m USING (w) GROUP BY 1), p AS (SELECT ln(count(*) FILTER (toxic = 1) + 1) - ln(count(*) FILTER (toxic = 0) + 1) AS prior FROM labels) SELECT doc_id, round(coalesce(g, 0) + prior, 5) AS log_odds FROM documents LEFT JOIN z USING (doc_id), p")
def _(s, d):
    return rv.naive_bayes(_t(s, d, "documents"), _t(s, d, "labels"), "doc_id", "text", "toxic").withColumn("log_odds", F.round("log_odds", 5))


@_query("j11_nearest_centroid", "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY 1), s AS (SELECT vec_id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS similarity FROM embeddings, c) SELECT vec_id, label, similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) = 1")
def _(s, d):
    e = _t(s, d, "embeddings")
    return rv.nearest_centroid(e, "vec_id", "embedding", rv.centroids(e, "label", "embedding"), "label")


_EDGES = "g AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT a, b, count(*) AS weight FROM (SELECT * FROM g UNION ALL SELECT b, a FROM g) GROUP BY 1, 2)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("c")).join(_t(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("s")), F.col("o_orderkey") == F.col("l_orderkey"))


def _graph(s: SparkSession, d: str) -> DataFrame:
    return rv.edges(_lines(s, d), "c", "s")


@_query("a30_connection_strength", f"WITH {_EDGES} SELECT a AS node, count(*) AS neighbours, CAST(sum(weight) AS BIGINT) AS strength FROM e GROUP BY 1")
def _(s, d):
    return _graph(s, d).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("neighbours"), F.sum("weight").alias("strength"))


@_query("t26_hops", f"WITH {_EDGES}, n1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 'c1'), n2 AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM n1)) SELECT node, CAST(min(k) AS INTEGER) AS distance FROM (SELECT 'c1' AS node, 0 AS k UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2) GROUP BY 1")
def _(s, d):
    start = _t(s, d, "customer").where("c_custkey = 1").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    one = durable.materialize(_lines(s, d).select(F.col("c").alias("a"), F.col("s").alias("b")).where("a is not null and b is not null"), "hop-edges")
    return rv.hops(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))), start, 2)


@_query("t36_review_merge", "SELECT d.doc_id, coalesce(l.toxic, d.new) AS code, CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN l.toxic IS NULL THEN 'applied' WHEN l.toxic = d.new THEN 'same' ELSE 'conflict' END AS outcome FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS new FROM documents) d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    decisions = _t(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("code"))
    return rv.merge_codes(decisions, _t(s, d, "labels").withColumnRenamed("toxic", "code"), "doc_id")


@_query("o08_rank_fusion", "WITH a AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1), b AS (SELECT o_custkey, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY 1) SELECT o_custkey, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1")
def _(s, d):
    per = _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    ranked = [per.orderBy(F.desc(c), "o_custkey").limit(100).select("o_custkey", F.row_number().over(Window.orderBy(F.desc(c), "o_custkey")).alias("rank")) for c in ("n", "top")]
    return an.reciprocal_rank_fusion(ranked, "o_custkey").withColumn("score", F.round("score", 8))


@_query("g04_current_state", "SELECT user_id, event_id, ts, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 41 = 0 AND user_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    e = _t(s, d, "events").select("event_id", "ts", "user_id", "event_type")
    return capture.current(e, "user_id", "ts", e.where("event_type = 'error' and event_id % 41 = 0").select("user_id").distinct())


@_query("k08_load_file", "SELECT md5('þ' || doc_id || 'þ' || chr(20) || 'þ' || coalesce(lang, '') || 'þ' || chr(20) || 'þ' || regexp_replace(coalesce(text, ''), '\\r\\n|\\r|\\n', '®', 'g') || 'þ') AS line_md5 FROM documents")
def _(s, d):
    return _t(s, d, "documents").select(F.md5(exports.load_file_line(F.col("doc_id"), F.col("lang"), F.col("text")).cast("binary")).alias("line_md5"))


@_query("g08_streamed_hours", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    source = durable.fresh_path(s, "stream-source")
    events = _t(s, d, "events").select("ts", "event_type")
    events.write.parquet(source)
    counts = capture.windowed_counts(capture.replay(s, source, events.schema), "ts", "event_type", "1 hour")
    return capture.run_to_table(counts, durable.fresh_path(s, "stream-counts"), durable.fresh_path(s, "stream-state"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _Q.items() if sql}
