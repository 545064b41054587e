"""Queries of case work, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from archivum.operators import casework as cw
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t


@_query("f10_attachment_group", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND 'part-' || l_partkey LIKE '%part-1%' AND l_returnflag = 'R' AND 'line ' || l_suppkey LIKE '%line 2%')")
def _(s, d):
    files = F.struct(F.concat(F.lit("Part-"), "l_partkey").alias("name"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("line "), "l_suppkey").alias("content"))
    lines = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(files).alias("attachments"))
    return lines.where(cw.attachment_group(F.col("attachments"), "part-1", "r", "line 2")).select("id")


@_query("f18_snapshot", "SELECT event_id, user_id FROM events WHERE event_id <= 500")
def _(s, d):
    return cw.snapshot(_t(s, d, "events"), "event_id", 500).select("event_id", "user_id")


@_query("f35_custodian", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_name LIKE '%#00000001%' OR o_clerk LIKE '%#00000001%') AND (o_orderkey % 10 = 0 OR (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01'))".replace("o_clerk", "c_mktsegment"))
def _(s, d):
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ts = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return cw.custodian(o, ["#00000001"], F.col("c_name"), F.col("c_mktsegment"), ts, datetime.datetime(1995, 1, 1), datetime.datetime(1996, 1, 1)).select(F.col("o_orderkey").alias("id"))


@_query("j03_fallback_match", """WITH d AS (SELECT doc_id, doc_id % 2 AS side, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS k, lang || (n_chars // 50) AS f FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY side, k ORDER BY doc_id) AS n FROM d WHERE k IS NOT NULL),
x AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.k = b.k AND a.n = b.n WHERE a.side = 0 AND b.side = 1), r AS (SELECT *, row_number() OVER (PARTITION BY side, f ORDER BY doc_id) AS n FROM d WHERE f IS NOT NULL AND doc_id NOT IN (SELECT a FROM x) AND doc_id NOT IN (SELECT b FROM x))
SELECT a, b, 'key' AS how FROM x UNION ALL SELECT a.doc_id, b.doc_id, 'fallback' FROM r a JOIN r b ON a.f = b.f AND a.n = b.n WHERE a.side = 0 AND b.side = 1""")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.md5(F.col("text").cast("binary"))).alias("k"), F.concat("lang", F.expr("n_chars div 50").cast("string")).alias("f"))
    return cw.match_with_fallback(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "k", "f")


_RAW = "CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN text || '.' ELSE text END"


@_query("t02_verification", f"WITH r AS (SELECT md5(text) AS g, sha256({_RAW}) AS w, sha256(replace({_RAW}, chr(13) || chr(10), chr(10))) AS p FROM documents) SELECT g AS \"group\", count(*) AS n, CASE WHEN count(DISTINCT w) = 1 THEN 'byteIdentical' WHEN count(DISTINCT p) = 1 THEN 'contentEquivalent' ELSE 'candidate' END AS verdict FROM r WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1")
def _(s, d):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return cw.verify_groups(_t(s, d, "documents").withColumn("g", F.md5(F.col("text").cast("binary"))), "g", raw)


@_query("a24_review_progress", "SELECT count(*) AS total, count(toxic) AS coded, count(*) - count(toxic) AS remaining, round(count(toxic) / count(*), 6) AS progress, round((count(*) - count(toxic)) * 12.0 / 60, 6) AS minutes_left FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    found = cw.review_progress(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left"), F.col("toxic"), 12.0)
    return found.withColumns({c: F.round(c, 6) for c in ("progress", "minutes_left")})


@_query("a25_contact_activity", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(0.6 * least(count(*) / 50.0, 1.0) + 0.4 * greatest(0.0, 1 - date_diff('second', max(o_orderdate), TIMESTAMP '1998-09-01') / 86400.0 / 365), 6) AS activity FROM orders GROUP BY 1")
def _(s, d):
    return cw.contact_activity(_t(s, d, "orders"), "o_custkey", "o_orderdate", datetime.datetime(1998, 9, 1)).withColumn("activity", F.round("activity", 6))


@_query("a31_side_statistics", "SELECT o_orderstatus AS side, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT lower(trim(c_name))) AS senders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("o_orderstatus", "side")
    return cw.side_statistics(o, "side", "c_name", "o_orderdate")


@_query("t10_hubs", "SELECT o_custkey AS sender, count(DISTINCT l_suppkey) AS recipients FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 10 ORDER BY recipients DESC, sender LIMIT 5")
def _(s, d):
    return cw.hubs(_t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_suppkey")


@_query("w12_unnumbered", "WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS number FROM orders) SELECT o_orderkey, number FROM o WHERE number IS NOT NULL UNION ALL SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + (SELECT max(number) FROM o) FROM o WHERE number IS NULL")
def _(s, d):
    o = _t(s, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("number"))
    return cw.number_unnumbered(o, "number", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@_query("x06_thread_ids", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'r' || doc_id // 8 WHEN doc_id % 4 = 1 THEN 'p' || doc_id // 8 WHEN doc_id % 4 = 2 THEN 'm' || doc_id ELSE sha1(lang || source || '' || left(coalesce(text, ''), 80)) END AS thread FROM documents")
def _(s, d):
    k, tens = F.col("doc_id"), F.floor(F.col("doc_id") / 8).cast("string")
    refs = F.when(k % 4 == 0, F.concat(F.lit("r"), tens, F.lit(" other"))).otherwise("")
    out = cw.thread_id(refs, F.when(k % 4 == 1, F.concat(F.lit("p"), tens)), F.when(k % 4 == 2, F.concat(F.lit("m"), k)), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return _t(s, d, "documents").select("doc_id", out.alias("thread"))


@_query("x10_fallback_times", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 HOUR WHEN o_orderkey % 3 = 1 THEN o_orderdate END AS ts FROM orders")
def _(s, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    received = F.when(k % 3 == 0, F.concat(F.lit("from a; by b; "), day, F.lit(" +0200"))).otherwise("from a by b")
    return _t(s, d, "orders").select(k.alias("id"), cw.fallback_time(received, F.when(k % 3 == 1, F.col("o_orderdate"))).alias("ts"))
