"""Queries of accounts, threads, bridges, patterns, hashes and page cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.operators import accounts as ac
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t

_TO_SQL = "[('r' || (user_id % 3 + i * (CASE WHEN event_id % 5 = 0 AND user_id % 4 = 1 THEN 3 ELSE 1 END) + CASE WHEN ts >= TIMESTAMP '2024-01-16' AND user_id % 2 = 0 THEN 100 ELSE 0 END)) FOR i IN range(0, CASE WHEN user_id % 6 = 3 AND event_id % 2 = 0 THEN 12 ELSE 2 + event_id % 2 END)]"


@_query("t22_compromised", f"""WITH m AS (SELECT event_id, user_id AS account, ts, list_distinct({_TO_SQL}) AS recipients, user_id % 7 = 2 AND event_id % 50 = 1 AS shift FROM events), e AS (SELECT account, count(*) AS n, count(*) FILTER (hour(ts) < 5) AS night, bool_or(shift) AS shift, min(ts) AS since, max(ts) AS until FROM m GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT m.*, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY account) AS dated FROM m), w AS (SELECT account, count(*) AS wide FROM p WHERE rn > dated - 20 AND len(recipients) > 10 GROUP BY 1), x AS (SELECT account, rn <= dated // 2 AS early, unnest(recipients) AS r FROM p WHERE dated >= 10),
y AS (SELECT account, r, bool_or(early) AS early FROM x GROUP BY 1, 2), z AS (SELECT account, count(*) FILTER (early) AS known, count(*) FILTER (NOT early) AS fresh FROM y GROUP BY 1),
s AS (SELECT account, n, since, until, night >= 3 AS a, shift AS b, coalesce(fresh >= 5 AND known > 0 AND fresh / known > 0.5, false) AS c, coalesce(wide >= 3, false) AS d FROM e LEFT JOIN w USING (account) LEFT JOIN z USING (account))
SELECT account, n, round(CASE WHEN a THEN 0.25 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END + CASE WHEN c THEN 0.3 ELSE 0 END + CASE WHEN d THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence, concat_ws(',', CASE WHEN a THEN 'hours' END, CASE WHEN b THEN 'tone' END, CASE WHEN c THEN 'recipients' END, CASE WHEN d THEN 'groups' END) AS indicators, since, until FROM s
WHERE CASE WHEN a THEN 0.25 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END + CASE WHEN c THEN 0.3 ELSE 0 END + CASE WHEN d THEN 0.2 ELSE 0 END >= 0.3""")
def _(s, d):
    u, e = F.col("user_id"), F.col("event_id")
    base = u % 3 + F.when((F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")) & (u % 2 == 0), 100).otherwise(0)
    step = F.when((e % 5 == 0) & (u % 4 == 1), 3).otherwise(1)
    count = F.when((u % 6 == 3) & (e % 2 == 0), 12).otherwise(2 + e % 2)
    m = _t(s, d, "events").withColumns({"base": base, "step": step}).withColumn("to", F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.concat(F.lit("r"), (F.col("base") + i * F.col("step")).cast("string"))))
    m = m.withColumn("account", u.cast("string"))
    found = ac.compromised(m, "event_id", "account", "ts", "to", (u % 7 == 2) & (e % 50 == 1)).withColumn("account", F.col("account").cast(m.schema["user_id"].dataType))
    return found.withColumn("indicators", F.array_join("indicators", ","))


@_query("t22_authentication_health", "SELECT source, CAST(sum(CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS checks, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passes, round(sum(CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END), 0), 6) AS health FROM documents GROUP BY 1")
def _(s, d):
    k = F.col("doc_id") % 4
    auth = F.when(k == 0, "SPF=pass dkim=PASS").when(k == 1, "spf=fail dkim=pass").when(k == 2, "dmarc=none")
    return ac.authentication_health(_t(s, d, "documents"), auth, "source")


@_query("t37_thread_outcomes", """WITH m AS (SELECT o_custkey AS thread, o_orderkey AS id, o_orderstatus AS sender, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 2) AS ts, (o_orderkey % 21 - 10) / 10.0 + CASE WHEN o_custkey % 3 = 0 AND o_orderdate >= TIMESTAMP '1999-01-01' THEN 0.6 WHEN o_custkey % 3 = 1 AND o_orderdate >= TIMESTAMP '1999-01-01' THEN -0.6 ELSE 0 END AS tone FROM orders),
k AS (SELECT thread, count(*) AS n, max(ts) AS last FROM m GROUP BY 1 HAVING count(*) >= 3 ORDER BY last DESC, thread LIMIT 20), p AS (SELECT m.*, n, last, row_number() OVER (PARTITION BY thread ORDER BY ts, id) AS rn FROM m JOIN k USING (thread)),
g AS (SELECT thread, any_value(n) AS n, any_value(last) AS last, avg(tone) FILTER (rn <= greatest(1, n // 2)) AS was, avg(tone) FILTER (rn > n - greatest(1, n // 2)) AS cur, count(DISTINCT lower(sender)) AS people, count(DISTINCT lower(sender)) FILTER (rn > n - greatest(1, n // 2)) AS active FROM p GROUP BY 1),
x AS (SELECT *, cur - was AS delta, date_diff('second', last, TIMESTAMP '2001-08-12') // 86400 AS age, active / people AS engaged FROM g)
SELECT thread, n, CASE WHEN age > 14 THEN 'resolved' WHEN age > 7 AND engaged < 0.5 THEN 'stalled' WHEN delta < -0.3 AND cur < -0.2 THEN 'conflict' WHEN delta > 0.2 AND cur > 0.1 THEN 'consensus' ELSE 'active' END AS outcome, round(CASE WHEN age > 14 THEN 0.6 WHEN age > 7 AND engaged < 0.5 THEN 0.7 WHEN (delta < -0.3 AND cur < -0.2) OR (delta > 0.2 AND cur > 0.1) THEN least(0.5 + abs(delta), 0.9) ELSE 0.5 END, 6)::DOUBLE AS confidence, CASE WHEN delta > 0.15 THEN 'improving' WHEN delta < -0.15 THEN 'declining' ELSE 'stable' END AS trajectory FROM x""")
def _(s, d):
    late = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tone = (k % 21 - 10) / 10 + F.when((c % 3 == 0) & late, 0.6).when((c % 3 == 1) & late, -0.6).otherwise(0.0)
    m = _t(s, d, "orders").select(c.alias("thread"), k.alias("id"), F.col("o_orderstatus").alias("sender"), (F.col("o_orderdate") + F.expr("make_dt_interval(cast(o_orderkey % 2 as int))")).alias("ts"), tone.alias("tone"))
    return ac.thread_outcomes(m, "thread", "id", "sender", "ts", "tone", F.lit("2001-08-12").cast("timestamp_ntz"))


@_query("t10_bridges", "WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), w AS (SELECT a, b % 9 AS dom, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a AS node, count(*) AS domains FROM w GROUP BY 1 HAVING count(*) >= 3 ORDER BY domains DESC, node LIMIT 3")
def _(s, d):
    e = _t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"))
    return ac.bridges(e, F.col("b") % 9)


@_query("f31_patterns", r"SELECT doc_id, regexp_matches(f, '(?i)id.*scum') AS glob, regexp_matches(f, '(?i)^src1\d\n') AS whole, false AS invalid FROM (SELECT doc_id, coalesce(source, '') || chr(10) || coalesce(text, '') AS f FROM documents) WHERE regexp_matches(f, '(?i)id.*scum') OR regexp_matches(f, '(?i)^src1\d\n')")
def _(s, d):
    docs, fields = _t(s, d, "documents").select("doc_id", "source", "text"), ["source", "text"]
    found = [ac.regex_search(docs, line, fields).select("doc_id", F.lit(name).alias("how")) for line, name in (("ID*scum", "glob"), (r"/^src1\d\n/", "whole"), ("/(/", "invalid"))]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("doc_id").agg(*[(F.count_if(F.col("how") == n) > 0).alias(n) for n in ("glob", "whole", "invalid")])


@_query("x13_fnv1a", "SELECT c_custkey, CAST(list_reduce([CAST(14695981039346656037 AS HUGEINT)] || [CAST(ord(c_name[i]) AS HUGEINT) FOR i IN range(1, length(c_name) + 1)], lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS hash FROM customer")
def _(s, d):
    return _t(s, d, "customer").select("c_custkey", ac.fnv1a(F.col("c_name")).cast("string").alias("hash"))


@_query("o03_cursor", "SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'click') WHERE rn BETWEEN 21 AND 40")
def _(s, d):
    e = _t(s, d, "events").where("event_type = 'click'").select("event_id", "ts")
    asked = "type:click"
    last = ac.next_page(e, asked, ["ts", "event_id"], 20).orderBy("ts", "event_id").first()  # the first page's last row
    return ac.next_page(e, asked, ["ts", "event_id"], 20, ac.page_cursor(asked, (last["ts"], last["event_id"])))
