"""Queries of security figures, duplicate verification, roles, derived and capture filters, holds and seals, contacts, pages as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivum.operators import analytics as an
from archivum.operators import evidence as ev
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t

#: Orders as messages with fields of a mail: planted so that every rule has rows.
_MAIL_SQL = """m AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Ann <a' || o_custkey || '@mail.example>' WHEN 1 THEN 'b' || o_custkey || '@shop.xyz' WHEN 2 THEN 'nobody' ELSE '<c@host' || o_orderkey % 9 || '.org>' END AS sender,
CASE WHEN o_orderkey % 5 = 0 THEN '<x@mail.example>' END AS return_path, CASE WHEN o_orderkey % 7 = 0 THEN 'y@other.example' END AS reply_to,
CASE o_orderkey % 4 WHEN 0 THEN 'mx; SPF=pass dkim=pass dmarc=pass' WHEN 1 THEN 'mx; spf=softfail dkim=fail dmarc=fail' WHEN 2 THEN 'mx; spf=fail' END AS auth,
CASE WHEN o_orderkey % 3 = 0 THEN ['from a by b', 'by c with ESMTPS'] WHEN o_orderkey % 3 = 1 THEN ['by c'] END AS received, CASE WHEN o_orderkey % 2 = 0 THEN 'client' || o_orderkey % 14 END AS client,
CASE WHEN o_orderkey % 8 = 0 THEN ['f.pdf'] END AS files FROM orders),
d AS (SELECT *, CASE WHEN contains(sender, '@') THEN regexp_extract(replace(replace(sender, '<', ''), '>', ''), '[^@]*$') ELSE '' END AS own, coalesce(regexp_extract(replace(replace(return_path, '<', ''), '>', ''), '[^@]*$'), '') AS back, coalesce(regexp_extract(reply_to, '[^@]*$'), '') AS reply, lower(coalesce(auth, '')) AS a FROM m),
s AS (SELECT *, coalesce(list_contains(received, 'by c with ESMTPS'), false) AS tls, CAST(least(10, CASE WHEN a LIKE '%spf=pass%' THEN 0 WHEN a LIKE '%spf=fail%' OR a LIKE '%spf=softfail%' THEN 3 ELSE 1 END + CASE WHEN a LIKE '%dkim=pass%' THEN 0 WHEN a LIKE '%dkim=fail%' THEN 3 ELSE 1 END + CASE WHEN a NOT LIKE '%dmarc=pass%' AND a LIKE '%dmarc=fail%' THEN 2 ELSE 0 END
+ CASE WHEN back <> '' AND back <> own THEN 2 ELSE 0 END + CASE WHEN reply <> '' AND reply <> own THEN 2 ELSE 0 END + CASE WHEN coalesce(list_contains(received, 'by c with ESMTPS'), false) THEN 0 ELSE 1 END + CASE WHEN own LIKE '%.xyz' THEN 2 ELSE 0 END) AS INTEGER) AS score FROM d)"""


def _mail(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    who = F.when(k % 6 == 0, F.concat(F.lit("Ann <a"), "o_custkey", F.lit("@mail.example>"))).when(k % 6 == 1, F.concat(F.lit("b"), "o_custkey", F.lit("@shop.xyz"))).when(k % 6 == 2, "nobody").otherwise(F.concat(F.lit("<c@host"), (k % 9).cast("string"), F.lit(".org>")))
    auth = F.when(k % 4 == 0, "mx; SPF=pass dkim=pass dmarc=pass").when(k % 4 == 1, "mx; spf=softfail dkim=fail dmarc=fail").when(k % 4 == 2, "mx; spf=fail")
    received = F.when(k % 3 == 0, F.array(F.lit("from a by b"), F.lit("by c with ESMTPS"))).when(k % 3 == 1, F.array(F.lit("by c")))
    return _t(s, d, "orders").select(k.alias("id"), who.alias("sender"), F.when(k % 5 == 0, "<x@mail.example>").alias("return_path"), F.when(k % 7 == 0, "y@other.example").alias("reply_to"), auth.alias("auth"), received.alias("received"), F.when(k % 2 == 0, F.concat(F.lit("client"), (k % 14).cast("string"))).alias("client"), F.when(k % 8 == 0, F.array(F.lit("f.pdf"))).alias("files"))


def _score():
    return ev.threat_score(F.col("sender"), F.col("return_path"), F.col("reply_to"), F.col("auth"), F.col("received"))


@_query("x17_threat_score", f"WITH {_MAIL_SQL} SELECT id, score FROM s")
def _(s, d):
    return _mail(s, d).select("id", _score().alias("score"))


@_query("a21_security_statistics", f"""WITH {_MAIL_SQL}, f AS (SELECT unnest([{{'kind': 'messages', 'key': 'all'}}, {{'kind': 'threat', 'key': CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'clean' END}}, CASE WHEN tls THEN {{'kind': 'tls', 'key': 'yes'}} END, CASE WHEN len(files) > 0 THEN {{'kind': 'attachments', 'key': 'yes'}} END,
CASE WHEN a LIKE '%spf=pass%' THEN {{'kind': 'passed', 'key': 'spf'}} END, CASE WHEN a LIKE '%dkim=pass%' THEN {{'kind': 'passed', 'key': 'dkim'}} END, CASE WHEN a LIKE '%dmarc=pass%' THEN {{'kind': 'passed', 'key': 'dmarc'}} END, CASE WHEN own <> '' THEN {{'kind': 'domain', 'key': own}} END, CASE WHEN client IS NOT NULL THEN {{'kind': 'client', 'key': client}} END]) AS x FROM s)
SELECT x.kind AS kind, x.key AS key, count(*) AS n FROM f WHERE x IS NOT NULL GROUP BY 1, 2 QUALIFY x.kind NOT IN ('domain', 'client') OR row_number() OVER (PARTITION BY x.kind ORDER BY count(*) DESC, x.key) <= 10""")
def _(s, d):
    return ev.security_statistics(_mail(s, d), _score(), F.col("sender"), F.col("auth"), F.col("received"), F.col("client"), F.col("files"))


_PARTS_SQL = "p AS (SELECT lang || '-' || n_chars // 30 AS g, doc_id, doc_id % 10 <> 3 AS parsed, lang, source, CASE WHEN doc_id % 4 = 0 THEN upper(source) ELSE source END || '@x.org' AS addr, regexp_replace(left(text, 5), '\\s+', ' ', 'g') AS subject, doc_id % 3 AS shape, CASE WHEN doc_id % 5 <> 0 THEN md5(source) END AS digest, CASE WHEN doc_id % 6 <> 1 THEN CASE doc_id % 2 WHEN 0 THEN lang || chr(13) || chr(10) ELSE lang || chr(10) END END AS raw FROM documents)"


@_query("t02_fields", f"""WITH {_PARTS_SQL}, g AS (SELECT g, count(*) AS n, count(raw) AS known, bool_and(parsed) AS parsed, bool_or(digest IS NULL) AS missing, count(DISTINCT raw) AS w, count(DISTINCT replace(raw, chr(13) || chr(10), chr(10))) AS l, count(DISTINCT lower(addr)) AS a, count(DISTINCT trim(coalesce(subject, ''))) AS s, count(DISTINCT coalesce(digest, '') || shape) AS att, count(DISTINCT shape) AS bare FROM p WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1)
SELECT g AS "group", n, CASE WHEN known = n AND w = 1 THEN 'byteIdentical' WHEN known = n AND l = 1 THEN 'contentEquivalent' WHEN NOT parsed THEN 'candidate' WHEN a = 1 AND s = 1 AND NOT missing AND att = 1 THEN 'contentEquivalent' ELSE 'candidate' END AS verdict,
CASE WHEN known = n AND (w = 1 OR l = 1) THEN '' WHEN NOT parsed THEN 'body,structure' ELSE concat_ws(',', CASE WHEN a > 1 THEN 'from' END, CASE WHEN s > 1 THEN 'subject' END, CASE WHEN CASE WHEN missing THEN bare > 1 ELSE att > 1 END THEN 'attachments' WHEN missing THEN 'attachmentBytes' END) END AS differences FROM g""")
def _(s, d):
    k = F.col("doc_id")
    p = _t(s, d, "documents").select(F.concat("lang", F.lit("-"), F.expr("n_chars div 30").cast("string")).alias("g"), "doc_id", (k % 10 != 3).alias("parsed"), "lang", "source", "text")
    files = F.array(F.struct(F.when(k % 5 != 0, F.md5(F.col("source").cast("binary"))).alias("digest"), (k % 3).alias("shape")))
    raw = F.when(k % 6 != 1, F.concat("lang", F.when(k % 2 == 0, "\r\n").otherwise("\n")))
    fields = {"from": ev.addresses(F.concat(F.when(k % 4 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("@x.org"))), "subject": ev.collapsed(F.left("text", F.lit(5)))}
    return ev.verify_fields(p, "g", raw, F.col("parsed"), fields, files).withColumn("differences", F.array_join("differences", ","))


_PEOPLE_SQL = "p AS (SELECT o_orderkey AS id, ['TO', 'CC', 'BCC'][1 + o_orderkey % 3] AS role, lower(c_name) || '@x.org' AS address, c_mktsegment AS name FROM orders JOIN customer ON o_custkey = c_custkey)"


def _people(s: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(F.lit("TO"), F.lit("CC"), F.lit("BCC")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.array(F.struct(role.alias("role"), F.concat(F.lower("c_name"), F.lit("@x.org")).alias("address"), F.col("c_mktsegment").alias("name"))).alias("people"))


@_query("f02_roles", f"WITH {_PEOPLE_SQL} SELECT id, coalesce(contains(address, '00001') OR contains(lower(name), '00001'), false) AS anyone, role = 'CC' AND contains(lower(name), 'build') AS cc, role = 'BCC' AND address = 'customer#000000007@x.org' AS bcc FROM p WHERE anyone OR cc OR bcc")
def _(s, d):
    p = F.col("people")
    found = _people(s, d).select("id", ev.participant(p, "00001").alias("anyone"), ev.participant(p, "BUILD", ("CC",)).alias("cc"), ev.participant(p, "Customer#000000007@x.org", ("BCC",), True).alias("bcc"))
    return found.where("anyone or cc or bcc")


@_query("f15_derived", "SELECT doc_id FROM documents JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND l.toxic = 1 AND doc_id % 10 < 7 AND lang IN ('en', 'de')")
def _(s, d):
    docs = _t(s, d, "documents")
    derived = docs.join(_t(s, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("priority"), (F.col("toxic") == 1).alias("phishing"), (F.col("doc_id") % 10 / 10).alias("tone"), F.col("lang").alias("class"))
    return ev.derived_filter(docs.select("doc_id"), derived, "doc_id", 1, True, 0.7, ("en", "de"))


@_query("f12_capture_state", "SELECT 'connected' AS asked, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'file', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'removed', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'account', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1) UNION ALL SELECT 'unknown', 0")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id")
    remote = _t(s, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("account"), (F.col("quality") == 1).alias("present"))
    asked = {"connected": {"kind": "connected"}, "file": {"kind": "file"}, "removed": {"state": "removedOnServer"}, "account": {"state": "onServer", "account": "1"}, "unknown": {"kind": "odd"}}
    out = None
    for name, how in asked.items():
        one = ev.capture_filter(docs, remote, "doc_id", **how).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query("t18_verify_seals", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'changed' ELSE 'intact' END AS status FROM documents WHERE lang = 'en'")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text", "lang")
    none = s.createDataFrame([], "doc_id long")
    held, sealed = ev.seals(docs.where("lang = 'en'"), none, s.createDataFrame([], "doc_id long, seal string"), "doc_id", F.col("text"))
    later = docs.where("doc_id % 10 != 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    _, sealed = ev.seals(later.where("lang = 'en'"), held, sealed, "doc_id", F.col("text"))  # a seal is set once
    return ev.verify_seals(later, sealed, "doc_id", F.col("text"))


@_query("t18_custodians", "SELECT CASE WHEN o_custkey % 4 <> 0 THEN 'k' || o_custkey % 4 END AS custodian, count(*) AS messages, count(*) FILTER (o_orderstatus = 'F') AS held, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def _(s, d):
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderdate")
    assigned = o.where("o_custkey % 4 != 0").select("id", F.concat(F.lit("k"), (F.col("o_custkey") % 4).cast("string")).alias("custodian"))
    return ev.custodian_totals(o.select("id", "o_orderdate"), assigned, o.where("o_orderstatus = 'F'"), "id", "o_orderdate")


@_query("t28_relationships", """WITH c AS (SELECT o_custkey % 300 AS contact, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0 AND o_custkey % 2 = 0) AS s, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT contact, n, CASE WHEN s = 0 OR s = n THEN 0.1 ELSE least(s, n - s) / greatest(s, n - s) END AS reciprocity, greatest(0.0, 1 - date_diff('second', last, TIMESTAMP '2001-09-01') / 86400 / 365) AS recency, least(1.0, n / 50) AS frequency FROM c)
SELECT contact, n, round(reciprocity, 6) AS reciprocity, round(recency, 6) AS recency, round(frequency, 6) AS frequency, CASE WHEN reciprocity > 0.4 AND frequency > 0.3 AND recency > 0.3 THEN 'Close' WHEN reciprocity > 0.2 AND frequency > 0.15 THEN 'Regular' WHEN reciprocity < 0.15 AND n >= 3 THEN 'One-Way' WHEN recency < 0.2 AND n >= 5 THEN 'Dormant' ELSE 'Acquaintance' END AS kind FROM r""")
def _(s, d):
    o = _t(s, d, "orders").withColumn("contact", F.col("o_custkey") % 300)
    sent = (F.col("o_orderkey") % 3 == 0) & (F.col("o_custkey") % 2 == 0)
    found = ev.relationships(o, "contact", sent, "o_orderdate", F.lit("2001-09-01").cast("timestamp_ntz"))
    return found.withColumns({c: F.round(c, 6) for c in ("reciprocity", "recency", "frequency")})


_NAMED_SQL = "{0}"
for _name, _sign in ev.NAMED.items():
    _NAMED_SQL = f"regexp_replace({_NAMED_SQL}, '(?i)&{_name};', '{_sign.replace(chr(39), chr(39) * 2)}', 'g')"
_READ_SQL = "coalesce(html, '')"
for _element in ("<!--.*?-->", *[rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ("head", "style", "script", "noscript", "template")]):
    _READ_SQL = f"regexp_replace({_READ_SQL}, '(?is){_element}', '', 'g')"
_READ_SQL = rf"regexp_replace(regexp_replace(regexp_replace({_READ_SQL}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|li|h[1-6]|blockquote|table|section|article)\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_READ_SQL = _NAMED_SQL.format(_READ_SQL)
_READ_SQL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_READ_SQL}, '[ \t\x{{00A0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@_query("x08_readable_html", f"SELECT page_id, md5({_READ_SQL}) AS text_md5 FROM pages")
def _(s, d):
    return _t(s, d, "pages").select("page_id", F.md5(ev.readable_html(F.col("html")).cast("binary")).alias("text_md5"))


@_query("t33_hybrid", "WITH a AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS INTEGER) AS rank FROM orders GROUP BY 1), b AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS INTEGER) AS rank FROM orders GROUP BY 1) SELECT o_custkey, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY 1")
def _(s, d):
    per = _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    ranked = [per.orderBy(F.desc(c), "o_custkey").limit(50).select("o_custkey", F.row_number().over(Window.orderBy(F.desc(c), "o_custkey")).alias("rank")) for c in ("n", "top")]
    return ev.hybrid(*ranked, "o_custkey").select("o_custkey", F.round("score", 8).alias("score"))


@_query("t38_alerts", f"WITH {_MAIL_SQL}, v AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), mv AS (SELECT avg(n) AS mean, count(*) AS days FROM v) SELECT 'threat' AS kind, CAST(id AS VARCHAR) AS what, CAST(score AS BIGINT) AS n FROM s WHERE score >= 7 UNION ALL SELECT 'volume', strftime(day, '%Y-%m-%d'), n FROM v, mv WHERE days >= 7 AND n > 1.05 * mean")
def _(s, d):
    threats = _mail(s, d).withColumn("score", _score()).where("score >= 7").select(F.lit("threat").alias("kind"), F.col("id").cast("string").alias("what"), F.col("score").cast("long").alias("n"))
    busy = an.bursts(an.daily(_t(s, d, "events"), "ts"), 1.05).select(F.lit("volume").alias("kind"), F.date_format("day", "yyyy-MM-dd").alias("what"), "n")
    return threats.unionByName(busy)
