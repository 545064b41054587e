"""Queries of attachment families, threats, urgency, domains, predictive coding, people and near duplicates.

Each has its SQL but the near duplicates, which a test compares with brute force.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.operators import casework as cw
from archivum.operators import resolve as rs
from archivum.operators import review as rv
from archivum.operators import signals as sg
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t
from archivum.plans.inquiry import _BODIES_SQL, _PHISHING, _PHISHING_SIGNALS, _any, _bodies, _sum

_ENDINGS = ["pdf", "PNG", "docx", "tar", "csv", "zip", "pdf.exe"]
_MEDIA = ["application/pdf", "image/png", "", "application/zip", "text/plain"]
_FILES_SQL = f"f AS (SELECT l_orderkey, l_linenumber, 'File.' || {_ENDINGS}[l_partkey % 7 + 1] AS file, {_MEDIA}[l_suppkey % 5 + 1] AS media FROM lineitem)"


def _family(kind: str, rule: str) -> None:
    @_query(f"f11_family_{kind}", f"WITH {_FILES_SQL} SELECT l_orderkey, l_linenumber FROM f WHERE {rule}")
    def _(s, d):
        pick = lambda values, c: F.get(F.lit(values), (F.col(c) % len(values)).cast("int"))
        files = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("File."), pick(_ENDINGS, "l_partkey")).alias("file"), pick(_MEDIA, "l_suppkey").alias("media"))
        return files.where(cw.attachment_family(F.col("file"), F.col("media"), kind)).select("l_orderkey", "l_linenumber")


_family("pdf", "media ILIKE '%pdf%' OR file ILIKE '%.pdf'")
_family("images", "media LIKE 'image/%' OR regexp_matches(file, '(?i)[.](png|jpg|jpeg|gif|heic|tiff|tif|bmp|webp)$')")
_family("office", "regexp_matches(file, '(?i)[.](doc|docx|xls|xlsx|ppt|pptx|odt|ods|odp|rtf)$')")
_family("archives", "media LIKE '%zip%' OR regexp_matches(file, '(?i)[.](zip|gz|tgz|7z|rar|tar)$')")
_family("text", "media LIKE 'text/%' OR regexp_matches(file, '(?i)[.](txt|csv|md|log|json|xml|html|htm)$')")
_family("exe", "file LIKE '%.exe'")


_THREATS_SQL = f"""p AS (SELECT *, {_PHISHING} AS points, {_sum(*((1, c) for _, c in _PHISHING_SIGNALS))} AS reasons FROM b), o AS (SELECT user_id AS doc_id, sum(value) / 1000 AS odd FROM events WHERE event_type = 'error' GROUP BY 1),
 x AS (SELECT doc_id, lower(body) AS t, points >= 4 AS flagged, CASE WHEN points >= 8 THEN 0.9 ELSE 0.6 END * reasons AS content, odd, CASE doc_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS files, auth ILIKE '%spf=fail%' AS s, auth ILIKE '%spf=softfail%' AS w, auth ILIKE '%dkim=fail%' AS k, auth ILIKE '%dmarc=fail%' AS m FROM p LEFT JOIN o USING (doc_id)),
 y AS (SELECT *, contains(t, 'password') AND {_any('t', ['attached', 'enclosed', 'zip'])} AS locked, s OR w OR k OR m AS sender FROM x),
 z AS (SELECT *, flagged OR locked AS said, least(1.0, (CASE WHEN s THEN 1.6 WHEN w THEN 1.0 ELSE 0 END + CASE WHEN k THEN 1.4 ELSE 0 END + CASE WHEN m THEN 1.8 ELSE 0 END + CASE WHEN flagged THEN content ELSE 0 END + coalesce(odd, 0) + 2 * files + CASE WHEN locked THEN 1 ELSE 0 END) / 10) AS score FROM y WHERE sender OR flagged OR locked OR files > 0 OR odd IS NOT NULL)
 SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN round(CAST(score AS DOUBLE), 9) >= 0.8 THEN 'critical' WHEN round(CAST(score AS DOUBLE), 9) >= 0.6 THEN 'high' WHEN round(CAST(score AS DOUBLE), 9) >= 0.35 THEN 'medium' WHEN round(CAST(score AS DOUBLE), 9) >= 0.1 THEN 'low' ELSE 'clean' END AS level,
 CASE WHEN {_any('t', ['wire transfer', 'bank account', 'routing number'])} THEN 'business email compromise' WHEN files > 0 THEN 'malware delivery' WHEN {_any('t', ['password', 'credential', 'sign in', 'verify your account'])} THEN 'credential harvesting' WHEN sender AND said THEN 'spear phishing' WHEN sender THEN 'spoofing' WHEN said THEN 'phishing' END AS vector FROM z"""


@_query("t21_threats", f"WITH {_BODIES_SQL}, {_THREATS_SQL}")
def _(s, d):
    b = sg.phishing(_bodies(s, d), *(F.col(c) for c in ("subject", "sender", "body", "auth", "reply_to"))).select("*", sg.authentication(F.col("auth")).alias("a"))
    k = F.col("doc_id") % 10
    files = F.when(k == 0, F.array(F.lit("run.EXE"), F.lit("a.txt"))).when(k == 1, F.array(F.lit("x.js"), F.lit("y.ps1"))).otherwise(F.array().cast("array<string>"))
    odd = _t(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), (F.col("value") / 1000).alias("severity"))
    found = sg.correlate_threats(b.select("*", "a.spf", "a.dkim", "a.dmarc", files.alias("files")), odd, "doc_id", F.col("body"), F.col("files"))
    return found.select("doc_id", F.round("score", 6).alias("score"), "level", "vector")


_NOW = datetime.datetime(1998, 8, 2)
_URGENCY_SQL = _sum(
    *((0.3, f"contains(t, '{w}')") for w in sg.NOW_WORDS), *((0.2, f"contains(t, '{w}')") for w in sg.SOON_WORDS), *((0.1, f"contains(t, '{w}')") for w in sg.SOME_TIME_WORDS),
    (0.15, "len(regexp_extract_all(t, '[?]')) >= 2"), (0.1, "len(regexp_extract_all(subject, '!')) >= 2"), (0.1, "age <= 1"), (0.05, "age > 1 AND age <= 3"), (0.1, "tone < -0.3"),
)


@_query("t37_urgency", f"WITH {_BODIES_SQL}, u AS (SELECT doc_id, subject, lower(subject || ' ' || body) AS t, doc_id % 6 AS age, doc_id % 7 / -10.0 AS tone FROM b), v AS (SELECT doc_id, CAST({_URGENCY_SQL} AS DOUBLE) AS x FROM u) SELECT doc_id, round(least(x, 1.0), 6) AS score, CASE WHEN round(x, 6) >= 0.5 THEN 'critical' WHEN round(x, 6) >= 0.35 THEN 'high' WHEN round(x, 6) >= 0.2 THEN 'medium' ELSE 'low' END AS urgency FROM v WHERE round(x, 6) > 0.05")
def _(s, d):
    ts = F.lit(_NOW) - F.make_dt_interval((F.col("doc_id") % 6).cast("int"))
    return sg.urgency(_bodies(s, d), F.col("subject"), F.col("body"), ts, F.col("doc_id") % 7 / -10.0, F.lit(_NOW)).select("doc_id", F.round("score", 6).alias("score"), "urgency")


_DOMAINS_SQL = """m AS (SELECT 'd' || o_custkey % 60 || '.' || ['com', 'xyz', 'org'][o_custkey % 3 + 1] AS domain, o_orderdate AS ts, o_orderkey % 4 > 0 AS checked, o_orderkey % 4 = 1 OR o_custkey % 60 < 9 AS passed, o_orderkey % 7 < o_custkey % 5 AS flagged FROM orders),
 g AS (SELECT domain, count(*) AS messages, count(*) FILTER (checked) AS c, count(*) FILTER (checked AND passed) AS p, count(*) FILTER (flagged) AS f, min(ts) AS first_seen, max(ts) AS last_seen FROM m GROUP BY 1),
 r AS (SELECT *, CASE WHEN c > 0 THEN p / c ELSE 0.5 END AS authentication_rate, f / messages AS phishing_rate, date_diff('second', first_seen, TIMESTAMP '1998-08-02') AS age FROM g),
 q AS (SELECT *, round(greatest(0.0, least(1.0, 0.5 + (authentication_rate - 0.5) * 0.3 - CASE WHEN authentication_rate < 0.3 AND c > 2 THEN 0.15 ELSE 0.0 END - CASE WHEN phishing_rate > 0.3 THEN 0.25 WHEN phishing_rate > 0.1 THEN 0.1 ELSE 0.0 END + CASE WHEN messages >= 20 THEN 0.1 ELSE 0.0 END - CASE WHEN messages < 3 THEN 0.05 ELSE 0.0 END + CASE WHEN age < 604800 THEN -0.15 WHEN age > 15552000 THEN 0.1 ELSE 0.0 END - CASE WHEN domain LIKE '%.xyz' THEN 0.2 ELSE 0.0 END)), 9) AS s FROM r)
 SELECT domain, messages, round(authentication_rate, 6) AS authentication_rate, round(phishing_rate, 6) AS phishing_rate, first_seen, last_seen, round(s, 6) AS score, CASE WHEN messages < 3 THEN 'new, unverified' WHEN s >= 0.75 THEN 'trusted' WHEN s >= 0.5 THEN 'known' WHEN s >= 0.3 THEN 'suspicious' ELSE 'malicious' END AS class FROM q"""


@_query("t22_domain_reputation", f"WITH {_DOMAINS_SQL}")
def _(s, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    mails = _t(s, d, "orders").select(F.concat(F.lit("d"), c % 60, F.lit("."), F.get(F.lit(["com", "xyz", "org"]), (c % 3).cast("int"))).alias("domain"), F.col("o_orderdate").alias("ts"), k, c)
    out = sg.domain_reputation(mails, "domain", "ts", k % 4 > 0, (k % 4 == 1) | (c % 60 < 9), k % 7 < c % 5, F.lit(_NOW))
    return out.withColumns({c: F.round(c, 6) for c in ("authentication_rate", "phishing_rate", "score")})


# Codes are those of two documents in three, so that rows without a code remain.
_CODING_SQL = r"""c AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 3 > 0), n AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE length(w) >= 2 GROUP BY 1, 2),
 f AS (SELECT doc_id, w, n / max(n) OVER (PARTITION BY doc_id) AS tf FROM n), i AS (SELECT w, ln((SELECT count(*) FROM documents) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY 1), x AS (SELECT doc_id, w, tf * idf AS weight FROM f JOIN i USING (w)),
 m AS (SELECT w, coalesce(sum(weight) FILTER (toxic = 1), 0) AS yes, coalesce(sum(weight) FILTER (toxic = 0), 0) AS no FROM x JOIN c USING (doc_id) GROUP BY 1), t AS (SELECT sum(yes) + count(*) AS all_yes, sum(no) + count(*) AS all_no FROM m),
 s AS (SELECT doc_id, sum(weight * (ln((coalesce(yes, 0) + 1) / all_yes) - ln((coalesce(no, 0) + 1) / all_no))) AS s FROM t, x LEFT JOIN m USING (w) GROUP BY 1), r AS (SELECT ln(count(*) FILTER (toxic = 1)) - ln(count(*) FILTER (toxic = 0)) AS r FROM c),
 e AS (SELECT toxic, i, avg(x) AS x FROM (SELECT toxic, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN c ON vec_id = doc_id) GROUP BY 1, 2), k AS (SELECT list(x ORDER BY i) FILTER (toxic = 1) AS yes, list(x ORDER BY i) FILTER (toxic = 0) AS no FROM e),
 v AS (SELECT vec_id AS doc_id, greatest(0, least(1, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), yes) - list_cosine_similarity(CAST(embedding AS DOUBLE[]), no) + 1) / 2)) AS cosine FROM embeddings, k),
 p AS (SELECT doc_id, 1 / (1 + exp(-(coalesce(s, 0) + r))) AS bayes, coalesce(cosine, 0.5) AS cosine, 0.6 * (1 / (1 + exp(-(coalesce(s, 0) + r)))) + 0.4 * coalesce(cosine, 0.5) AS score FROM r, documents LEFT JOIN s USING (doc_id) LEFT JOIN v USING (doc_id))"""


def _coding(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    codes = _t(s, d, "labels").where("doc_id % 3 > 0").select("doc_id", "toxic")
    vectors = _t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rv.predictive_coding(_t(s, d, "documents").select("doc_id", "text"), codes, "doc_id", "text", "toxic", vectors, "embedding"), codes


@_query("t23_blend", f"WITH {_CODING_SQL} SELECT doc_id, round(bayes, 5) AS bayes, round(cosine, 5) AS cosine, round(score, 5) AS score FROM p")
def _(s, d):
    return _coding(s, d)[0].select("doc_id", *(F.round(c, 5).alias(c) for c in ("bayes", "cosine", "score")))


@_query("t23_uncertain", f"WITH {_CODING_SQL} SELECT doc_id, round(score, 5) AS score FROM p WHERE score > 0.25 AND score < 0.75 AND doc_id NOT IN (SELECT doc_id FROM c) ORDER BY round(abs(score - 0.5), 6), doc_id LIMIT 20")
def _(s, d):
    return rv.uncertain(*_coding(s, d), "doc_id").select("doc_id", F.round("score", 5).alias("score"))


@_query("t23_quality", f"WITH {_CODING_SQL} SELECT round(2 * count(*) FILTER (toxic = 1 AND score > 0.5) / (count(*) FILTER (toxic = 1 AND score > 0.5) + count(*) FILTER (toxic = 0 AND score > 0.5) + count(*) FILTER (toxic = 1)), 6) AS f1, round(avg(CASE WHEN score > 0.5 THEN 1 ELSE 0 END), 6) AS richness FROM p LEFT JOIN c USING (doc_id)")
def _(s, d):
    return rv.coding_quality(*_coding(s, d), "doc_id", "toxic").select(F.round("f1", 6).alias("f1"), F.round("richness", 6).alias("richness"))


_PEOPLE_SQL = """WITH RECURSIVE p AS (SELECT c_custkey AS node, 'u' || c_custkey // 4 || CASE WHEN c_custkey % 4 = 1 THEN '+x' WHEN c_custkey % 4 > 1 THEN '.' || c_custkey ELSE '' END || '@d' || c_custkey // 4 % 9 || '.example' AS address, 'Name ' || c_custkey % 97 || CASE WHEN c_custkey % 2 = 0 THEN ', Inc.' ELSE '' END AS name, c_nationkey AS weight FROM customer),
 q AS (SELECT *, regexp_replace(address, '[+][^@]*@', '@') AS base, regexp_replace(lower(name), ', inc[.]$', '') AS plain, split_part(address, '@', 2) AS domain FROM p),
 a AS (SELECT *, first_value(node) OVER (PARTITION BY base ORDER BY weight DESC, length(name) DESC, node) AS first FROM q), l AS (SELECT * FROM a WHERE node = first),
 t AS (SELECT node, plain, '@' || domain AS tie FROM l UNION SELECT node, plain, '#' || o_orderkey % 40 FROM l JOIN orders ON o_custkey = node), h AS (SELECT node, min(node) OVER (PARTITION BY plain, tie) AS hub FROM t),
 e AS (SELECT node AS x, hub AS y FROM h UNION SELECT hub, node FROM h), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), g AS (SELECT x AS node, min(y) AS label FROM r GROUP BY 1),
 k AS (SELECT l.node, first_value(l.node) OVER (PARTITION BY label ORDER BY weight DESC, length(name) DESC, l.node) AS canonical FROM l JOIN g USING (node))
 SELECT a.node, k.canonical FROM a JOIN k ON a.first = k.node"""


@_query("t27_same_people", _PEOPLE_SQL)
def _(s, d):
    k = F.col("c_custkey")
    quarter = F.floor(k / 4)
    address = F.concat(F.lit("u"), quarter, F.when(k % 4 == 1, "+x").when(k % 4 > 1, F.concat(F.lit("."), k)).otherwise(""), F.lit("@d"), quarter % 9, F.lit(".example"))
    people = _t(s, d, "customer").select(k.cast("long").alias("node"), address.alias("address"), F.concat(F.lit("Name "), k % 97, F.when(k % 2 == 0, ", Inc.").otherwise("")).alias("name"), F.col("c_nationkey").alias("weight"))
    near = _t(s, d, "orders").select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 40).alias("neighbour")).distinct()
    return rs.same_people(people, near)


@_query("t05_near_duplicates")
def _(s, d):
    return rs.near_duplicates(_t(s, d, "documents").select("doc_id", "text"), "doc_id", "text")
