"""Queries of the search grammar, scored signals, duplicate tiers and nearest vectors, each with its SQL.

The SQL states the rule itself; word lists and their points are fixed values that both sides read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators import analytics as an
from archivum.operators import archive as ar
from archivum.operators import duplicates as du
from archivum.operators import search as se
from archivum.operators import signals as sg
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t

_LETTERS_SQL = """l AS (SELECT o_orderkey AS id, c_name || ' <C' || o_custkey || '@' || lower(c_mktsegment) || '.example>' AS sender, o_orderpriority AS subject, o_orderstatus AS message_type,
 'box' || o_orderkey % 3 AS source, [lower(c_mktsegment) || '.example'] AS domains, CASE WHEN o_orderkey % 5 = 0 THEN ['red', 'hot'] ELSE ['blue'] END AS tags, CASE WHEN o_orderkey % 7 = 0 THEN ['privileged'] END AS evidence,
 CASE o_orderkey % 4 WHEN 0 THEN ['Plan-' || o_custkey || '.PDF', 'x.txt'] WHEN 1 THEN [] ELSE ['note.docx'] END AS attachments, o_orderkey % 11 = 0 AS pinned, o_orderkey % 13 = 0 AS trashed,
 CASE o_orderkey % 17 WHEN 0 THEN 'orphan' WHEN 1 THEN 'carved' END AS recovery, o_totalprice AS size, o_orderkey % 6 AS priority, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _letters(s: SparkSession, d: str) -> DataFrame:
    """Orders as messages with every column that the grammar asks for."""
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, domain = F.col("o_orderkey"), F.concat(F.lower("c_mktsegment"), F.lit(".example"))
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    return o.select(
        k.alias("id"), F.concat("c_name", F.lit(" <C"), "o_custkey", F.lit("@"), domain, F.lit(">")).alias("sender"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("message_type"),
        F.concat(F.lit("box"), k % 3).alias("source"), F.array(domain).alias("domains"), F.when(k % 5 == 0, words("red", "hot")).otherwise(words("blue")).alias("tags"), F.when(k % 7 == 0, words("privileged")).alias("evidence"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("Plan-"), "o_custkey", F.lit(".PDF")), F.lit("x.txt"))).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(words("note.docx")).alias("attachments"),
        (k % 11 == 0).alias("pinned"), (k % 13 == 0).alias("trashed"), F.when(k % 17 == 0, "orphan").when(k % 17 == 1, "carved").alias("recovery"), F.col("o_totalprice").alias("size"), (k % 6).alias("priority"), F.col("o_orderdate").alias("ts"),
    )


def _found(name: str, line: str, rule: str, trash: bool = False) -> None:
    """A query that searches the letters by a line; ``rule`` is what the line means, as SQL."""
    bin_ = "" if trash else " AND NOT trashed"

    @_query(name, f"WITH {_LETTERS_SQL} SELECT id FROM l WHERE ({rule}){bin_}")
    def _(s, d):
        return se.search(_letters(s, d), line, "subject").select("id")


_found("f01_from_last_wins", "from:nobody from:CUSTOMER#000000001", "sender ILIKE '%customer#000000001%'")
_found("f03_subject_field", "subject:urg", "subject ILIKE '%urg%'")
_found("f04_domain", "domain:Building.example", "list_contains(domains, 'building.example')")
_found("f05_label", "label:red", "list_contains(tags, 'red')")
_found("f08_no_attachment", "no:attachments type:f", "len(attachments) = 0 AND lower(message_type) = 'f'")
_found("f09_attachment_name", 'filename:".pdf"', "len([x FOR x IN attachments IF x ILIKE '%.pdf%']) > 0 AND len(attachments) > 0")
_found("f12_source", "source:box2", "source = 'box2'")
_found("f13_type", "type:P", "lower(message_type) = 'p'")
_found("f14_review_state", "is:starred evidence:privileged in:trash", "pinned AND list_contains(evidence, 'privileged')", trash=True)
_found("f14_recovered", "recovery:orphans", "recovery = 'orphan'")
_found("f19_every_exclusion", "-from:#00000001 NOT subject:low -domain:machinery.example -tag:hot -source:box1 -evidence:privileged -type:O -filename:note -before:1993-01-01 -after:1998-01-01 -is:pinned -recovery:any -has:attachment",
       "NOT sender ILIKE '%#00000001%' AND NOT subject ILIKE '%low%' AND NOT list_contains(domains, 'machinery.example') AND NOT list_contains(tags, 'hot') AND source <> 'box1' AND NOT coalesce(list_contains(evidence, 'privileged'), false) AND message_type <> 'O'"
       " AND len([x FOR x IN attachments IF x ILIKE '%note%']) = 0 AND ts >= TIMESTAMP '1993-01-01' AND ts < TIMESTAMP '1998-01-01' AND NOT pinned AND recovery IS NULL AND len(attachments) = 0")  # fmt: skip
_found("f25_values_that_are_text", "has:foo OR before:soon OR 4:not OR medium", "subject ILIKE '%medium%' OR subject ILIKE '4-not%'")


@_query("o01_sorted_by_size", f"WITH {_LETTERS_SQL} SELECT id, size FROM l WHERE pinned AND NOT trashed ORDER BY size DESC, id LIMIT 50")
def _(s, d):
    return se.search(_letters(s, d), "is:pinned sort:largest", "subject").select("id", "size").limit(50)


@_query("f07_days_in_a_zone", "SELECT count(*) FILTER (o_orderdate - INTERVAL 5 HOUR >= TIMESTAMP '1995-03-05') AS since, count(*) FILTER (o_orderdate - INTERVAL 5 HOUR < TIMESTAMP '1995-03-06') AS until FROM orders")
def _(s, d):
    day, ts = datetime.date(1995, 3, 5), F.col("o_orderdate")
    return _t(s, d, "orders").agg(F.count_if(se.on_or_after(ts, day, "GMT-05:00")).alias("since"), F.count_if(se.on_or_before(ts, day, "GMT-05:00")).alias("until"))


def _word(w: str, prefix: bool = False) -> str:
    return rf"regexp_matches(coalesce(text, ''), '(?i)(^|[^\p{{L}}\p{{N}}]){w}" + ("')" if prefix else r"($|[^\p{L}\p{N}])')")


def _texts(name: str, line: str, rule: str) -> None:
    @_query(name, f"SELECT doc_id FROM documents WHERE {rule}")
    def _(s, d):
        return _t(s, d, "documents").where(se.text_condition(F.coalesce("text", F.lit("")), line)).select("doc_id")


_texts("f28_precedence", "erin AND idiot OR trash NOT are thes", f"({_word('erin')} AND {_word('idiot')}) OR ({_word('trash')} AND NOT ({_word('are')} AND {_word('thes', True)}))")
_texts("f28_last_word_is_a_beginning", "the idio", f"{_word('the')} AND {_word('idio', True)}")
_texts("f28_word_excluded_from_all", "-you scum OR idiot", f"({_word('scum')} OR {_word('idiot', True)}) AND NOT {_word('you')}")
_texts("f28_lone_exclusion_is_a_word", "-scum", _word("scum", True))
_texts("f28_operators_at_the_ends_are_words", "AND trash AND", f"{_word('AND')} AND {_word('trash')} AND {_word('AND', True)}")

# Bodies: the documents' texts with a few of the phrases that the reports look for, so that every report has hits.
_PHRASES = ["please follow up asap?", "Work product: prepared in anticipation of litigation.", "Your account will be suspended, verify your account within 24 hours http://10.1.2.3/x", "legal advice from outside counsel, privileged and confidential", "won a prize, see bit.ly/x and send money", "nothing"]
_HEADERS = ["spf=fail smtp.mailfrom=a.example; dkim=pass header.d=b.example header.s=k1; dmarc=fail header.from=c.example", "SPF=softfail; dkim=fail", ""]
_BODIES_SQL = "b AS (SELECT doc_id, " + "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "][doc_id % 6 + 1] || ' ' || coalesce(text, '') AS body, CASE doc_id % 4 WHEN 0 THEN 'URGENT: what? now?' WHEN 1 THEN 'Subpoena' ELSE 'Hello' END AS subject, CASE doc_id % 3 WHEN 0 THEN 'PayPal Service <x@evil.example>' WHEN 1 THEN 'bank.example <y@other.example>' ELSE 'Jo, Esq <jo@law.example>' END AS sender, [" + ", ".join(f"'{h}'" for h in _HEADERS) + "][doc_id % 3 + 1] AS auth, CASE WHEN doc_id % 5 = 0 THEN 'z@elsewhere.example' END AS reply_to, doc_id % 9 AS n FROM documents)"


def _bodies(s: SparkSession, d: str) -> DataFrame:
    k, some = F.col("doc_id"), lambda values, i: F.get(F.lit(values), (F.col("doc_id") % i).cast("int"))
    subject = F.when(k % 4 == 0, "URGENT: what? now?").when(k % 4 == 1, "Subpoena").otherwise("Hello")
    sender = F.when(k % 3 == 0, "PayPal Service <x@evil.example>").when(k % 3 == 1, "bank.example <y@other.example>").otherwise("Jo, Esq <jo@law.example>")
    return _t(s, d, "documents").select(k, F.concat(some(_PHRASES, 6), F.lit(" "), F.coalesce("text", F.lit(""))).alias("body"), subject.alias("subject"), sender.alias("sender"), some(_HEADERS, 3).alias("auth"), F.when(k % 5 == 0, "z@elsewhere.example").alias("reply_to"), (k % 9).alias("n"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _sum(*signals: tuple[float, str]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {float(p)} ELSE 0.0 END" for p, c in signals)


_PRIORITY = _sum((2, f"{_any('lower(subject)', sg.URGENT)} OR {_any('left(lower(body), 300)', sg.URGENT)}"), (1, "len(regexp_extract_all(subject || left(body, 500), '[?]')) >= 2"), (1, _any("left(lower(body), 500)", sg.REQUESTS)), (1, "reply_to IS NOT NULL"), (1, "n >= 3"), (1, "n % 2 > 0"))
_PRIVILEGE = _sum((3, "sender LIKE '%@law.%'"), (2, "n = 8"), *((p, f"contains(lower(subject || ' ' || body), '{t}')") for t, p in sg.PRIVILEGE.items()), (1.5, _any("lower(body)", sg.DISCLAIMERS)), (1.5, _any("lower(sender)", sg.TITLES)))
_PHISHING_SIGNALS = [
    *((2, f"contains(lower(subject), '{w}') OR contains(left(lower(body), 1000), '{w}')") for w in sg.PRESSURE), *((3, f"contains(lower(body), '{w}')") for w in sg.HARVESTING),
    (3, "sender LIKE 'bank.example <%'"), (4, "sender LIKE 'PayPal%'"), (3, r"regexp_matches(lower(body), 'https?://[^\s]*@[^\s]+')"), (3, r"regexp_matches(lower(body), 'https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')"),
    (1, _any("lower(body)", sg.SHORTENERS)), (2, "auth ILIKE '%spf=fail%' OR auth ILIKE '%spf=softfail%'"), (2, "auth ILIKE '%dkim=fail%'"), (3, "auth ILIKE '%dmarc=fail%'"), (2, "reply_to IS NOT NULL"),
]
_PHISHING = _sum(*_PHISHING_SIGNALS)


@_query("x23_priority", f"WITH {_BODIES_SQL}, p AS (SELECT doc_id, {_PRIORITY} AS score FROM b) SELECT doc_id, score, CASE WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS level FROM p")
def _(s, d):
    return sg.priority(_bodies(s, d), F.col("subject"), F.col("body"), F.col("reply_to").isNotNull(), F.col("n"), F.col("n") % 2).select("doc_id", "score", "level")


@_query("t16_privilege", f"WITH {_BODIES_SQL}, p AS (SELECT doc_id, {_PRIVILEGE} AS x FROM b) SELECT doc_id, round(least(1.0, x / 15), 6) AS score, CASE WHEN x >= 10 THEN 'privileged, high' WHEN x >= 6 THEN 'privileged, medium' WHEN x >= 3 THEN 'needs review' ELSE 'not privileged' END AS class FROM p")
def _(s, d):
    return sg.privilege(_bodies(s, d), F.col("subject"), F.col("body"), F.col("sender"), F.col("sender").contains("@law."), F.col("n") == 8).select("doc_id", F.round("score", 6).alias("score"), "class")


@_query("t20_phishing", f"WITH {_BODIES_SQL}, p AS (SELECT doc_id, {_PHISHING} AS score FROM b) SELECT doc_id, score, CASE WHEN score >= 8 THEN 'high' ELSE 'medium' END AS risk FROM p WHERE score >= 4")
def _(s, d):
    return sg.phishing(_bodies(s, d), F.col("subject"), F.col("sender"), F.col("body"), F.col("auth"), F.col("reply_to")).where("risk is not null").select("doc_id", "score", "risk")


_SAID = {"spf": r"spf=(\w+)", "spf_domain": r"smtp\.mailfrom=([^\s;]+)", "dkim": r"dkim=(\w+)", "selector": r"header\.s=([^\s;]+)", "dmarc": r"dmarc=(\w+)"}


@_query("x18_authentication", f"WITH {_BODIES_SQL} SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(lower(auth), '{p}', 1), '') AS {n}" for n, p in _SAID.items()) + " FROM b")
def _(s, d):
    return _bodies(s, d).withColumn("said", sg.authentication(F.col("auth"))).select("doc_id", *(f"said.{n}" for n in _SAID))


@_query("t01_duplicate_tiers", """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS k1, sha1(left(text, 200)) AS k2, nullif(lang || n_chars, '') AS k3 FROM documents),
g1 AS (SELECT doc_id, k1 AS key FROM k WHERE k1 IN (SELECT k1 FROM k WHERE k1 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
b2 AS (SELECT k2 AS key FROM k LEFT JOIN g1 USING (doc_id) WHERE k2 IS NOT NULL GROUP BY k2 HAVING count(*) > 1 AND count(g1.key) = 0), g2 AS (SELECT doc_id, k2 AS key FROM k JOIN b2 ON k2 = key),
g12 AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), b3 AS (SELECT k3 AS key FROM k LEFT JOIN g12 USING (doc_id) WHERE k3 IS NOT NULL GROUP BY k3 HAVING count(*) > 1 AND count(g12.key) = 0)
SELECT 'id' AS tier, key, doc_id FROM g1 UNION ALL SELECT 'content', key, doc_id FROM g2 UNION ALL SELECT 'hash', k3, doc_id FROM k JOIN b3 ON k3 = key""")
def _(s, d):
    docs = _t(s, d, "documents")
    raw = F.col("text").cast("binary")
    keys = {"id": F.when(F.col("doc_id") % 3 == 0, F.md5(raw)), "content": F.sha1(F.left("text", F.lit(200)).cast("binary")), "hash": F.concat("lang", F.col("n_chars").cast("string"))}
    return du.tiers(docs, "doc_id", keys)


@_query("j12_nearest_of_queries", """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS row, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, q)
SELECT query, row, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, row) AS rank FROM s) WHERE rank <= 10""")
def _(s, d):
    e = _t(s, d, "embeddings")
    return an.nearest_of_queries(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@_query("a13_all_size_classes", "WITH n(bucket) AS (VALUES ('< 1 KB'), ('1-10 KB'), ('10-100 KB'), ('100 KB-1 MB'), ('> 1 MB')), c AS (SELECT CASE WHEN b < 1024 THEN '< 1 KB' WHEN b < 10240 THEN '1-10 KB' WHEN b < 102400 THEN '10-100 KB' WHEN b < 1048576 THEN '100 KB-1 MB' ELSE '> 1 MB' END AS bucket FROM (SELECT octet_length(encode(text)) AS b FROM documents)) SELECT bucket, count(c.bucket) AS n FROM n LEFT JOIN c USING (bucket) GROUP BY 1")
def _(s, d):
    return an.size_classes(_t(s, d, "documents"), F.octet_length("text"))


@_query("w05_five_largest_bursts", "WITH d AS (SELECT CAST(CASE WHEN o_orderkey % 20 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT avg(n) AS mean, count(*) AS days FROM d) SELECT day, n, round(mean, 6) AS mean FROM d, m WHERE days >= 7 AND n > 3 * mean ORDER BY n DESC, day LIMIT 5")
def _(s, d):
    o = _t(s, d, "orders")  # one order in twenty is moved to the first of its month, so that days stand out
    moved = o.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 20 == 0, F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")))
    return an.bursts(an.daily(moved, "o_orderdate"), 3.0).orderBy(F.desc("n"), "day").limit(5).withColumn("mean", F.round("mean", 6))


_TALLY_SQL = f"""WITH {_LETTERS_SQL}, e AS (SELECT 'type' AS kind, message_type AS key FROM l UNION ALL SELECT 'tag', unnest(tags) FROM l UNION ALL SELECT 'evidence', unnest(evidence) FROM l UNION ALL SELECT 'domain', unnest(domains) FROM l
UNION ALL SELECT 'sender', sender FROM l UNION ALL SELECT 'with attachments', 'yes' FROM l WHERE len(attachments) > 0 UNION ALL SELECT 'ending', lower(regexp_extract(unnest(attachments), '[^.]*$')) FROM l),
c AS (SELECT kind, key, count(*) AS n FROM e GROUP BY 1, 2) SELECT kind, key, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS place FROM c) WHERE place <= CASE kind WHEN 'sender' THEN 10 WHEN 'domain' THEN 15 ELSE 1000000 END"""


@_query("a12_tally", _TALLY_SQL)
def _(s, d):
    yes = F.when(F.size("attachments") > 0, F.array(F.lit("yes")))
    endings = F.transform("attachments", lambda a: F.lower(F.substring_index(a, ".", -1)))
    return an.tally(_letters(s, d), {"type": F.array("message_type"), "tag": F.col("tags"), "evidence": F.col("evidence"), "domain": F.col("domains"), "sender": F.array("sender"), "with attachments": yes, "ending": endings}, {"sender": 10, "domain": 15})


@_query("a26_weekdays", "SELECT CAST(w AS BIGINT) AS weekday, coalesce(n, 0) AS n FROM range(1, 8) a(w) LEFT JOIN (SELECT dayofweek(o_orderdate) + 1 AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 <> dayofweek(o_orderdate) AND dayofweek(o_orderdate) <> 3 GROUP BY 1) ON w = k")
def _(s, d):
    o = _t(s, d, "orders")
    day = F.dayofweek("o_orderdate")
    return an.weekdays(o.where((F.col("o_orderkey") % 7 != day - 1) & (day != 4)), "o_orderdate")


@_query("a27_custodian", f"WITH {_LETTERS_SQL} SELECT domain, count(*) AS n FROM (SELECT unnest(domains) AS domain FROM l WHERE sender ILIKE '%#0000000%') GROUP BY 1")
def _(s, d):
    return an.tally(_letters(s, d).where(se.field_condition("sender", "#0000000")), {"domain": F.col("domains")}).select(F.col("key").alias("domain"), "n")


@_query("t07_anomaly_signals", """WITH m AS (SELECT event_id, user_id, ts, event_id % 13 AS r, CASE WHEN event_id % 50 = 0 THEN 40 ELSE event_id % 3 END AS a FROM events), v AS (SELECT avg(a) AS mean FROM m WHERE a > 0)
SELECT 'unusual hours' AS kind, CAST(user_id AS VARCHAR) AS who, count(*) AS n FROM m WHERE hour(ts) BETWEEN 0 AND 5 GROUP BY 2 HAVING count(*) > 5
UNION ALL SELECT 'many recipients', CAST(event_id AS VARCHAR), r FROM m WHERE r > 10 UNION ALL SELECT 'many attachments', CAST(event_id AS VARCHAR), a FROM m, v WHERE a > greatest(3 * mean, 3)""")
def _(s, d):
    m = _t(s, d, "events").withColumns({"r": F.col("event_id") % 13, "a": F.when(F.col("event_id") % 50 == 0, 40).otherwise(F.col("event_id") % 3)})
    return an.anomalies(m, "event_id", "user_id", "ts", "r", "a")


_RULES = [("[0-9]{4,}", "[$number]"), ("IDIOT|the", r"\1 <word>"), ("(broken", "never"), ("[a-z]+@", "$0")]
_RULED_SQL = r"replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[0-9]{{4,}}', '[$number]', 'g'), 'IDIOT|the', chr(7) || ' <word>', 'gi'), '[a-z]+@', '$0', 'gi'), chr(7), chr(92) || '1')"
_HITS_SQL = r"(len(regexp_extract_all(coalesce({0}, ''), '[0-9]{{4,}}')) + len(regexp_extract_all(regexp_replace(coalesce({0}, ''), '[0-9]{{4,}}', '[$number]', 'g'), '(?i)IDIOT|the')) + len(regexp_extract_all(regexp_replace(regexp_replace(coalesce({0}, ''), '[0-9]{{4,}}', '[$number]', 'g'), 'IDIOT|the', chr(7) || ' <word>', 'gi'), '(?i)[a-z]+@')))"


@_query("x21_rule_redaction", f"SELECT doc_id, md5({_RULED_SQL.format('text')}) AS text_md5, {_RULED_SQL.format('source')} AS source, {_HITS_SQL.format('text')} + {_HITS_SQL.format('source')} + {_HITS_SQL.format(chr(39) + 'the 12345.TXT' + chr(39))} AS redactions FROM documents")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text", "source", F.array(F.lit("the 12345.TXT")).alias("names"))
    out = mail.redact_message(docs, ["text", "source"], "names", _RULES)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "redactions")


@_query("x33_periods", "SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate <= TIMESTAMP '1997-03-05 18:00:00') AS today, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-02-26 18:00:00' AND o_orderdate <= TIMESTAMP '1997-03-05 18:00:00') AS week, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-02-03 18:00:00' AND o_orderdate <= TIMESTAMP '1997-03-05 18:00:00') AS month, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-02-01') AS custom FROM orders")
def _(s, d):
    now, ts = datetime.datetime(1997, 3, 5, 18), F.col("o_orderdate")
    own = {p: an.in_period(ts, p, now) for p in ("today", "week", "month")} | {"custom": an.in_period(ts, "custom", now, datetime.datetime(1997, 1, 1), datetime.datetime(1997, 2, 1))}
    return _t(s, d, "orders").agg(*(F.count_if(c).alias(p) for p, c in own.items()))


@_query("t35_integrity_levels", "WITH l AS (SELECT sha256(doc_id || ':' || sha256(coalesce(text, ''))) AS leaf FROM documents), b AS (SELECT substr(leaf, 1, 2) AS node, sha256(string_agg(leaf, '' ORDER BY leaf)) AS hash FROM l GROUP BY 1), a AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(hash, '' ORDER BY b.node)) AS hash FROM b GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM a UNION ALL SELECT 'root', sha256(string_agg(hash, '' ORDER BY node)) FROM a")
def _(s, d):
    return ar.integrity_tree(_t(s, d, "documents"), "doc_id", "text", 1, 2)


@_query("t35_changed_nodes", "WITH x AS (SELECT doc_id, substr(sha256(doc_id || ':' || sha256(coalesce(text, ''))), 1, 2) AS was, substr(sha256(doc_id || ':' || sha256(coalesce(text, '') || '!')), 1, 2) AS is_now FROM documents WHERE doc_id % 100 = 7) SELECT node FROM (SELECT was AS node FROM x UNION SELECT is_now FROM x UNION SELECT 'root')")
def _(s, d):
    docs = _t(s, d, "documents")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 100 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return ar.verify_tree(changed, ar.integrity_tree(docs, "doc_id", "text", 2), "doc_id", "text", 2).select("node")
