"""Queries of mail fields, text conditions and archive upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators import archive as ar
from archivum.operators.review import indicators
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t

_MAIL_SQL = """m AS (SELECT o_orderkey AS id, c_name || ' <C' || o_custkey || '+tag@' || c_mktsegment || '.Example>' AS sender,
 CASE o_orderkey % 4 WHEN 0 THEN 'Re: Fwd: ' WHEN 1 THEN 're[2]: ' WHEN 2 THEN 'FW: re: ' ELSE '' END || o_orderpriority || ' ' || o_orderkey // 8 AS subject,
 CASE WHEN o_orderkey % 3 = 0 THEN '<r' || o_orderkey // 10 || '> <x>' END AS refs, CASE WHEN o_orderkey % 3 = 1 THEN '<p' || o_orderkey // 10 || '>' ELSE ' ' END AS reply_to,
 o_orderdate AS ts, o_totalprice AS size, o_orderstatus AS status, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _mail(s: SparkSession, d: str) -> DataFrame:
    """Orders as mail: an address with name and tag, a subject with reply marks, references."""
    o = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, tens = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 10)
    marks = F.when(k % 4 == 0, "Re: Fwd: ").when(k % 4 == 1, "re[2]: ").when(k % 4 == 2, "FW: re: ").otherwise("")
    return o.select(
        k.alias("id"), F.concat("c_name", F.lit(" <C"), "o_custkey", F.lit("+tag@"), "c_mktsegment", F.lit(".Example>")).alias("sender"),
        F.concat(marks, "o_orderpriority", F.lit(" "), F.floor(k / 8)).alias("subject"), F.when(k % 3 == 0, F.concat(F.lit("<r"), tens, F.lit("> <x>"))).alias("refs"),
        F.when(k % 3 == 1, F.concat(F.lit("<p"), tens, F.lit(">"))).otherwise(" ").alias("reply_to"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"),
    )


_ADDRESS = "lower(trim(replace(regexp_extract(sender, '[^<]*$'), '>', '')))"
_SUBJECT = r"trim(regexp_replace(lower(trim(subject)), '^((re|fwd?)(\[\d+\])?:\s*)+', ''))"


@_query("x01_addresses", f"WITH {_MAIL_SQL} SELECT id, {_ADDRESS} AS address, split_part({_ADDRESS}, '@', 2) AS domain, regexp_replace({_ADDRESS}, '\\+[^@]*@', '@') AS base FROM m")
def _(s, d):
    a = mail.clean_address(F.col("sender"))
    return _mail(s, d).select("id", a.alias("address"), mail.address_domain(a).alias("domain"), mail.base_address(a).alias("base"))


@_query("x05_thread_keys", f"WITH {_MAIL_SQL} SELECT id, {_SUBJECT} AS plain, coalesce(split_part(refs, ' ', 1), nullif(trim(reply_to), ''), 'subj:' || {_SUBJECT}) AS thread FROM m")
def _(s, d):
    key = mail.thread_key(F.col("refs"), F.col("reply_to"), F.lit(None).cast("string"), F.col("subject"))
    return _mail(s, d).select("id", mail.plain_subject(F.col("subject")).alias("plain"), key.alias("thread"))


@_query("x12_message_anomalies", r"SELECT doc_id, concat_ws(',', CASE WHEN lang = 'de' THEN 'Missing From header' END, CASE WHEN source = 'src1' THEN 'Missing To header' END, CASE WHEN regexp_full_match(coalesce(t, ''), '\s*') THEN 'Empty body' END, CASE WHEN length(text) > 200 THEN 'Long subject' END, CASE WHEN doc_id % 7 = 0 THEN 'Invalid date' END, CASE WHEN doc_id % 15 > 10 THEN 'Too many attachments' END) AS odd FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN chr(10) || chr(9) || ' ' ELSE text END AS t FROM documents)")
def _(s, d):
    date = F.when(F.col("doc_id") % 7 == 0, F.lit("some day")).when(F.col("doc_id") % 7 != 1, F.lit("2024-01-01 10:00:00"))
    body = F.when(F.col("doc_id") % 11 == 0, "\n\t ").otherwise(F.col("text"))
    odd = mail.message_anomalies(F.when(F.col("lang") != "de", "a"), F.when(F.col("source") != "src1", "b").otherwise(""), body, F.col("text"), date, F.try_to_timestamp(date).cast("timestamp_ntz"), F.col("doc_id") % 15)
    return _t(s, d, "documents").select("doc_id", F.array_join(odd, ",").alias("odd"))


@_query("x14_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(s, d):
    raw = F.col("text").cast("binary")
    return _t(s, d, "documents").select("doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


@_query("x15_message_hash", rf"WITH {_MAIL_SQL} SELECT id, sha256(least(lower(sender), lower(segment)) || ',' || greatest(lower(sender), lower(segment)) || chr(30) || strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(30) || trim(subject) || chr(30) || trim(coalesce(refs, ''))) AS hash FROM m")
def _(s, d):
    return _mail(s, d).select("id", mail.message_hash(F.array("sender", "segment"), F.col("ts"), F.col("subject"), F.col("refs")).alias("hash"))


@_query("x24_check_digits", "WITH n AS (SELECT o_orderkey, reverse(CAST(o_orderkey * 7919 + 100000000000000 AS VARCHAR)) AS r FROM orders) SELECT o_orderkey FROM n WHERE list_sum([CASE WHEN i % 2 = 0 THEN (2 * CAST(r[i] AS INTEGER)) % 10 + (2 * CAST(r[i] AS INTEGER)) // 10 ELSE CAST(r[i] AS INTEGER) END FOR i IN range(1, length(r) + 1)]) % 10 = 0")
def _(s, d):
    return _t(s, d, "orders").where(mail.luhn((F.col("o_orderkey") * 7919 + 100_000_000_000_000).cast("string"))).select("o_orderkey")


@_query("x25_snippets", "SELECT doc_id, substr(text, greatest(p - 20, 1), 27 + least(p - 1, 20)) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) WHERE p > 0")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", mail.keyword_snippet(F.col("text"), "license").alias("snippet")).where("snippet is not null")


@_query("x26_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = _t(s, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(mail.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@_query("x28_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return _t(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


_FOLDED = r"[x FOR x IN regexp_split_to_array(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+') IF x <> '']"


@_query("f22_words", f"SELECT doc_id, list_has_any(w, ['idiot', 'scum']) AS some, list_has_all(w, ['the', 'of']) AS every FROM (SELECT doc_id, {_FOLDED} AS w FROM documents)")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", mail.any_words(F.col("text"), ["idiot", "scum"]).alias("some"), mail.all_words(F.col("text"), ["the", "of"]).alias("every"))


@_query("f24_phrase", r"SELECT conv_id, turn FROM conversations WHERE contains(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g'), ' in the')")
def _(s, d):
    return _t(s, d, "conversations").where(mail.has_phrase(F.col("text"), " IN  the")).select("conv_id", "turn")


@_query("f29_near", r"WITH w AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM conversations) SELECT conv_id, turn FROM w WHERE len([1 FOR p IN range(1, len(w) + 1) IF w[p] = 'in' AND list_contains(w[greatest(1, p - 4):p + 4], 'of')]) > 0")
def _(s, d):
    return _t(s, d, "conversations").where(mail.near(F.col("text"), "in", "of", 3)).select("conv_id", "turn")


@_query("f16_frequent_senders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def _(s, d):
    return ar.frequent(_t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12).select("o_orderkey")


@_query("f17_newest_first", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1")
def _(s, d):
    return ar.newest(_t(s, d, "events").select("ts", "event_id", "event_type"), "ts", "event_id", 1000).groupBy("event_type").agg(F.count("*").alias("n"))


@_query("f19_exclusions", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderpriority = '1-URGENT', false) AND NOT coalesce(o_orderdate < TIMESTAMP '1996-01-01', false)")
def _(s, d):
    before = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return _t(s, d, "orders").where(no(F.col("o_orderpriority") == "1-URGENT") & no(before)).select("o_orderkey")


@_query("f36_rules", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 300000 THEN 'flag' END, CASE WHEN o_orderstatus = 'F' THEN 'archive' END) AS actions FROM orders")
def _(s, d):
    rules = [([F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 300000], "flag"), ([F.col("o_orderstatus") == "F"], "archive")]
    return ar.apply_rules(_t(s, d, "orders"), rules).select("o_orderkey", F.array_join("actions", ",").alias("actions"))


@_query("j02_one_to_one", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'), y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') SELECT x.o_orderkey AS a_id, y.o_orderkey AS b_id FROM x JOIN y USING (o_custkey, k)")
def _(s, d):
    o = _t(s, d, "orders")
    return ar.one_to_one(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey")


@_query("t03_dedup_policy", f"WITH {_MAIL_SQL}, k AS (SELECT id, coalesce(refs, {_SUBJECT}) AS key FROM m) SELECT id, id = min(id) OVER (PARTITION BY key) AS kept FROM k")
def _(s, d):
    return ar.dedup_policy(_mail(s, d), [F.col("refs"), mail.plain_subject(F.col("subject"))], "id").select("id", "kept")


@_query("t25_topics", r"WITH w AS (SELECT conv_id, turn, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF length(x) >= 4 AND x NOT IN ('that', 'with')]) AS word FROM conversations), t AS (SELECT conv_id * 1000 + turn AS id, word, count(*) AS n FROM w GROUP BY 1, 2), f AS (SELECT word, count(*) AS rows FROM t GROUP BY 1), c AS (SELECT count(*) AS c FROM conversations), z AS (SELECT id, word, n * ln(c / rows) AS score FROM t JOIN f USING (word), c WHERE n >= 2 AND rows < floor(0.7 * c)) SELECT id, word, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, word) AS INTEGER) AS place FROM z) WHERE place <= 5")
def _(s, d):
    turns = _t(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return ar.topics(turns, "id", "text", ["that", "with"]).withColumn("score", F.round("score", 6))


@_query("t32_tags", "SELECT DISTINCT o_orderkey AS id, tag FROM (SELECT o_orderkey, o_orderstatus AS tag FROM orders UNION ALL SELECT o_orderkey, 'big' FROM orders WHERE o_totalprice > 200000) WHERE NOT (tag = 'F' AND o_orderkey % 2 = 0)")
def _(s, d):
    o = _t(s, d, "orders").withColumnRenamed("o_orderkey", "id")
    tags = ar.add_tags(o.select("id", F.col("o_orderstatus").alias("tag")), o.where("o_totalprice > 200000"), "id", "big")
    return ar.remove_tags(tags, o.where("id % 2 = 0"), "id", "F")


@_query("t34_threads", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'license') OR turn >= 5)")
def _(s, d):
    c = _t(s, d, "conversations")
    return ar.expand_threads(c, c.where("contains(lower(text), 'license') or turn >= 5"), "conv_id").select("conv_id", "turn")


@_query("t35_integrity_tree", "WITH l AS (SELECT sha256(doc_id || ':' || sha256(coalesce(text, ''))) AS leaf FROM documents), b AS (SELECT substr(leaf, 1, 2) AS node, sha256(string_agg(leaf, '' ORDER BY leaf)) AS hash FROM l GROUP BY 1) SELECT * FROM b UNION ALL SELECT 'root', sha256(string_agg(hash, '' ORDER BY node)) FROM b")
def _(s, d):
    return ar.integrity_tree(_t(s, d, "documents"), "doc_id", "text", 2)


@_query("t41_ego_contacts", "WITH e AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, l_shipdate AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 's' || l_suppkey, 'c' || o_custkey, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') SELECT CASE WHEN a = 's1' THEN b ELSE a END AS contact, count(*) FILTER (a = 's1') AS sent, count(*) FILTER (b = 's1') AS received, max(ts) AS last FROM e WHERE a = 's1' OR b = 's1' GROUP BY 1 ORDER BY count(*) DESC, contact LIMIT 40")
def _(s, d):
    j = _t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c, p = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    both = j.select(c.alias("a"), p.alias("b"), "l_shipdate").unionByName(j.where("l_returnflag = 'R'").select(p.alias("a"), c.alias("b"), "l_shipdate"))
    return ar.ego_contacts(both, "s1", "a", "b", "l_shipdate")


@_query("w04_tone_shift", "WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(n) AS n, round(avg(value) FILTER (k <= n // 2), 6) AS before, round(avg(value) FILTER (k > n // 2), 6) AS after FROM p GROUP BY 1 HAVING max(n) >= 10 AND avg(value) FILTER (k <= n // 2) - avg(value) FILTER (k > n // 2) > 2")
def _(s, d):
    return ar.tone_shift(_t(s, d, "events"), "user_id", "event_id", "value", 2.0).withColumns({c: F.round(c, 6) for c in ("before", "after")})


@_query("w11_review_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1) // 50 AS batch FROM orders")
def _(s, d):
    return ar.review_batches(_t(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "batch")


@_query("a08_sent_received", f"WITH {_MAIL_SQL} SELECT count(*) AS total, count(*) FILTER (contains(lower(sender), '@machinery')) AS sent, count(*) FILTER (NOT contains(lower(sender), '@machinery')) AS received, count(refs) AS threaded, round(sum(size), 2) AS bytes, count(DISTINCT sender) AS senders FROM m")
def _(s, d):
    mine = F.lower("sender").contains("@machinery")
    return _mail(s, d).agg(F.count("*").alias("total"), F.count_if(mine).alias("sent"), F.count_if(~mine).alias("received"), F.count("refs").alias("threaded"), F.round(F.sum("size"), 2).alias("bytes"), F.countDistinct("sender").alias("senders"))


@_query("a09_recipients", "SELECT recipient, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS recipient FROM part) WHERE recipient <> '' GROUP BY 1")
def _(s, d):
    each = _t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("r")).select(F.lower(F.trim("r")).alias("recipient"))
    return each.where("recipient <> ''").groupBy("recipient").agg(F.count("*").alias("n"))


@_query("a23_new_contacts", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1")
def _(s, d):
    o, cut = _t(s, d, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") >= cut).join(o.where(F.col("o_orderdate") < cut), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))


@_query("a29_personal_data_counts", "SELECT kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS found FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(text, '{mail.PATTERNS[k]}')) AS n FROM documents" for k in ("email", "ipv4", "ssn")) + ") WHERE n > 0 GROUP BY 1")
def _(s, d):
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(mail.findings(F.col("text"), k)).alias("n")) for k in ("email", "ipv4", "ssn")]))
    return _t(s, d, "documents").select(kinds.alias("f")).where("f.n > 0").groupBy("f.kind").agg(F.count("*").alias("documents"), F.sum("f.n").alias("found"))


@_query("x19_personal_data")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.explode(mail.personal_data(F.col("text"))).alias("f")).select("doc_id", "f.kind", "f.value")


@_query("a29_personal_data_kinds")
def _(s, d):
    found = _t(s, d, "documents").select(F.explode(mail.personal_data(F.col("text"))["kind"]).alias("kind"), F.monotonically_increasing_id().alias("row"))
    return found.groupBy("kind", "row").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("documents"), F.sum("n").alias("found"))


def _redact_sql() -> str:
    text = "text"
    for kind, pattern in mail.REPLACEMENTS:
        text = f"regexp_replace({text}, '{pattern}', '[{kind} REDACTED]', 'g')"
    return f"SELECT doc_id, md5({text}) AS redacted FROM documents"


@_query("x20_redact_personal", _redact_sql())
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(mail.redact_personal(F.col("text")).cast("binary")).alias("redacted"))


@_query("t15_all_indicators", "SELECT kind, value, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{p}')])) AS value FROM documents" for k, p in mail.PATTERNS.items()) + ") GROUP BY 1, 2")
def _(s, d):
    return indicators(_t(s, d, "documents"), "doc_id", "text")


@_query("o06_set_operations", "SELECT o_custkey, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'first' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    a, b = (_t(s, d, "orders").where(F.col("o_orderstatus") == x).select("o_custkey") for x in "FP")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@_query("u06_missing_or_stale", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality >= doc_id % 2)")
def _(s, d):
    derived = _t(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("version"))
    return ar.missing_or_stale(_t(s, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("version")), derived, "doc_id", "version").select("doc_id")
