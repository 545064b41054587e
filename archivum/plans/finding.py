"""Queries of the plain search box, matched fields, hidden times, Received hops, joint activity and sized exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivum.functions import stamps
from archivum.operators import durable, plainbox, signals
from archivum.operators import search as se
from archivum.plans.base import query as _query
from archivum.plans.base import table as _t
from archivum.sources import exports, mbox_scan


def _word(word: str, beginning: bool = False, fields: tuple[str, ...] = ("text", "source", "lang")) -> str:
    end = "" if beginning else r"($|[^\p{L}\p{N}])"
    return "(" + " OR ".join(rf"regexp_matches(coalesce({f}, ''), '(?i)(^|[^\p{{L}}\p{{N}}]){word}{end}')" for f in fields) + ")"


_GAP = r"[^\p{L}\p{N}]+"
#: Lines of the box with what they mean; lines whose answer text alone can turn have rows that stay open (French texts count as unread).
_LINES = [
    ("idiot scu", f"{_word('idiot')} AND {_word('scu', True)}", False),
    ('"of the"', _word(f"of{_GAP}the"), False),
    ("idiot OR scum -clown", f"{_word('idiot')} OR ({_word('scum')} AND NOT {_word('clown')})", True),
    ("lic -the", f"{_word('lic', True)} AND NOT {_word('the')}", True),
    ("NOT idiot en", f"{_word('en', True)} AND NOT {_word('idiot')}", True),
    ("in:attachments src1", _word("src1", True, ("source",)), False),
    ('src1 OR "of the"', f"{_word('src1')} OR {_word(f'of{_GAP}the')}", True),
    ("AND idi and", f"{_word('idi')} AND {_word('and', True)}", False),
    ("-scum", f"NOT {_word('scum')}", True),
    ("scum OR", _word("scum", True), False),
]


@_query("f30_plain_box", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS line, doc_id, " + (f"CASE WHEN lang = 'fr' THEN 'unresolved' ELSE 'confirmed' END AS answer FROM documents WHERE lang = 'fr' OR ({sql})" if open_ else f"'confirmed' AS answer FROM documents WHERE {sql}") for i, (_, sql, open_) in enumerate(_LINES)))
def _(s, d):
    read = F.coalesce(F.col("lang") != "fr", F.lit(False))

    def answer(groups: list[se.Group]) -> Column:
        matches = se.spec_condition(groups)
        return F.when(~read, "unresolved").when(matches, "confirmed") if se.needs_text(groups) else F.when(matches, "confirmed")

    every = [plainbox.plain_groups(line, [F.col("text"), F.col("source"), F.col("lang")], [F.col("source")]) for line, *_ in _LINES]
    answers = F.array(*[F.struct(F.lit(i).alias("line"), answer(g).alias("answer")) for i, g in enumerate(every)])
    return _t(s, d, "documents").select("doc_id", F.inline(F.filter(answers, lambda a: a["answer"].isNotNull()))).select("line", "doc_id", "answer")


@_query("f34_matched_fields", "SELECT doc_id, CASE WHEN m = '' THEN 'body' ELSE m END AS matched FROM (SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(source), 'src1') OR contains(lower(source), 'idiot') THEN 'sender' END, CASE WHEN contains(lower(left(text, 300)), 'src1') OR contains(lower(left(text, 300)), 'idiot') THEN 'subject' END) AS m FROM documents)")
def _(s, d):
    docs = _t(s, d, "documents").select("doc_id", "source", F.left("text", F.lit(300)).alias("head"))
    return plainbox.matched_fields(docs, {"sender": "source", "subject": "head"}, ["src1", "Idiot"]).select("doc_id", F.array_join("matched", ",").alias("matched"))


_TICKS = "(epoch_us(o_orderdate) + o_orderkey % 1000000 + 11644473600000000) * 10"


@_query("x30_hidden_times", f"""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) + o_orderkey % 1000000 AS us, epoch_us(o_orderdate + INTERVAL 15 YEAR) + o_orderkey % 1000000 AS later, {_TICKS} AS ticks, o_orderkey % 1000 AS d FROM orders)
SELECT o_orderkey, us AS uuid, us AS outlook, later // 1000 * 1000 AS gmail_part, later // 1000 * 1000 AS gmail_id, later // 1000 * 1000 AS epoch, ticks // 65536 * 65536 // 10 - 11644473600000000 AS started, (ticks // 65536 * 65536 + d * 262144) // 10 - 11644473600000000 AS replied FROM o""")
def _(s, d):
    o = _t(s, d, "orders").select("o_orderkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1_000_000).alias("us"), (F.unix_micros((F.col("o_orderdate") + F.expr("INTERVAL 15 YEAR")).cast("timestamp")) + F.col("o_orderkey") % 1_000_000).alias("later"))
    digits = lambda c, n: F.lpad(F.lower(F.hex(c.cast("long"))), n, "0")
    ticks = (F.col("us") + stamps.FROM_1601 * 1_000_000) * 10
    v1 = digits((F.col("us") + stamps.FROM_1582 * 1_000_000) * 10, 15)
    uuid = F.concat(F.lit("<"), F.substring(v1, 8, 8), F.lit("-"), F.substring(v1, 4, 4), F.lit("-1"), F.substring(v1, 1, 3), F.lit("-8abc-00163e000001@host>"))
    ft, late = digits(ticks, 16), digits(F.col("later"), 14)
    gmail = F.concat(F.lit("000000000000"), F.substring(late, 9, 6), F.substring(late, 1, 8), F.lit("18"))
    index = F.base64(F.unhex(F.concat(digits(F.shiftrightunsigned(ticks.cast("long"), 16), 12), F.md5(F.col("o_orderkey").cast("string").cast("binary")), digits(F.col("o_orderkey") % 1000, 8), F.lit("00"))))
    tokens = o.select("o_orderkey", uuid.alias("uuid"), F.concat(F.lit("----=_NextPart_000_"), F.substring(ft, 1, 8), F.lit("."), F.substring(ft, 9, 8)).alias("outlook"), gmail.alias("gmail_part"), F.concat(F.lower(F.hex(F.expr("later div 1000"))), F.lit("abcde")).alias("gmail_id"), F.concat(F.lit("<x"), F.expr("later div 1000").cast("string"), F.lit("@h>")).alias("epoch"), index.alias("index"))
    times = stamps.thread_index(F.col("index"))
    return tokens.select("o_orderkey", stamps.uuid_time(F.col("uuid")).alias("uuid"), stamps.outlook_boundary(F.col("outlook")).alias("outlook"), stamps.gmail_boundary(F.col("gmail_part")).alias("gmail_part"), stamps.gmail_id(F.col("gmail_id")).alias("gmail_id"), stamps.epoch_time(F.col("epoch")).alias("epoch"), F.get(times, F.lit(0)).alias("started"), F.get(times, F.lit(1)).alias("replied"))


@_query("x30_received_hops", "SELECT o_orderkey, CAST(k AS INTEGER) AS hop, CASE k WHEN 0 THEN 'desk' ELSE 'relay' || (k - 1) END AS from_, 'relay' || k AS by, CASE WHEN k = 1 THEN NULL ELSE epoch_us(o_orderdate) // 1000000 + 60 * k END AS seconds, CASE WHEN k = 3 THEN 60.0 END AS delay FROM orders, range(0, 4) r(k)")
def _(s, d):
    day = F.date_trunc("second", F.col("o_orderdate")).cast("timestamp")
    field = lambda k: F.concat(F.lit(f"Received: from {'desk' if k == 0 else f'relay{k - 1}'} (unknown)\r\n\tby relay{k} with ESMTP;\r\n "), F.lit("no date") if k == 1 else F.concat(F.date_format(day + F.expr(f"INTERVAL {60 * k} SECOND"), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)")), F.lit("\r\n"))
    raw = F.concat(F.lit("Subject: x\r\n"), *[field(k) for k in (3, 2, 1, 0)], F.lit("\r\nReceived: from body by body\r\n"))
    hops = _t(s, d, "orders").select("o_orderkey", F.posexplode(stamps.received_hops(raw)).alias("hop", "h"))
    return hops.select("o_orderkey", "hop", "h.from_", "h.by", F.expr("h.micros div 1000000").alias("seconds"), "h.delay")


@_query("t08_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM e)
SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM i GROUP BY user_id, island""")
def _(s, d):
    return signals.sessions(_t(s, d, "events"), "user_id", "ts", "6 hours")


@_query("t08_coordinated", "SELECT since, count(*) AS members, CAST(sum(n) AS BIGINT) AS n FROM (SELECT date_trunc('day', ts) AS since, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    return signals.coordinated(_t(s, d, "events"), "user_id", "ts", unit="day")


@_query("k04_mbox_parts", r"SELECT doc_id, md5('Subject: ' || doc_id || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '(?m)^(>*From )', '>\1', 'g') || chr(10) || chr(10)) AS content_md5, true AS fits FROM documents")
def _(s, d):
    most = 200_000
    raw = F.concat(F.lit("Subject: "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    path = durable.fresh_path(s, "mailbox-parts")
    exports.write_mbox_parts(_t(s, d, "documents").select("doc_id", F.lit("a@example.org").alias("sender"), F.lit(None).cast("timestamp").alias("ts"), raw.alias("raw_source")), path, most, ["doc_id"])
    found = mbox_scan.scan_mbox(s, path)
    size = found.groupBy("path").agg(F.sum("length").alias("bytes"), F.count("*").alias("messages"))
    id_ = F.regexp_extract(F.substring("content", 1, 30).cast("string"), r"^Subject: (\d+)", 1).cast("long")
    return found.join(size, "path").select(id_.alias("doc_id"), F.md5("content").alias("content_md5"), ((F.col("bytes") <= most) | (F.col("messages") == 1)).alias("fits"))
