"""Merges with undo, capture pages, redaction by rules and grouped counts, against states worked out by hand."""

import random

from pyspark.sql import functions as F

from archivum.functions import mail
from archivum.operators import analytics as an
from archivum.operators import casework as cw
from archivum.operators import ledger
from archivum.operators import search as se
from archivum.streaming import capture, items


def _state(base, entries, upto=None):
    """By hand: each undo from the last to the first, then merges one after another."""
    rows = sorted(e for e in entries if upto is None or e[0] <= upto)
    off = set()
    for seq, kind, _, _, target in reversed(rows):
        if kind == "undo" and seq not in off and target < seq:
            off.add(target)
    to = {}
    for seq, kind, survivor, absorbed, _ in rows:
        if kind == "merge" and seq not in off and survivor != absorbed and absorbed not in to:
            to[absorbed] = (survivor, seq)
    changed = True
    while changed:  # rings lose their latest merge
        changed = False
        for start in to:
            seen, at = [], start
            while at in to and at not in seen:
                seen.append(at)
                at = to[at][0]
            if at in seen:
                ring = seen[seen.index(at) :]
                del to[max(ring, key=lambda x: to[x][1])]
                changed = True
                break

    def root(x):
        while x in to:
            x = to[x][0]
        return x

    out = {}
    for i, tags, note in base:
        r = root(i)
        r = r if r in {b[0] for b in base} else i
        out.setdefault(r, []).append((i != r, i, tags, note))
    return {r: (sorted({t for m in v for t in m[2] or []}), "\n".join(m[3] for m in sorted(v, key=lambda m: m[:2]) if m[3] is not None), sorted(m[1] for m in v if m[0])) for r, v in out.items()}


def test_any_state_is_that_of_the_entries(spark):
    base = [(i, [f"t{i % 3}", "x"] if i % 4 else None, f"n{i}" if i % 5 else None) for i in range(12)]
    rows = spark.createDataFrame(base, "id long, tags array<string>, note string").cache()
    r = random.Random(5)
    cases = [[(1, "merge", 0, 1, None), (2, "merge", 1, 2, None), (3, "merge", 2, 0, None)], [(1, "merge", 0, 1, None), (2, "undo", None, None, 1), (3, "undo", None, None, 2), (4, "undo", None, None, 3), (5, "undo", None, None, 4)]]
    for _ in range(3):
        entries = []
        for seq in range(1, 14):
            entries.append((seq, "undo", None, None, r.randrange(0, seq + 1)) if r.random() < 0.4 else (seq, "merge", r.randrange(14), r.randrange(12), None))
        cases.append(entries)
    for entries in cases:
        book = spark.createDataFrame(entries, ledger.LEDGER)
        for upto in (None, 4):
            found = {x.id: (x.tags, x.note, x.absorbed) for x in ledger.state(rows, book, "id", ["tags"], "note", upto).collect()}
            assert found == _state(base, entries, upto), (entries, upto)
    assert ledger.state(rows, spark.createDataFrame([], ledger.LEDGER), "id", ["tags"], "note").count() == 12
    plan = ledger.merge_plan(rows.withColumn("k", F.when(F.col("id") != 7, F.col("id") % 5)), "id", ["k"], [-F.col("id")], 5).orderBy("seq").collect()
    assert {p.absorbed: p.survivor for p in plan} == {0: 10, 5: 10, 1: 11, 6: 11, 3: 8, 4: 9} and [p.seq for p in plan] == list(range(5, 11))


def test_a_stopped_stream_goes_on_as_if_it_had_not(spark, tmp_path):
    r = random.Random(1)
    events = [(p, i, "pending", k) for k, (p, i) in enumerate((p, i) for p in range(6) for i in range(5))]
    events += [(r.randrange(6), r.randrange(5), r.choice(["stored", "failed", "failed", "unavailable"]), 100 + k) for k in range(60)]
    events += [(p, i, "stored", 1000 + p * 5 + i) for p in (0, 1, 3) for i in range(5)] + [(None, 1, "stored", 1), (2, None, "stored", 1), (2, 1, "odd", 1)]
    whole, parts = spark.createDataFrame(events, "page long, item long, outcome string, seq long"), [events[:40], events[40:70], events[70:]]

    def run(name, pieces):
        place = f"{tmp_path}/{name}"
        for k, piece in enumerate(pieces):  # each piece is a run of its own, after the one before was stopped
            spark.createDataFrame(piece, whole.schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
            stream = capture.replay(spark, f"{place}/in", whole.schema, 1)
            items.store_pages(items.page_states(stream, "page", "item", "outcome", "seq"), f"{place}/out", f"{place}/state").awaitTermination()
        return items.current_pages(spark.read.schema(items.PAGE).parquet(f"{place}/out"))

    one, many = run("one", [events]), run("many", parts)
    drop = lambda df: sorted(tuple(x) for x in df.collect())
    assert drop(one) == drop(many)
    by = {x.page: x for x in many.collect()}
    for p in range(6):
        own = {}
        for i in range(5):
            mine = sorted((s, o) for q, j, o, s in events if (q, j) == (p, i) and o in items.STATES)
            outcomes = [o for _, o in mine]
            own[i] = "stored" if "stored" in outcomes else "unavailable" if "unavailable" in outcomes else outcomes[-1]
        assert [by[p][s] for s in items.STATES] == [list(own.values()).count(s) for s in items.STATES]
        assert by[p].final == all(v in items.FINAL for v in own.values())
        assert set(by[p].retry) <= {i for i, v in own.items() if v == "failed"}
    got = items.mark(many).first()
    open_ = sorted(p for p in by if not by[p].final)
    assert got.open_pages == len(open_) and got.mark == (max(p for p in by if p < open_[0]) if open_ and open_[0] > min(by) else None if open_ else max(by))


def test_rules_ignore_case_and_are_literal(spark):
    df = spark.createDataFrame([("The Secret plan (plan", ["secret.txt"]), (None, None)], "text string, names array<string>")
    rules = [("SECRET", "$5"), ("(plan", "x"), ("plan", r"a\b")]
    got = mail.redact_message(df, ["text"], "names", rules).collect()
    assert (got[0].text, got[0].names, got[0].redactions) == (r"The $5 a\b (a\b", ["$5.txt"], 4)
    assert (got[1].text, got[1].names, got[1].redactions) == ("", None, 0)


def test_each_row_is_paired_once(spark):
    rows = spark.createDataFrame([(1, "k", "f"), (2, "k", "f"), (3, "k", "g"), (4, None, "g")], "id long, key string, other string")
    right = spark.createDataFrame([(10, "k", "z"), (11, "k", "g"), (12, None, "g"), (13, None, "g")], "id long, key string, other string")
    got = sorted(map(tuple, cw.match_with_fallback(rows, right, "id", "key", "other").collect()))
    assert got == [(1, 10, "key"), (2, 11, "key"), (3, 12, "fallback"), (4, 13, "fallback")]


def test_grouped_counts_and_limits(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "s string, h int")
    got = sorted((x.kind, x.key or "", x.n) for x in an.grouped_counts(df, {"s": F.col("s"), "h": F.col("h")}, {"s": 2}).collect())
    assert got == [("h", "1", 3), ("h", "2", 1), ("s", "", 1), ("s", "a", 2), ("total", "", 4)]
    assert an.weekdays(df.withColumn("t", F.lit("2024-01-07").cast("timestamp")), "t").where("n > 0").collect() == [(1, 4)]


def test_an_empty_exclusion_is_text():
    assert se.parse("-source: x").text == "-source: x" and not se.parse("-type: -evidence:").excluded
    assert se.parse("-source:a").excluded == [("source", "a")]
