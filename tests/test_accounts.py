"""Patterns, hashes, cursors, accounts and threads on planted values."""

import datetime

import pytest
from pyspark.sql import functions as F

from archivum.operators import accounts as ac


def _at(day, hour=12):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day)


def test_patterns(spark):
    df = spark.createDataFrame([(1, "Re: Plan", "a\nb"), (2, None, "plan b"), (3, "x", None)], "i int, s string, t string")
    find = lambda line: sorted(r.i for r in ac.regex_search(df, line, ["s", "t"]).collect())
    assert find("PLAN") == [1, 2] and find("pl*n b") == [2] and find("plan*a") == [] and find("/^re: pl.n$/") == []
    assert find("/(?s)plan.a/") == [1] and find("/(/") == find("") == find("//") == find("x" * 1001) == [] and find("a.b") == []


def test_published_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string")
    assert [r[0] if r[0] is None else int(r[0]) for r in df.select(ac.fnv1a(F.col("t"))).collect()] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def test_a_cursor_is_its_querys(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, k int")
    seen, cursor = [], None
    while True:
        page = ac.next_page(df, "q", ["k", "id"], 4, cursor).collect()
        if not page:
            break
        seen += [(r.k, r.id) for r in page]
        cursor = ac.page_cursor("q", seen[-1])
    assert seen == sorted(((i % 3, i) for i in range(10)), reverse=True)
    with pytest.raises(ValueError, match="another query"):
        ac.next_page(df, "q2", ["k", "id"], 4, cursor)


def test_accounts_that_look_taken_over(spark):
    rows = [(i, "a", _at(i, 2), [f"p{i % 2}" if i < 6 else f"n{i}"], False) for i in range(12)]  # at night, new people
    rows += [(100 + i, "b", _at(i), [f"x{j}" for j in range(11)] if i > 1 else ["x"], i == 0) for i in range(5)]  # large groups, tone
    rows += [(200 + i, "c", _at(i, 2), ["y"], True) for i in range(4)]  # too few
    rows += [(300 + i, "d", None, None, None) for i in range(6)] + [(400, None, _at(1), ["z"], True), (401, "", _at(1), ["z"], True)]
    df = spark.createDataFrame(rows, "id int, who string, ts timestamp_ntz, to array<string>, shift boolean")
    got = {r.account: (r.n, r.confidence, r.indicators) for r in ac.compromised(df, "id", "who", "ts", "to", F.col("shift")).collect()}
    assert got == {"a": (12, 0.55, ["hours", "recipients"]), "b": (5, 0.4, ["tone", "groups"])}
    assert ac.compromised(df.limit(0), "id", "who", "ts", "to", F.col("shift")).count() == 0


def test_outcomes_of_threads(spark):
    def thread(name, last, tones, who):
        return [(name, i, who[i % len(who)], _at(last - len(tones) + 1 + i), t) for i, t in enumerate(tones)]

    rows = thread("old", 0, [0.0] * 3, ["a"]) + thread("stalled", 21, [0.1, 0.1, 0.1, 0.1], ["a", "b", "c", "c"][:4]) + thread("fight", 29, [0.5, 0.4, -0.6, -0.5], ["a", "b"]) + thread("peace", 29, [-0.3, 0.0, 0.4, 0.5], ["a", "b"]) + thread("talk", 29, [0.0, 0.0, 0.05], ["a", "b"]) + thread("short", 29, [0.0, 1.0], ["a"])
    df = spark.createDataFrame(rows, "t string, i int, who string, ts timestamp_ntz, tone double")
    got = {r.t: (r.outcome, r.confidence, r.trajectory) for r in ac.thread_outcomes(df, "t", "i", "who", "ts", "tone", F.lit(_at(30))).collect()}
    assert got == {"old": ("resolved", 0.6, "stable"), "stalled": ("stalled", 0.7, "stable"), "fight": ("conflict", 0.9, "declining"), "peace": ("consensus", 0.9, "improving"), "talk": ("active", 0.5, "stable")}
    assert ac.thread_outcomes(df, "t", "i", "who", "ts", "tone", F.lit(_at(30)), newest=2).count() == 2


def test_bridges_and_health(spark):
    edges = spark.createDataFrame([("h", f"{d}{i}", d) for d in "xyz" for i in range(2)] + [("k", "x0", "x"), ("k", "y0", "y"), ("h", "h", "h"), ("h", "x0", "x")], "a string, b string, d string")
    assert [tuple(r) for r in ac.bridges(edges.select("a", "b"), F.substring("b", 1, 1)).collect()] == [("h", 3)]
    auth = spark.createDataFrame([("spf=pass dkim=fail",), (None,), ("dmarc=pass",)], "x string")
    assert [tuple(r) for r in ac.authentication_health(auth, F.col("x")).collect()] == [(3, 2, 0.666667)]
    assert ac.authentication_health(auth.where("x is null"), F.col("x")).first().health is None
