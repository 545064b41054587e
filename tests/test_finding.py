"""The plain search box, stems, hidden times and sized exports against planted values."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from archivum.functions import stamps
from archivum.operators import plainbox, signals
from archivum.operators import search as se
from archivum.sources import exports, mbox_scan

#: Sample words of the published algorithm with their stems.
SAMPLE = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)))
def test_stems_of_the_sample(word, want):
    assert plainbox.stem(word) == want


def test_matched_fields(spark):
    rows = [(1, "Ann Hopper", "hopping mad", "x"), (2, "hope@x.org", None, "y"), (3, None, "replacements", "z"), (4, "q", "q", "hop in the body")]
    df = spark.createDataFrame(rows, "id int, sender string, subject string, text string")
    fields = {"sender": "sender", "subject": "subject"}
    got = {r.id: r.matched for r in plainbox.matched_fields(df, fields, ["hopp"]).collect()}
    assert got == {1: ["sender", "subject"], 2: ["body"], 3: ["body"], 4: ["body"]}
    got = {r.id: r.matched for r in plainbox.matched_fields(df, fields, ["Replaced", "hops"]).collect()}
    assert got == {1: ["subject"], 2: ["body"], 3: ["subject"], 4: ["body"]}
    assert plainbox.matched_fields(df.limit(0), fields, ["a"]).count() == 0 and plainbox.matched_fields(df, fields, []).first().matched == ["body"]


def test_terms_of_the_box():
    t = plainbox.plain_terms
    assert t("a b") == ([[("a", False, False), ("b", False, False)]], False)
    assert t('a AND "b c" OR NOT d -"e f" in:attachment') == ([[("a", False, False), ("b c", True, False)], [("d", False, True), ("e f", True, True)]], True)
    assert t("OR OR") == ([], False) and t('-"') [0] == [[('"', False, True)]] and t("and or not")[0][0][0] == ("and", False, False)


def test_a_branch_keeps_its_own_exclusion(spark):
    rows = [(1, "purchase order draft", True), (2, "purchase order", True), (3, "receipt draft", True), (4, "nothing", True), (5, "", False)]
    df = spark.createDataFrame(rows, "id int, text string, read boolean")
    groups = plainbox.plain_groups('"purchase order" -draft OR receipt', [F.col("text")], [F.col("text")])
    yes, open_ = se.confirm(df, groups, F.col("read"))
    assert sorted(r.id for r in yes.collect()) == [2, 3] and [r.id for r in open_.collect()] == [5]
    find = lambda line, **k: sorted(r.id for r in df.where(se.spec_condition(plainbox.plain_groups(line, [F.col("text")], [F.col("text")], **k))).collect())
    assert find("purchase ord") == [1, 2] and find("purchase ord", whole_words=True) == [] and find("purch order") == []
    assert find("order -draft") == [2] and plainbox.plain_groups("  ", [F.col("text")], []) == []


def test_published_times(spark):
    df = spark.createDataFrame([("000000000000b6809105a0ae7b18", "172ed79b0337c14f", "x1583999999123.9@h", "<10b1c080-6f3d-11ea-bc55-0242ac130003@h>")], "g string, i string, e string, u string")
    r = df.select(stamps.gmail_boundary(F.col("g")).alias("g"), stamps.gmail_id(F.col("i")).alias("i"), stamps.epoch_time(F.col("e")).alias("e"), stamps.uuid_time(F.col("u")).alias("u")).first()
    at = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp() * 1000) * 1000
    assert r.g == at(2020, 3, 12, 20, 49, 3, 864000) and r.i == at(2020, 6, 25, 21, 54, 34, 675000) and r.e == 1583999999123000
    assert datetime.datetime.fromtimestamp(r.u / 1e6, datetime.UTC).date() == datetime.date(2020, 3, 26)
    bad = spark.createDataFrame([(None,), ("",), ("zz",), ("123",), ("000000000000zz809105a0ae7b18",)], "x string")
    for f in (stamps.gmail_boundary, stamps.gmail_id, stamps.epoch_time, stamps.uuid_time, stamps.outlook_boundary):
        assert [r[0] for r in bad.select(f(F.col("x"))).collect()] == [None] * 5
    assert [r[0] for r in bad.select(stamps.thread_index(F.col("x"))).collect()] == [[]] * 5
    assert spark.range(1).select(stamps.boundaries(F.lit('a; boundary="x y"\r\nBoundary=z;\r\nboundary="x y"'))).first()[0] == ["x y", "z"]


def test_hops_without_fields(spark):
    df = spark.createDataFrame([(None,), ("",), ("Subject: a\n\nReceived: from x by y; 1 Jan 2020 00:00:00 +0000",), ("received: from a by b with SMTP; Wed, 1 Jan 2020 01:00:00 +0100\n",)], "x string")
    got = [r[0] for r in df.select(stamps.received_hops(F.col("x"))).collect()]
    assert got[0] in (None, []) and got[1] == got[2] == [] and [(h.from_, h.by, h.with_, h.micros, h.delay) for h in got[3]] == [("a", "b", "SMTP", 1577836800000000, None)]


def test_parts_keep_to_their_size_and_read_back(spark, tmp_path):
    rows = [(i, "a@b", f"Subject: s{i}\n\n" + "From x\n" * (i % 7) + "y" * (i * 13 % 300)) for i in range(60)] + [(99, "a@b", "Subject: big\n\n" + "z" * 5000)]
    df = spark.createDataFrame(rows, "id int, sender string, raw string").withColumn("ts", F.lit(None).cast("timestamp"))
    exports.write_mbox_parts(df.repartition(3), str(tmp_path / "out"), 1000, ["id"], raw="raw")
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".txt")]
    found = mbox_scan.scan_mbox(spark, str(tmp_path / "out")).collect()
    assert sorted(mbox_scan.unquoted(bytes(r.content)).rstrip(b"\n") for r in found) == sorted(t.encode().rstrip(b"\n") for _, _, t in rows)
    sizes = sorted(os.path.getsize(f) for f in files)
    assert sizes[-1] > 5000 and sizes[-2] <= 1000 and len(files) > 10


def test_sessions_and_joint_hours(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("a", at(m)) for m in (0, 10, 39, 70, 200)] + [("b", at(m)) for m in (1, 2, 3)] + [("c", at(5)), (None, at(1)), ("d", None)]
    df = spark.createDataFrame(rows, "who string, ts timestamp_ntz")
    got = sorted((r.who, r.since, r.until, r.n) for r in signals.sessions(df, "who", "ts").collect())
    assert got == [("a", at(0), at(39), 3), ("a", at(70), at(70), 1), ("a", at(200), at(200), 1), ("b", at(1), at(3), 3), ("c", at(5), at(5), 1)]
    assert [tuple(r) for r in signals.coordinated(df, "who", "ts").collect()] == [(at(0), 2, 6)]
