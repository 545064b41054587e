from archivum.sources import exports, mailbox
from archivum.streaming import capture

ONE = b"From: Ann <ann@north.example>\r\nTo: bob@south.example\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\n\r\nhello\r\n"
TWO = b'From: bob@south.example\nSubject: files\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nsee file\n--b\nContent-Type: text/csv\nContent-Disposition: attachment; filename="a.csv"\n\n1,2\n--b--\n'


def test_mail_files(spark, tmp_path):
    (tmp_path / "in" / "cur").mkdir(parents=True)
    (tmp_path / "in" / "one.eml").write_bytes(ONE)
    (tmp_path / "in" / "two.emlx").write_bytes(str(len(TWO)).encode() + b"\n" + TWO + b"<plist/>")
    (tmp_path / "in" / "cur" / "77").write_bytes(ONE)
    (tmp_path / "in" / "empty.eml").write_bytes(b"")
    (tmp_path / "in" / "a.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "in" / "all.mbox").write_bytes(b"From a@b Mon Jan  1 10:00:00 2024\n" + ONE + b"\nFrom me to you\n\nFrom a@b Mon Jan  1 10:00:00 2024\n" + TWO + b"From a@b Mon Jan  1 10:00:00 2024\n\n")
    rows = {(r.path.rsplit("/", 1)[1], r.ordinal): r for r in mailbox.read_mail(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {("one.eml", 0), ("two.emlx", 0), ("77", 0), ("all.mbox", 0), ("all.mbox", 1)}
    assert rows["one.eml", 0].subject == "café" and rows["one.eml", 0].plain_body.strip() == "hello"
    assert "From me to you" in rows["all.mbox", 0].plain_body
    assert [tuple(a) for a in rows["two.emlx", 0].attachments] == [("a.csv", "text/csv", 3)]
    assert rows["two.emlx", 0].ts is None and not any(r.error for r in rows.values())


def test_mbox_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a@b", None, "Subject: x\n\nFrom here\n>From there\n"), (None, None, None)], "sender string, ts timestamp_ntz, raw_source string")
    exports.write_mbox(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert ">From here" in text and ">>From there" in text and len(list(mailbox.split_mbox(text.encode()))) == 1


def test_fingerprint_ignores_order(spark):
    a = spark.range(100)
    assert exports.set_fingerprint(a, "id").first() == exports.set_fingerprint(a.orderBy("id", ascending=False), "id").first()
    assert exports.set_fingerprint(a.where("false"), "id").first().n == 0


def test_capture_stores_each_row_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "id int, seen int, v string")
    rows.write.parquet(source)
    for _ in range(2):
        capture.store(capture.replay(spark, source, rows.schema), out, state).awaitTermination()
    stored = spark.read.parquet(out).select("id", "seen", "v")
    assert sorted(map(tuple, stored.collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")]
    gone = spark.createDataFrame([(3,)], "id int")
    assert sorted(map(tuple, capture.current(stored, "id", "seen", gone).collect())) == [(1, 2, "b"), (2, 1, "c")]
    assert [r.id for r in capture.missing(rows.select("id").distinct(), stored.where("id < 3"), "id").collect()] == [3]


def test_exports_round_trip(spark, tmp_path):
    import json

    from archivum.sources import exports

    rows = [(1, 'say "hi", now', None), (2, "two\nlines", "é"), (3, "", "plain")]
    df = spark.createDataFrame(rows, "id int, subject string, note string")
    exports.write_csv(df, f"{tmp_path}/csv", ["id", "subject"])
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv")
    assert sorted((int(r.id), r.subject or "") for r in back.collect()) == [(i, t) for i, t, _ in rows]
    exports.write_json(df, f"{tmp_path}/json")
    lines = [json.loads(line) for f in tmp_path.glob("json/part-*") for line in f.read_text().splitlines()]
    assert sorted((x["id"], x["subject"], x["note"]) for x in lines) == rows


def test_number_of_check_digits_and_luhn(spark):
    from pyspark.sql import functions as F

    from archivum.functions import mail

    rows = [("4111111111111111", True), ("4111111111111112", False), ("5500000000000004", True)]
    got = spark.createDataFrame(rows, "card string, ok boolean").select(mail.luhn(F.col("card")).alias("x"), "ok").collect()
    assert all(r.x == r.ok for r in got)
