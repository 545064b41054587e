import datetime

from pyspark.sql import functions as F

from archivum.operators import search as se


def test_grammar_keeps_every_line_valid():
    q = se.parse('from:bob from:"alice b" "not guilty" -spam report OR memo unknown:key before:2024-01-02 before:soon -to:x NOT tag:t NOT word sort:largest is:odd')
    assert q.fields == {"sender": "alice b", "before": "2024-01-02"}
    assert q.excluded == [("recipient", "x"), ("tag", "t")]
    assert q.text == '"not guilty" -spam report OR memo unknown:key before:soon NOT word is:odd'
    assert q.order == "size"
    assert se.parse('broken "quote').text == 'broken "quote'
    assert se.parse("-no:attachments").text == "-no:attachments"


def test_boolean_text(spark):
    rows = ["alpha", "alpha beta", "beta gamma", "gamma", "alphabet soup", "spam ham", "guilty not", "alpha spam", "alpha-beta"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")

    def found(line):
        return [r.t for r in df.where(se.text_condition(F.col("t"), line)).collect()]

    assert found("alpha AND beta OR gamma") == ["alpha beta", "beta gamma", "gamma", "alpha-beta"]
    assert found("gamma OR alpha AND beta") == ["alpha beta", "beta gamma", "gamma", "alpha-beta"]
    assert found("alph") == ["alpha", "alpha beta", "alphabet soup", "alpha spam", "alpha-beta"]
    assert found("alpha spa") == ["alpha spam"] and found("alph spam") == []
    assert found("-spam") == ["spam ham", "alpha spam"]
    assert found("alpha -spam") == ["alpha", "alpha beta", "alphabet soup", "alpha-beta"]
    assert found("alpha AND NOT spam") == found("alpha NOT spam") == ["alpha", "alpha beta", "alpha-beta"]
    assert found("not guilty") == ["guilty not"] and found("NOT guilty") == ["guilty not"]
    assert found("alpha-beta") == ["alpha beta", "alpha-beta"]


def test_dates():
    assert se.read_date("01/31/2024") == se.read_date("2024/01/31") == datetime.date(2024, 1, 31)
    assert se.read_date("31.1.2024") is None


def test_missing_text_is_no_evidence(spark):
    df = spark.createDataFrame([(1, "secret", True), (2, "plain", True), (3, None, False)], "id int, body string, ready boolean")
    without = [se.Group("exclude", [[se.Condition(F.col("body").contains("secret"), reads_text=True)]])]
    yes, unresolved = se.confirm(df, without, F.col("ready"))
    assert [r.id for r in yes.collect()] == [2]
    assert [r.id for r in unresolved.collect()] == [3]
    plain = [se.Group("all", [[se.Condition(F.col("body").contains("secret"), reads_text=True)]])]
    yes, unresolved = se.confirm(df, plain, F.col("ready"))
    assert [r.id for r in yes.collect()] == [1]
    assert unresolved.count() == 0
