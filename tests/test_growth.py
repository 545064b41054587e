import os

import pytest
from pyspark.sql import functions as F

from archivum.functions import stamps
from archivum.operators import paths
from archivum.operators import review as rv
from archivum.plans import registry

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_received_fields_are_read_once(spark):
    hops = spark.createDataFrame([("x",)], "x string").select(stamps.received_hops(F.col("x")).alias("h"))
    assert hops._jdf.queryExecution().analyzed().toString().count("bwith") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_hops_read_edges_without_adding_them_up(spark, monkeypatch):
    want = {(r["node"], r["distance"]) for r in rv.hops(rv.edges(registry._lines(spark, DATA), "c", "s"), spark.sql("select 'c1' as node"), 2).collect()}
    monkeypatch.setattr(rv, "edges", None)
    assert {tuple(r) for r in registry.queries()["t26_hops"](spark, DATA).select("node", "distance").collect()} == want


def test_hops_of_repeated_edges(spark):
    graph = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("b", "b"), ("c", "d")], "a string, b string")
    assert sorted(map(tuple, rv.hops(graph, spark.sql("select 'a' as node"), 2).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert rv.hops(graph, spark.sql("select 'z' as node"), 2).count() == 1


def test_graphs_are_compared_without_a_join(spark):
    old = spark.createDataFrame([("a", "b", 5), (None, "b", 1), ("z", "b", None)], "a string, b string, weight long")
    new = spark.createDataFrame([("a", "b", 9), (None, "b", 7)], "a string, b string, weight long")
    found = paths.compare_graphs(old, new)
    assert "Join" not in _plan(found)
    assert sorted(map(str, map(tuple, found.collect()))) == ["('a', 'b', 5, 9, 'stronger')", "(None, 'b', 1, None, 'lost')", "(None, 'b', None, 7, 'new')"]


def test_nodes_are_compared_without_a_join(spark):
    old = spark.createDataFrame([("a", "b", 5), (None, "b", 1)], "a string, b string, weight long")
    new = spark.createDataFrame([("c", "b", 9), (None, "b", 7)], "a string, b string, weight long")
    found = paths.compare_nodes(old, new)
    assert "Join" not in _plan(found)
    assert sorted(map(str, map(tuple, found.collect()))) == ["('a', 5, 'lost')", "('c', 9, 'new')", "(None, 1, 'lost')", "(None, 7, 'new')"]
