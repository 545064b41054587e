"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, label): label is the smallest node of the component; only nodes that have an edge.

    The number of rounds grows with the logarithm of the longest chain.  A node with very many neighbours is met by
    pre-aggregated minima and a join, whose crowded partitions adaptive execution splits; each round is written to the
    shared folder, so lineage stays short.  A round has no more rows than the one before.  Self-loops and repeated edges
    are allowed; an empty table gives no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    seen = None
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")).repartition("v")
        large = now.join(least, "v").select("u", F.col("m").alias("v")).where("u != v").repartition("u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(small, "components")
        if seen is not None:
            discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
