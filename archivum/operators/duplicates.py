"""Exact duplicates by several keys, the stronger first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import materialize


def tiers(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """(tier, key, row) of the members of duplicate groups; ``keys``: name of a tier and its key, the strongest first.

    A group is two rows or more with one key (null and empty keys group nothing).  A group of a weaker tier that has a
    member in a group already is left out as a whole, so a row is in one group at most.  A very common key is combined
    before the shuffle; its rows are marked by a join that can be split.
    """
    held = df.select(F.col(row).alias("row"), *(F.when(k != "", k).alias(n) for n, k in keys.items()))
    out: DataFrame | None = None
    for name in keys:
        one = held.select("row", F.col(name).alias("key")).where("key is not null")
        if out is not None:
            one = one.join(out.select("row", F.lit(1).alias("taken")), "row", "left")
        else:
            one = one.withColumn("taken", F.lit(None).cast("int"))
        groups = one.groupBy("key").agg(F.count("*").alias("n"), F.max("taken").alias("taken")).where("n > 1 and taken is null").select("key")
        found = one.join(groups, "key").select(F.lit(name).alias("tier"), "key", "row")
        out = materialize(found if out is None else out.unionByName(found))
    return out.withColumnRenamed("row", row)
