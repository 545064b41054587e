"""Incremental capture with Structured Streaming: each batch stored once, current state, tombstones, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files below ``path``: existing ones first, then new ones."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def store(stream: DataFrame, path: str, checkpoint: str):
    """Write each batch to its own folder, named by its number: a repeated batch replaces itself, so rows are stored once.

    Runs over what is there and ends; a later call goes on after the last finished batch.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(captured: DataFrame, key: str, seen: str, tombstones: DataFrame | None = None) -> DataFrame:
    """The latest row of each key by (``seen``, all columns); keys in ``tombstones`` stay deleted.

    ``max_by`` combines before the shuffle, so a key with very many versions needs no large group.
    """
    row = F.struct(*[F.col(c) for c in captured.columns])
    out = captured.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(F.col(seen), *[F.col(c) for c in captured.columns if c not in (key, seen)])).alias("_row")).select("_row.*")
    return out if tombstones is None else out.join(tombstones.select(key), key, "left_anti")


def missing(snapshot: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What a full listing has and the store doesn't: after an expired cursor, only this is fetched."""
    return snapshot.join(stored.select(key).distinct(), key, "left_anti")


def stale(rows: DataFrame, derived: DataFrame, key: str, version: Column) -> DataFrame:
    """Rows without a derived record of this version: the work of an incremental run."""
    return rows.join(derived.where(F.col("version") == version).select(key), key, "left_anti")


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str, late: str | None = None) -> DataFrame:
    """Rows of each (window, key).  Without ``late`` a late row still counts in its own window; with it, state is bounded."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark(ts, late)
    found = timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregate over what is there; the table holds its whole result after each batch."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)
