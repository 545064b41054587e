"""Small helpers that every corpus operator shares: tables, materialised results, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have before it is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a temporary one serves a local session; on a cluster that is an error, as no other machine sees it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='archivum-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's setting by which the files of a query's shuffles go when it ends, not at some later garbage collection.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``free``: the shuffles of ``df`` are deleted as soon as it is written; for a ``df`` that nothing else reads.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FREE, None)
    if free:
        conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.unset(FREE) if before is None else conf.set(FREE, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def semi_join(big: DataFrame, ids: DataFrame, key: str | list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids`` (distinct); ``ids`` is broadcast only if it has few rows."""
    few = ids.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(ids) if few else ids, key, "left_semi")


def training_row(doc_id: str = "doc_id", held_out: int = 0):
    """True where crc32 of the id as text, mod 5, isn't ``held_out`` (rows without an id count as training rows)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != held_out, F.lit(True))


def anti_join(big: DataFrame, ids: DataFrame, key: str | list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``big`` whose ``key`` isn't in ``ids``; as ``semi_join``."""
    few = ids.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(ids) if few else ids, key, "left_anti")
