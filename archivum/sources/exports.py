"""Export formats: message summaries, mbox records, load files and receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import checkpoint

#: Separator and quote of load files: fixed values of the format.
SEPARATOR, QUOTE = "\u0014", "þ"


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Quoted CSV with a header; quotes inside fields are doubled."""
    df.select(*(columns or df.columns)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are kept."""
    df.write.option("ignoreNullFields", False).json(path)


def mbox_record(sender: Column, ts: Column, raw: Column) -> Column:
    """A message as mbox text: envelope line, lines that begin with ``From `` quoted, a blank line after it."""
    who = F.coalesce(sender, F.lit("MAILER-DAEMON"))
    when = F.coalesce(F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy"), F.lit("Thu Jan 01 00:00:00 1970"))
    return F.concat(F.lit("From "), who, F.lit(" "), when, F.lit("\n"), F.regexp_replace(F.coalesce(raw, F.lit("")), "(?m)^(>*From )", ">$1"), F.lit("\n"))


def write_mbox(df: DataFrame, path: str, sender: str = "sender", ts: str = "ts", raw: str = "raw_source") -> None:
    """mbox files, one for each partition of ``df``."""
    df.select(mbox_record(F.col(sender), F.col(ts), F.col(raw)).alias("value")).write.text(path)


def write_mbox_parts(df: DataFrame, path: str, most: int, order: list[str], sender: str = "sender", ts: str = "ts", raw: str = "raw_source") -> None:
    """mbox files of at most ``most`` bytes each, by ``order``, below folders ``part=<range>-<number>``.

    Rows are dealt out by ranges of ``order`` and written to the shared folder, so that a task that is run again cuts the
    same parts; a range's messages fill one part after the other.  A message larger than ``most`` is a part by itself.  The
    writer commits a task's files at its end, so a failed task leaves none.
    """
    record = mbox_record(F.col(sender), F.col(ts), F.col(raw))
    ranged = checkpoint(df.select(*order, record.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for batch in batches:
            parts = []
            for where, size in zip(batch.column("range").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if held and held + size > most:
                    number, held = number + 1, 0
                held += size
                parts.append(f"{where:06d}-{number:06d}")
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(parts, pa.string())], ["value", "part"])

    sized = ranged.select("range", "value", (F.octet_length("value").cast("long") + 1).alias("size"))
    sized.mapInArrow(cut, "value string, part string").write.partitionBy("part").text(path)


def load_file_line(*columns: Column) -> Column:
    """A line of a load file: every field quoted; line breaks inside fields become the registered mark; null is empty."""
    fields = [F.concat(F.lit(QUOTE), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r\n|\r|\n", "®"), F.lit(QUOTE)) for c in columns]
    return F.concat_ws(SEPARATOR, *fields)


def write_load_file(df: DataFrame, path: str) -> None:
    """All columns in order; the names go into ``_header`` beside the rows' files, since rows are written by many tasks."""
    df.select(load_file_line(*[F.col(c) for c in df.columns]).alias("value")).write.text(f"{path}/rows")
    head = df.sparkSession.range(1).select(load_file_line(*[F.lit(c) for c in df.columns]).alias("value"))
    head.write.text(f"{path}/_header")


def set_fingerprint(df: DataFrame, id_: str) -> DataFrame:
    """Count and four wrapping 64-bit sums of the lanes of SHA-256 of the ids: the same for every order of rows.

    Sums are exact decimals, so partial sums combine in any order; 38 digits hold 10^18 rows.
    """
    sha = F.sha2(F.col(id_).cast("string").cast("binary"), 256)
    lanes = df.select(*[F.conv(F.substring(sha, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").alias(f"lane_{i}") for i in range(4)])
    total = lambda c: F.pmod(F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("string")
    return lanes.agg(F.count("*").alias("n"), *[total(f"lane_{i}").alias(f"lane_{i}") for i in range(4)])
