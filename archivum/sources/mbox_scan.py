"""Offset scan of mbox files of any size: the messages of each byte range of a file, with their places.

Spark's text source deals the bytes of a file out to tasks at line ends, wherever the file system keeps it.  A task cuts
its lines at envelope lines, so a message that lies in one range is whole there.  What a range holds of a message that
begins before it, or goes on after it, is joined to the rest by the number of the message: the messages of all earlier
ranges (a sum over ranges, not over messages) and its place in its own.  No file is read by one task, and a message
larger than ``ceiling`` is given by its headers and its place alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivum.operators.durable import materialize
from archivum.sources.mailbox import _SCHEMA, MESSAGE, read_message

#: Messages up to this size are given whole; larger ones by their headers and place.
CEILING = 100 << 20
#: Bytes of a message that are held before they are passed on.
PIECE = 1 << 20
_ENVELOPE = re.compile(rb"From .+\d{4}\r?")
_HEADERS_END = re.compile(rb"\r?\n\r?\n")

PIECES = "path string, block long, file_size long, nth long, place long, size long, opened boolean, closed boolean, blank boolean, content binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each range at envelope lines.

    ``nth``: how many messages have begun in the range, 0 before the first; ``place``: where the piece begins in the range;
    ``opened``: the message begins with this piece; ``closed``: it ends with it, since another begins after it; ``blank``:
    white space only, but for the envelope line.
    """
    names = ["path", "block", "file_size", "nth", "place", "size", "opened", "closed", "blank", "content"]
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.bool_()] * 3, pa.binary()]
    rows: list[tuple] = []
    held, key, nth, begin, at, lines, opened = 0, None, 0, 0, 0, [], False

    def flush(closed: bool) -> None:
        nonlocal lines, begin, held, opened
        if lines or closed:
            content = b"".join(lines)
            rows.append((*key, nth, begin, at - begin, opened, closed, not b"".join(lines[opened:]).strip(), content))
            held += len(content)
        lines, begin, opened = [], at, False

    since = 0
    for batch in batches:
        for *place, value in zip(*[batch.column(c).to_pylist() for c in ("path", "block", "file_size")], batch.column("value"), strict=True):
            if key is None or place[:2] != key[:2]:
                if key is not None:
                    flush(False)
                key, nth, begin, at, since = place, 0, 0, 0, 0
            line = value.as_py() + b"\n"
            if line.startswith(b"From ") and _ENVELOPE.fullmatch(line, 0, len(line) - 1):
                flush(True)
                nth, since, opened = nth + 1, 0, True
            elif since > PIECE:
                flush(False)
                since = 0
            lines.append(line)
            at += len(line)
            since += len(line)
        if held > 8 * PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, held = [], 0
    if key is not None:
        flush(False)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def scan_mbox(spark: SparkSession, path: str, ceiling: int = CEILING) -> DataFrame:
    """path, ordinal, start, length, whole, content of every message of the mbox files below ``path``.

    ``ordinal`` counts a file's envelope lines from 0, ``start`` and ``length`` are bytes of the file from the envelope line
    on; ``content`` is the message after its envelope line and the line ends that follow.  A message of more than ``ceiling``
    bytes has its headers as content (as far as PIECE bytes hold them) and ``whole`` is false.  What stands before the first
    envelope line and messages of white space are left out (the latter keep their number).  Empty files give no rows.
    Bytes are taken as they are, of any encoding; a file that is not compressed is read in ranges of
    spark.sql.files.maxPartitionBytes, a compressed one by one task.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))
    pieces = materialize(lines.mapInArrow(_pieces, PIECES), "mbox-pieces")
    ranges = pieces.groupBy("path", "block").agg(F.sum("size").alias("bytes"), F.max("nth").alias("begun"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "begun")]
    placed = pieces.join(materialize(ranges.select("path", "block", *before), "mbox-ranges"), ["path", "block"])
    start = F.col("bytes_before") + F.col("place")
    over = start + F.col("size") - F.col("file_size")  # a last line without its end got one
    content = F.when(over > 0, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content"))
    placed = placed.select("path", (F.col("begun_before") + F.col("nth") - 1).alias("ordinal"), start.alias("start"), (F.col("size") - F.greatest(over, F.lit(0))).alias("length"), "opened", "closed", "blank", content.alias("content")).where("ordinal >= 0")

    # a message that begins and ends within a range, in one piece, is whole as it is and isn't shuffled
    alone = placed.where("opened and closed").select("path", "ordinal", "start", "length", "blank", (F.col("length") <= ceiling).alias("whole"), F.array(F.struct("start", "content")).alias("parts"))
    rest = placed.where("not (opened and closed)")
    sums = rest.groupBy("path", "ordinal").agg(F.min("start").alias("first"), F.sum("length").alias("total"), F.min("blank").alias("blank"))
    # of a message above the ceiling only its first piece is brought together with its place
    needed = rest.select("path", "ordinal", "start", "content").join(sums, ["path", "ordinal"]).where((F.col("total") <= ceiling) | (F.col("start") == F.col("first")))
    joined = needed.groupBy("path", "ordinal").agg(F.first("first").alias("start"), F.first("total").alias("length"), F.first("blank").alias("blank"), F.sort_array(F.collect_list(F.struct("start", "content"))).alias("parts"))
    every = alone.unionByName(joined.withColumn("whole", F.col("length") <= ceiling))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("path", "ordinal", "start", "length", "whole")], batch.column("parts"), strict=True):
                raw = b"".join(p["content"] for p in row[5].as_py())
                _, _, message = raw.partition(b"\n")  # the envelope line
                message = message.lstrip(b"\r\n")
                if not row[4]:
                    end = _HEADERS_END.search(message)
                    message = message[: end.start()] if end else message[:PIECE]
                if message.strip():
                    out.append((*row[:5], message))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["path", "ordinal", "start", "length", "whole", "content"])

    return every.where(~F.col("blank")).select("path", "ordinal", "start", "length", "whole", "parts").mapInArrow(finish, "path string, ordinal long, start long, length long, whole boolean, content binary")


def scanned_messages(scanned: DataFrame) -> DataFrame:
    """The fields of each scanned message, as ``read_mail`` gives them; of one above the ceiling, those of its headers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ordinal, content in zip(*[batch.column(c).to_pylist() for c in ("path", "ordinal", "content")], strict=True):
                row = {"path": path, "folder": path.rsplit("/", 1)[0], "ordinal": ordinal, "error": None}
                try:
                    row |= read_message(content)
                except Exception as e:  # a damaged message becomes a row with its error, and the file goes on
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return scanned.mapInArrow(parse, MESSAGE)


def unquoted(content: bytes) -> bytes:
    """A message whose quoted ``From`` lines (mboxrd) have lost one mark each."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", content)
