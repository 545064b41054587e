"""Mail files as DataFrames: format by first bytes, single messages, mbox files and folders of messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "path string, folder string, ordinal long, message_id string, in_reply_to string, references string, sender string, recipient string, cc string, subject string, ts timestamp, plain_body string, html_body string, attachments array<struct<filename: string, mime: string, size: long>>, error string"
_TEXTS = ["message_id", "in_reply_to", "references", "sender", "recipient", "cc", "subject"]
_FILE = pa.struct([("filename", pa.string()), ("mime", pa.string()), ("size", pa.int64())])
_SCHEMA = pa.schema([("path", pa.string()), ("folder", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in _TEXTS), ("ts", pa.timestamp("us", "UTC")), ("plain_body", pa.string()), ("html_body", pa.string()), ("attachments", pa.list_(_FILE)), ("error", pa.string())])
_ENVELOPE = re.compile(rb"^From .+\d{4}\r?$", re.M)

#: First bytes of formats (hexadecimal): fixed values of the formats themselves.
MAGIC = {"zip": "504B0304", "gzip": "1F8B", "7z": "377ABCAF271C", "rar": "526172211A07", "pst": "2142444E", "msg": "D0CF11E0A1B11AE1"}


def source_format(path: Column, content: Column) -> Column:
    """The format of a file by its first bytes, else by its name; ``unknown`` for anything else, null and empty files."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.coalesce(out, F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, name))
    out = F.coalesce(out, F.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar"))
    out = F.coalesce(out, F.when(F.hex(F.substring(content, 1, 5)) == "46726F6D20", "mbox"))
    for ending in ("emlx", "eml", "mbox"):
        out = F.coalesce(out, F.when((F.octet_length(content) > 0) & F.lower(path).endswith("." + ending), ending))
    return F.coalesce(out, F.lit("unknown"))


def _text(part) -> str:
    try:
        return part.get_content()
    except (LookupError, ValueError):  # an unknown character set
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def read_message(raw: bytes) -> dict:
    """The fields of one RFC 822 message; what can't be read is null."""
    m = message_from_bytes(raw, policy=policy.default)
    field = lambda k: None if m[k] is None else str(m[k])
    try:
        ts = parsedate_to_datetime(str(m["Date"])) if m["Date"] else None
        ts = ts.replace(tzinfo=UTC) if ts is not None and ts.tzinfo is None else ts  # no zone: UTC
    except ValueError:
        ts = None
    out = {"message_id": field("Message-ID"), "in_reply_to": field("In-Reply-To"), "references": field("References"), "sender": field("From"), "recipient": field("To"), "cc": field("Cc"), "subject": field("Subject"), "ts": ts, "plain_body": None, "html_body": None, "attachments": []}
    for part in m.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        if part.get_filename() or part.get_content_disposition() == "attachment":
            out["attachments"].append({"filename": part.get_filename(), "mime": kind, "size": len(part.get_payload(decode=True) or b"")})
        elif kind == "text/plain" and out["plain_body"] is None:
            out["plain_body"] = _text(part)
        elif kind == "text/html" and out["html_body"] is None:
            out["html_body"] = _text(part)
    return out


def split_mbox(data: bytes) -> Iterator[bytes]:
    """The messages of an mbox file in order, without their envelope lines; blank parts are dropped."""
    starts = list(_ENVELOPE.finditer(data))
    for at, after in zip(starts, [*starts[1:], None][: len(starts)], strict=True):
        part = data[at.end() : after.start() if after else len(data)].lstrip(b"\r\n")
        if part.strip():
            yield part


def _parts(kind: str, data: bytes) -> Iterator[bytes]:
    if kind == "mbox":
        yield from split_mbox(data)
    elif kind == "emlx":  # a line with the length in bytes stands before the message
        size, _, rest = data.partition(b"\n")
        yield rest[: int(size)] if size.strip().isdigit() else data
    elif data.strip():
        yield data


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    for batch in batches:
        rows = []
        for path, kind, data in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "content")), strict=True):
            for n, raw in enumerate(_parts(kind, data or b"")):
                row = {"path": path, "folder": path.rsplit("/", 1)[0], "ordinal": n, "error": None}
                try:
                    row |= read_message(raw)
                except Exception as e:  # a damaged message becomes a row with its error, and the file goes on
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
                if len(rows) >= 256:
                    yield out(rows)
                    rows = []
        yield out(rows)


def read_mail(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All messages below a folder, from .eml, .emlx, Maildir and mbox files: one row a message, in (path, ordinal) order.

    A file is one unit of work and may have up to 2 GB, the limit of the binary source; archives and other formats give no
    rows (``source_format`` names them).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    kind = source_format(F.col("path"), F.col("content"))
    maildir = F.col("path").rlike(r"/(cur|new)/[^/]+$")
    known = files.select("path", F.when((kind == "unknown") & maildir, "eml").otherwise(kind).alias("kind"), "content")
    return known.where(F.col("kind").isin("eml", "emlx", "mbox")).mapInArrow(_messages, MESSAGE)
