"""WARC archives whose repeated payloads are revisit records.

Headers are shuffled by payload digest to find the original of each payload; every record then gets fresh
headers, as response or revisit, and is written. An archive holds whole records up to a number of bytes, a gzip
member each, so that a reader can seek to a record. Archives go through Spark's committed writer, so any shared store
will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from textguard.llm.base import join_groups, small_batches, spread_rows
from textguard.scratch import stage

CRLF = "\r\n"
#: Bytes of an archive at most, as it lies on disk; a record is never cut, so that a longer one is an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes handed to the decompressor at once; what it leaves of them is copied at the end of each member.
_WINDOW = 1 << 14
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes: five hex digits give four base32 digits."""
    sha1 = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, ``record_type``, ``refers_to``, ``payload_digest``, ``payload_bytes``) of every row.

    Only headers are shuffled; those of the few payloads with very many copies stay where they are. Of records with equal digest and length of at least ``min_bytes``, that with the
    smallest id is the response (null ids count as larger than any other); the others revisit it.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    headers = pages.select(
        F.col(id_col),
        payload_digest(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    )
    same = F.concat_ws(":", "payload_digest", "payload_bytes")
    headers = stage(headers.withColumn("_same", same), "warc-headers")
    originals = stage(headers.groupBy("_same").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_copies")), "warc-originals")
    is_copy = (F.col("payload_bytes") >= min_bytes) & ~F.col(id_col).eqNullSafe(F.col("_first"))
    refers = F.when(is_copy, F.col("_first"))
    return join_groups(headers, originals, "_same", "_copies").select(
        id_col,
        F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
        refers.alias("refers_to"),
        "payload_digest",
        "payload_bytes",
    )


def _record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), number.cast("string"), F.lit(">"))


def _member(content: bytes) -> bytes:
    """``content`` as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


#: An archive ends with a member without content; the text writer sets it as the end of its only line.
_END = _member(b"")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a WARC record for every row, revisits without their payload, in files of at most ``archive_bytes``.

    Null payloads are empty. Line ends in an address would end its header, so they are written percent-encoded;
    a null address or id is left out of its record. Rows that repeat an id and payload each get a record of the same
    type. Records without any id to refer to stay responses. An empty table gives archives without records; further
    columns are not read. A payload of any length is one record, and alone in its archive where it is longer than that.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = bytearray()
        for b in batches:
            for record in b.column(0):
                member = _member(record.as_py())
                if archive and len(archive) + len(member) + len(_END) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(archive)], pa.binary())], ["value"])
                    archive.clear()
                archive += member
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(archive)], pa.binary())], ["value"])

    small_batches(pages.sparkSession)
    decided = resolve_revisits(pages, id_col, payload_col, min_bytes)
    decided = decided.groupBy(id_col, "payload_digest", "payload_bytes").agg(F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"))
    decided = stage(decided, "warc-decided")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = spread_rows(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload")))
    same = F.col("_id").eqNullSafe(F.col(id_col)) & (payload_digest(F.col("_payload")) == F.col("payload_digest"))
    joined = rows.join(decided, same)
    is_response = F.col("record_type") == "response"
    body = F.when(is_response, F.col("_payload")).otherwise("")
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")

    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", _record_id(F.col("_id"))),
        header("WARC-Target-URI", url),
        header("WARC-Date", F.lit(date)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", _record_id(F.col("refers_to"))),
        header("WARC-Profile", F.when(~is_response, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
        F.lit(CRLF + CRLF),
    )
    archives = joined.select(record.cast("binary").alias("value")).mapInArrow(pack, "value binary")
    # One row a file, its bytes written as they are.
    writer = archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).text(path)


_FIELDS = ["record_type", "record_id", "url", "payload_digest", "refers_to", "payload"]


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of one archive."""
    buffer, ended = bytearray(), False

    def fill(need: int) -> bool:
        nonlocal ended
        while len(buffer) < need and not ended:
            part = next(chunks, None)
            if part is None:
                ended = True
            else:
                buffer.extend(part)
        return len(buffer) >= need

    while fill(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("archive ends inside a header")
        lines = bytes(buffer[:end]).decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("archive ends inside a record")
        body = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]
        yield headers, body


def _unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, piece by piece."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            part = view[at : at + _WINDOW]
            content = unzip.decompress(part, step)
            if not part and not content:
                raise ValueError("archive ends inside a gzip member")
            at += len(part) - len(unzip.unconsumed_tail) - len(unzip.unused_data)
            yield content


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder: ``record_type``, ``record_id``, ``url``, ``payload_digest``,
    ``refers_to`` (as in its headers; null where absent) and ``payload`` as bytes.

    Records come as often and in the form in which they were written, empty payloads as empty bytes; a record of any length is
    held whole, an archive is read piece by piece. Archives without records give no rows; a cut one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To"]
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for headers, body in _parse(_unpacked(content.as_py())):
                    rows.append([*map(headers.get, names), body])
                    size += len(body) + 200
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    kinds = [StructField(n, StringType()) for n in _FIELDS[:-1]] + [StructField("payload", BinaryType())]
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, StructType(kinds))


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _FIELDS)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: ``page_id``, ``payload_bytes`` and ``payload_digest`` of the full payload,
    ``record_type``, ``refers_to``. A response's figures are computed from the payload that was read; a revisit takes
    its original's by a join on the record it refers to. A record without an id has a null ``page_id``; repeated records are
    rows of their own; a revisit whose original is not there has null figures; archives without records give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column(5).to_pylist()
            digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            computed = [pa.array([len(p) for p in payloads], pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 3, 4)), *computed], [n for n, _ in kinds])

    kinds = [(n, StringType()) for n in ("record_type", "record_id", "declared", "refers")] + [("n", LongType()), ("digest", StringType())]
    records = read_archives(spark, path).mapInArrow(run, StructType([StructField(*k) for k in kinds]))
    records = stage(records, "warc-read")

    def number(column: str) -> Column:
        return F.regexp_extract(column, "^<urn:page:(.*)>$", 1).try_cast("bigint")

    is_response = F.col("record_type") == "response"
    declared = F.concat(F.lit("sha1:"), F.col("digest")).alias("declared")
    responses = records.filter(is_response)
    originals = responses.groupBy(F.col("record_id").alias("refers"), F.concat(F.lit("sha1:"), "digest").alias("declared"))
    originals = originals.agg(F.first("n").alias("_n"), F.first("digest").alias("_digest"))
    # Written, so that the engine can divide the revisits of a payload that is everywhere.
    revisits = records.filter(~is_response).drop("n", "digest").join(stage(originals, "warc-read-originals"), ["refers", "declared"], "left")
    revisits = revisits.withColumnsRenamed({"_n": "n", "_digest": "digest"})
    return responses.unionByName(revisits).select(
        number("record_id").alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        number("refers").alias("refers_to"),
    )
