"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_monolithic`` stores one record per page with Spark's text writer: each
file is a single gzip stream over all its records, as some crawlers leave them.
``normalise`` inflates each such stream once, in chunks, rewrites every record
as a gzip member of its own and writes a sidecar index of offsets beside the
archive.  ``read_records`` opens members by offset, so a reader never inflates
more than it asks for.

A payload seen more than once is stored once: of the pages with equal payloads
of at least ``min_bytes`` bytes the one with the largest page_id is the
``response``, the others are ``revisit`` records that hold the HTTP head only
and refer to it.  Equal payloads are found by an aggregate over their digests,
whose result holds one row per repeated payload and is stored before the join,
so the planner broadcasts it only if its size is below the session's threshold
and otherwise joins by shuffle with AQE's skew handling.

Files lie below ``spark.checkpoint.dir`` and are opened by their URI, so any
store that Spark and pyarrow both reach will do.  A task writes to a name of its
own and moves the finished file into place; a repeated task leaves the same
bytes, so lost executors and speculative copies do no harm.  Memory per task is
one chunk plus one HTTP head, whatever the file's or record's size; reading a
record back holds that record.

Defined cases: a null html is the empty payload; a null url gives a record
without target; control characters in urls are percent-encoded in the header;
rows that repeat the response's page_id and payload are responses too; a null
page_id never is the largest unless all are null; an empty table gives archives
without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import settle, shared_dir

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
LEVEL = 1
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_INDEX = "file string, offset bigint, length bigint, record_type string, record_id string"
_RECORD = """page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint,
             url string, payload binary"""


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits give four letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def with_record_type(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    repeated = settle(
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("_d"))
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_d", "_last")
    )
    again = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return base.join(repeated, F.col("payload_digest") == F.col("_d"), "left").select(
        *base.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_last")).alias("refers_to"),
    )


def record_text(record: DataFrame) -> Column:
    """One record without the blank lines that end it."""
    is_revisit = F.col("record_type") == "revisit"
    length = F.col("payload_bytes").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n")
    )
    block_bytes = F.length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(
            is_revisit,
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string")),
    ]
    head = F.concat_ws("\r\n", *lines)  # leaves nulls out
    return F.concat(head, F.lit("\r\n\r\n"), http, F.when(is_revisit, "").otherwise(F.col("payload")))


def write_monolithic(records: DataFrame, folder: str) -> None:
    """One gzip stream per file; a record ends with two line breaks, which the writer adds."""
    (
        records.select(record_text(records).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(folder)
    )


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, in bounded pieces."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            yield inflater.decompress(data, chunk)
            data = inflater.unconsumed_tail
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(31)
    yield inflater.flush()


def rewrite(parts: Iterator[bytes], write, level: int = LEVEL) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Write every record of a plain stream as one gzip member; yields (offset, length, header fields)."""
    buffer, offset, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended
        part = next(parts, None)
        ended = part is None
        buffer.extend(part or b"")
        return not ended

    while True:
        while len(buffer) < 4 and more():
            pass
        while buffer[:2] == b"\r\n":  # blank lines between records
            del buffer[:2]
            while len(buffer) < 2 and more():
                pass
        if not buffer:
            return
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not more():
                raise ValueError(f"archive ends inside a record head after offset {offset}")
        head = bytes(buffer[: end + 4])
        del buffer[: end + 4]
        fields = _fields(head)
        left = int(fields["content-length"])
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = write(packer.compress(head))
        while left:
            if not buffer and not more():
                raise ValueError(f"archive ends inside a record after offset {offset}")
            length += write(packer.compress(bytes(buffer[:left])))
            taken = min(left, len(buffer))
            del buffer[:taken]
            left -= taken
        length += write(packer.compress(b"\r\n\r\n") + packer.flush())
        yield offset, length, fields
        offset += length


def normalise(spark, source: str, target: str) -> DataFrame:
    """Rewrite every archive of ``source`` into ``target``; the stored index of all members.

    Beside ``x.warc.gz`` lies ``x.warc.gz.idx`` with a line "offset length type id" per member.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = _open(uri)
                out_store, folder = _open(target)
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rsplit("/", 1)[-1]) + ".warc.gz"
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                out_store.create_dir(folder, recursive=True)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    with out_store.open_output_stream(own, compression=None) as out:
                        with out_store.open_output_stream(own + ".idx", compression=None) as index:

                            def write(data: bytes, out=out) -> int:
                                out.write(data)
                                return len(data)

                            for offset, length, fields in rewrite(inflate(stream), write):
                                row = (offset, length, fields.get("warc-type", ""), fields.get("warc-record-id", ""))
                                index.write((" ".join(map(str, row)) + "\n").encode())
                                rows.append(row)
                                if len(rows) == 10_000:
                                    yield _index_batch(f"{target}/{name}", rows)
                                    rows = []
                out_store.move(own, f"{folder}/{name}")
                out_store.move(own + ".idx", f"{folder}/{name}.idx")
                if rows:
                    yield _index_batch(f"{target}/{name}", rows)

    return settle(files.mapInArrow(run, _INDEX))


def _index_batch(file: str, rows: list[tuple]) -> pa.RecordBatch:
    offset, length, kind, record = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
            pa.array(kind, pa.string()), pa.array(record, pa.string()),
        ],
        names=["file", "offset", "length", "record_type", "record_id"],
    )


def _page(urn: str | None) -> int | None:
    found = re.search(r"x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parse_member(member: bytes) -> tuple:
    """The columns of ``read_records`` from one gzip member; a response's digest is computed anew and checked."""
    plain = zlib.decompress(member, 31)
    head_end = plain.index(b"\r\n\r\n") + 4
    fields = _fields(plain[:head_end])
    block = plain[head_end : head_end + int(fields["content-length"])]
    http_end = block.index(b"\r\n\r\n") + 4
    payload = block[http_end:]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        size = int(_fields(block[:http_end])["content-length"])
    return (
        _page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")),
        fields.get("warc-target-uri"), payload,
    )


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` lists, each inflated from its own member."""
    wanted = _RECORD if payload else _RECORD.rpartition(",")[0]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in wanted.split(",")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)][: len(names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, current = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file != current:
                    if opened is not None:
                        opened.close()
                    store, path = _open(file)
                    opened, current = store.open_input_file(path), file
                opened.seek(offset)
                row = parse_member(opened.read(length))
                rows.append(row if payload else row[:-1])
                held += len(row[-1]) if payload else 64
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)
        if opened is not None:
            opened.close()

    return index.select("file", "offset", "length").mapInArrow(run, wanted)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and index ``pages``; the index."""
    spark = pages.sparkSession
    raw, clean = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    write_monolithic(with_record_type(pages, min_bytes), raw)
    return normalise(spark, raw, clean)


def digests(pages: DataFrame) -> DataFrame:
    found = read_records(archive(pages), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')
        AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""
