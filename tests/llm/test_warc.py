import base64
import gzip
import hashlib
import zlib

from loomgraph.llm import warc
from loomgraph.session import shared_dir

ROWS = [
    (1, "http://a/x", "<p>same</p>"), (7, "http://a/y", "<p>same</p>"), (3, None, "<p>é🙂\r\n\r\nWARC/1.1\r\n</p>"),
    (4, "http://a/\r\nX: y", None), (5, "http://b/", ""), (6, "http://c/", "z" * 3_000_000), (7, "http://a/y", "<p>same</p>"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(2)


def test_records_come_back(spark):
    out = warc.read_records(warc.archive(pages(spark))).collect()
    assert len(out) == len(ROWS)
    last = {}
    for i, _, html in ROWS:
        last[html or ""] = max(i, last.get(html or "", i))
    html = {i: h or "" for i, _, h in ROWS}
    for r in out:
        body = html[r.page_id].encode()
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if last[html[r.page_id]] == r.page_id:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", last[html[r.page_id]], b"")
    assert {r.url for r in out if r.page_id == 4} == {"http://a/%0D%0AX: y"}


def test_small_payloads_are_never_revisits(spark):
    out = warc.read_records(warc.archive(pages(spark), min_bytes=12), payload=False).collect()
    assert {r.record_type for r in out} == {"response"} and "payload" not in out[0]


def test_members_and_index(spark):
    raw, clean = shared_dir(spark, "t-raw"), shared_dir(spark, "t-clean")
    warc.write_monolithic(warc.with_record_type(pages(spark)), raw)
    index = warc.normalise(spark, raw, clean)
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file, []).append(r)
    assert sum(map(len, by_file.values())) == len(ROWS)
    for file, rows in by_file.items():
        store, path = warc._open(file)
        data = store.open_input_stream(path, compression=None).read()
        side = store.open_input_stream(path + ".idx").read().decode().splitlines()
        rows.sort(key=lambda r: r.offset)
        assert side == [f"{r.offset} {r.length} {r.record_type} {r.record_id}" for r in rows]
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        whole = gzip.decompress(data)
        parts = [zlib.decompress(data[r.offset : r.offset + r.length], 31) for r in rows]
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)


def test_normaliser_takes_members_and_chunks_of_any_size():
    record = lambda n: f"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: {n}\r\n\r\n".encode() + b"a" * n + b"\r\n\r\n"
    plain = b"".join(map(record, (0, 5, 70_000, 1)))

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    for packed in (gzip.compress(plain), b"".join(gzip.compress(record(n)) for n in (0, 5, 70_000, 1))):
        for chunk in (1, 7, 1000, 1 << 20) if len(packed) < 2000 else (7, 1 << 20):
            out = bytearray()

            def write(data, out=out):
                out.extend(data)
                return len(data)

            found = list(warc.rewrite(warc.inflate(Stream(packed), chunk), write))
            assert gzip.decompress(bytes(out)) == plain and len(found) == 4


def test_no_rows(spark):
    assert warc.digests(pages(spark, []).limit(0)).count() == 0
