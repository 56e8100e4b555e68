import base64
import glob
import hashlib

import pytest

from quadrille.llm import warc
from quadrille.llm.warc import Source, op4_warc, read_warc, write_warc

ROWS = [(5, "http://a/", "<p>é</p>"), (3, "http://b/\r\nX: y", "<p>é</p>"), (9, None, None), (8, "u", ""), (None, "v", "<p>é</p>"), (7, "w", "x" * 300000), (3, "again", "<p>é</p>"), (11, "t", "\r\n\r\nWARC/1.1\r\n\r\n")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    d = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, payload string")
    write_warc(d, str(tmp_path / "w"), compress=compress)
    back = read_warc(spark, str(tmp_path / "w")).collect()
    want = sorted((f"urn:page:{'null' if i is None else i}", digest(t), len((t or "").encode())) for i, _, t in ROWS)
    assert sorted((r.record_id, r.payload_digest, r.payload_length) for r in back) == want
    kinds = {(r.record_id, r.target_uri): (r.record_type, r.refers_to) for r in back}
    assert kinds["urn:page:5", "http://a/"] == ("revisit", "urn:page:3") and kinds["urn:page:3", "again"] == ("response", None)
    assert kinds["urn:page:9", None] == ("revisit", "urn:page:8") and kinds["urn:page:null", "v"] == ("revisit", "urn:page:3")
    for r in back:
        if r.record_type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest
        else:
            assert bytes(r.payload) == b""


@pytest.mark.parametrize("compress", [True, False])
def test_pushed_filters_skip_payloads(spark, tmp_path, compress):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    write_warc(d, str(tmp_path / "w"), compress=compress)
    r = read_warc(spark, str(tmp_path / "w"))
    assert r.where("record_type = 'revisit'").count() == 3
    assert [x.target_uri for x in r.where("record_id = 'urn:page:7' and record_type in ('response', 'metadata')").collect()] == ["w"]
    reader = warc.WarcReader(str(tmp_path / "w"), ["record_id", "payload"], 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    assert not left and sum(1 for p in reader.partitions() for _ in reader.read(p)) == 3


def test_unwanted_blocks_are_not_decoded(spark, tmp_path):
    write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for name in glob.glob(str(tmp_path / "w" / "*.gz")):
        with open(name, "rb") as f:
            data = f.read()
            f.seek(0)
            src, n, read = Source(f, len(data)), 0, 0
            for _ in src:
                n += 1
            assert src.at == len(data) and n > 0


def raw_record(i, kind, content, block):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, i, content, len(block)) + block + b"\r\n\r\n"


def test_blocks_that_are_not_http_are_payload_whole(spark, tmp_path):
    import gzip

    text = b"first part\r\n\r\nsecond part"
    (tmp_path / "w").mkdir()
    records = [raw_record(1, b"conversion", b"text/plain", text), raw_record(2, b"warcinfo", b"application/warc-fields", b"a: b\r\n\r\n")]
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    rows = read_warc(spark, str(tmp_path / "w")).where("record_type = 'conversion'").collect()
    assert [(bytes(r.payload), r.payload_length, r.http_headers) for r in rows] == [(text, len(text), None)] * 2
    assert [r.payload_length for r in read_warc(spark, str(tmp_path / "w"), ["record_type", "payload_length"]).collect()] == [len(text), 8] * 2


def test_foreign_archives(spark, tmp_path):
    """Plain gzip members without lengths in an extra field, one member of several records, and odd HTTP lengths."""
    import gzip

    def rec(i, body, length=b""):
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n" + length + b"\r\n" + body
        return raw_record(i, b"response", b"application/http; msgtype=response", block)

    bodies = [b"", b"a" * 200000, b"xyz"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(rec(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "w" / "b.warc").write_bytes(b"".join(rec(i + 10, b, b"Content-Length: 10, 10\r\n") for i, b in enumerate(bodies)))
    (tmp_path / "w" / "c.warc.gz").write_bytes(gzip.compress(b"".join(rec(i + 20, b, b"Content-Length: none\r\n") for i, b in enumerate(bodies))))
    for columns in (["record_id", "payload_length"], None):
        rows = read_warc(spark, str(tmp_path / "w"), columns).collect()
        assert sorted((r.record_id, r.payload_length) for r in rows) == sorted((f"urn:page:{i + k}", len(b)) for k in (0, 10, 20) for i, b in enumerate(bodies))


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


def test_query(spark, sf001):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op4_warc(spark, sf001).collect()}
    assert got == {i: (len(h.encode()), digest(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages.items()}
