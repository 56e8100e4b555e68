"""WARC archives as a PySpark Python data source, read and write (operator 4)."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..ship import ship
from .common import materialize, scratch_path, temporary

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, http_headers string, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload binary"
#: Fixed value: profile of a revisit record whose payload equals an earlier one's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Filters on these columns are decided by a record's headers alone.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
EXTRA = b"sl"  # gzip extra field that gives a member's compressed and plain lengths


def filesystem(url: str):
    """pyarrow's file system and the path in it, for a local path or the URL of any store it knows."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(url).path
    return fs.FileSystem.from_uri(url)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(head: bytes, body: bytes) -> bytes:
    """One record as two gzip members' worth of data in one: header block first, lengths in the extra field."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH)  # the header block can be read without the rest
    data += z.compress(body) + z.flush()
    plain = head + body
    total = 10 + 2 + 4 + 8 + len(data) + 8
    extra = EXTRA + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(row) -> tuple[bytes, bytes]:
    """Header and block of a record; a revisit's block has the HTTP headers, with the full length, and no payload."""
    payload = bytes(row.payload or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if row.record_type == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <{row.record_id}>",
        f"WARC-Date: {row.date}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row.target_uri is not None:
        lines.append("WARC-Target-URI: " + row.target_uri.replace("\r", "%0D").replace("\n", "%0A"))
    if row.record_type == "revisit":
        lines += [f"WARC-Refers-To: <{row.refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Each task writes its own files under a temporary name; the commit gives the final names, so a retried task leaves no records twice."""

    def __init__(self, path: str, compress: bool, roll: int):
        self.path, self.compress, self.roll = path, compress, roll

    def write(self, iterator: Iterator) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out, size = fs.open_output_stream(f"{path}/_{names[-1]}", compression=None), 0
                head, body = record(row)
                data = member(head, body) if self.compress else head + body
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for n in m.names if m else ():
                fs.move(f"{path}/_{n}", f"{path}/{n}")

    def abort(self, messages) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            for n in m.names if m else ():
                with contextlib.suppress(OSError):
                    fs.delete_file(f"{path}/_{n}")


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]


class Inflated:
    """The plain bytes of one gzip member, in order; knows where the member ends in the archive."""

    STEP = 1 << 16

    def __init__(self, f, start: bytes):
        self.f, self.z, self.raw, self.held = f, zlib.decompressobj(31), start, b""

    def more(self, most: int) -> bool:
        """Hold some bytes more; False at the member's end."""
        while not self.z.eof:
            self.raw = self.raw or self.f.read(self.STEP)
            if not self.raw:
                raise ValueError("a compressed WARC record has no end")
            got = self.z.decompress(self.raw, most)
            self.raw = self.z.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, step: int) -> int:
        """Position of the mark in what is held, or -1 where the member ends without it."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more(step):
                return -1
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(self.STEP):
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.held and not self.more(self.STEP):
                return
            cut = min(n, len(self.held))
            self.held, n = self.held[cut:], n - cut


class Source:
    """Bytes of one archive, record by record: plain archives, a gzip member a record, or members of several records."""

    CHUNK, HTTP = 1 << 16, 1 << 12

    def __init__(self, f, size: int):
        self.f, self.size, self.at = f, size, 0

    def __iter__(self):
        """For each record: its header dict, its block's length, and a function that gives its block, or just its start with the HTTP headers; what isn't asked for isn't decoded."""
        while self.at < self.size:
            self.f.seek(self.at)
            start = self.f.read(self.CHUNK)
            if not start:
                return
            yield from self.packed(start) if start[:2] == b"\x1f\x8b" else self.plain(start)

    @staticmethod
    def parse(head: bytes) -> dict[str, str]:
        pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    @classmethod
    def header(cls, raw: bytes) -> tuple[dict[str, str], int]:
        head = cls.parse(raw)
        n = whole_number(head.get("content-length"))
        if n is None:
            raise ValueError("a WARC header gives no length of its block")
        return head, n

    def plain(self, start: bytes):
        while (end := start.find(b"\r\n\r\n")) < 0:
            more = self.f.read(self.CHUNK)
            if not more:
                raise ValueError("a WARC header has no end")
            start += more
        head, n = self.header(start[:end])
        first = self.at + end + 4
        self.at = first + n + 4

        def block(http_only: bool = False) -> bytes:
            self.f.seek(first)
            got = self.f.read(min(n, self.HTTP) if http_only else n)
            while http_only and b"\r\n\r\n" not in got and len(got) < n:
                got += self.f.read(min(n - len(got), self.HTTP))
            return got

        yield head, n, block

    def packed(self, start: bytes):
        """The records of a gzip member.  Where the member gives its length, a block that isn't wanted isn't inflated."""
        jump, begin = 0, self.at
        if start[3] & 4 and start[12:14] == EXTRA:
            jump = struct.unpack("<I", start[16:20])[0]
        z = Inflated(self.f, start)
        while (end := z.until(b"\r\n\r\n", self.HTTP)) >= 0:
            head, n = self.header(z.take(end + 4).lstrip(b"\r\n"))
            left = n

            def block(http_only: bool = False) -> bytes:
                nonlocal left
                if not http_only:
                    got, left = z.take(left), 0
                    return got
                end = z.until(b"\r\n\r\n", self.HTTP)
                got = z.take(min(left, end + 4 if end >= 0 else left))
                left -= len(got)
                return got

            yield head, n, block
            if jump:
                self.at = begin + jump
                return
            z.skip(left + 4)
        while z.more(z.STEP):
            z.held = b""
        self.at = self.f.tell() - len(z.z.unused_data)


def whole_number(value: str | None) -> int | None:
    """The number that a length header starts with (10, 10 is 10); None where there is none."""
    m = re.match(r"\s*([0-9]+)", value or "")
    return int(m[1]) if m else None


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], pack: int):
        self.path, self.columns, self.pack, self.filters = path, columns, pack, []

    def pushFilters(self, filters):
        """Equality on header columns is decided here, before a payload is decoded; others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.filters.append((HEADER[f.attribute[0]], set(f.value if isinstance(f, In) else (f.value,))))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as afs

        fs, path = filesystem(self.path)
        found = sorted((i.path, i.size) for i in fs.get_file_info(afs.FileSelector(path)) if i.is_file and not i.base_name.startswith(("_", ".")) and i.base_name.endswith((".warc", ".warc.gz")))
        parts, held = [[]], 0
        for x in found:
            if parts[-1] and held + x[1] > self.pack:
                parts.append([])
                held = 0
            parts[-1].append(x)
            held += x[1]
        return [Part(p) for p in parts]

    def wanted(self, head: dict[str, str]) -> bool:
        return all(bare(head.get(k)) in values for k, values in self.filters)

    def read(self, partition: Part):
        fs, _ = filesystem(self.path)
        full, http_only = "payload" in self.columns, {"payload_length", "http_headers"} & set(self.columns)
        for name, size in partition.files:
            with fs.open_input_file(name) as f:
                for head, n, block in Source(f, size):
                    if not self.wanted(head):
                        continue
                    http, payload, length = None, None, n
                    web = head.get("content-type", "").lower().startswith("application/http")
                    if web and (full or http_only):
                        http_raw, mark, payload = block(not full).partition(b"\r\n\r\n")
                        http = http_raw.decode("utf-8", "replace")
                        length = n - len(http_raw) - len(mark)
                        if head.get("warc-type") == "revisit":
                            length = whole_number(Source.parse(http_raw).get("content-length")) or length
                    elif full:
                        payload = block()
                    digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
                    values = {
                        "record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
                        "refers_to": bare(head.get("warc-refers-to")), "payload_digest": digest, "payload_length": length, "http_headers": http, "payload": payload if full else None,
                    }
                    yield tuple(values[c] for c in self.columns)


class WarcDataSource(DataSource):
    """format("warc").  Options: path; columns (comma-separated, default all) to read; compress (true); roll, bytes a file; pack, bytes a read partition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def chosen(self) -> list[str]:
        every = [c.split()[0] for c in SCHEMA.split(", ")]
        return [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else every

    def schema(self) -> str:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self.chosen())

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("pack", 1 << 26)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compress", "true").lower() == "true", int(self.options.get("roll", 1 << 28)))


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", compress: bool = True) -> None:
    """A WARC record per page: of pages with equal payloads of at least `least` bytes, that with the smallest id is
    a response and the others are revisits of it.

    Only digests that occur twice or more are looked up, so few rows are joined; the join is a plain
    equi-join of two shuffled tables, which Spark splits where one payload holds a third of all pages.

    Cases: a null payload is empty; null ids never are the response of a group that has an id, and a group
    of null ids alone is all responses; rows that repeat the smallest id are all responses; an empty
    table writes no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    with temporary(spark):
        firsts = materialize(firsts, "warc-firsts")
        joined = rows.join(firsts, "digest", "left")
        again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
        urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
        out = joined.select(urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), F.when(again, urn("first_id")).alias("refers_to"), "payload")
        out.write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)


def read_warc(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    r = spark.read.format("warc")
    return (r.option("columns", ",".join(columns)) if columns else r).load(path)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    back = read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"])
    return back.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))

