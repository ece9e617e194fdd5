"""Web archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Files are ``.warc.gz`` with one gzip member per record. Members carry the skip
length (extra field ``sl``) that the format describes, so a reader decodes the
record header, tests it against the pushed filters, and goes to the next member
without decoding the payload. Archives without skip lengths are read as well;
their members are run through to find the next.

A reader plans one partition per file; the writer starts a new file every
``rollBytes``. Only files listed by a committed job are read: each job leaves a
``_manifest-*`` file, so files of failed or repeated tasks are never seen.
Folders without a manifest are read whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from .shared import removed_at_exit, scratch

SCHEMA = (
    "page_id long, record_type string, url string, refers_to long,"
    " payload_bytes long, payload_digest string, payload binary"
)
#: Payloads below this size are never written as revisits.
REVISIT_BYTES = 100
_RECORD_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


# Records ----------------------------------------------------------------------


def member(data: bytes, level: int = 5) -> bytes:
    """One gzip member with its skip length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + 8
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(kind: str, page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """A record whose payload follows an HTTP header; a revisit has the header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_RECORD_ID}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        written = quote(url, safe=_URL_SAFE)
        lines.append(f"WARC-Target-URI: {written}")
        if written != url:  # an extension field has the url itself
            lines.append(f"{_OWN_URL}: {json.dumps(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "!#$&'()*+,/:;=?@[]~%"
_OWN_URL = "X-Source-URL"


class _Members:
    """Gzip members of a stream, one at a time, decoded no further than asked."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece, self.held = stream, piece, b""

    def _need(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.stream.read(max(self.piece, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def next(self) -> bool:
        """Go to the next member; False at the end."""
        if not self._need(10):
            if self.held:
                raise ValueError("archive ends inside a record")
            return False
        if self.held[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        flags, at, self.left = self.held[3], 10, None
        if flags & 4:
            self._need(12)
            n = struct.unpack_from("<H", self.held, 10)[0]
            self._need(12 + n)
            extra, at = self.held[12 : 12 + n], 12 + n
            while len(extra) >= 4:
                size = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and size == 8:
                    self.left = struct.unpack_from("<I", extra, 4)[0] - at
                extra = extra[4 + size :]
        for bit in (8, 16):
            if flags & bit:
                while (end := self.held.find(b"\0", at)) < 0:
                    if not self._need(len(self.held) + 1):
                        raise ValueError("archive ends inside a record")
                if self.left is not None:
                    self.left -= end + 1 - at
                at = end + 1
        if flags & 2:
            at += 2
            self._need(at)
            if self.left is not None:
                self.left -= 2
        self.held = self.held[at:]
        self.inflate, self.out = zlib.decompressobj(-15), b""
        return True

    def _feed(self, most: int = 0) -> bytes:
        """Some decoded bytes; empty at the end of the member."""
        while not self.inflate.eof:
            if not self._need(1):
                raise ValueError("archive ends inside a record")
            given = self.held[: self.piece] if most == 0 else self.held[: max(512, most)]
            got = self.inflate.decompress(given, most)
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            used = len(given) - len(rest)
            self.held = self.held[used:]
            if self.left is not None:
                self.left -= used
            if got:
                return got
        return b""

    def until(self, mark: bytes) -> bytes:
        """Decoded bytes up to and with ``mark``."""
        while (at := self.out.find(mark)) < 0:
            got = self._feed(1024)
            if not got:
                raise ValueError("record without an end of header")
            self.out += got
        at += len(mark)
        head, self.out = self.out[:at], self.out[at:]
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            got = self._feed(max(1024, n - have))
            if not got:
                raise ValueError("record shorter than its length")
            parts.append(got)
            have += len(got)
        data = b"".join(parts)
        self.out = data[n:]
        return data[:n]

    def skip(self) -> None:
        """Leave the member: by its skip length, else by decoding to its end."""
        if self.left is None:
            while self._feed():
                pass
            left = 8
        else:
            left = self.left
        if left <= len(self.held):
            self.held = self.held[left:]
            return
        left -= len(self.held)
        self.held = b""
        self.stream.seek(left, 1)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page(reference: str | None) -> int | None:
    text = (reference or "").strip("<>").removeprefix(_RECORD_ID)
    return int(text) if text.lstrip("-").isdigit() else None


# Filters ------------------------------------------------------------------------

#: Columns known from the record header alone.
HEADER_COLUMNS = ("record_type", "page_id", "url", "refers_to", "payload_digest")
_TESTS = {
    EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, LessThan: lambda v, w: v < w,
    GreaterThanOrEqual: lambda v, w: v >= w, LessThanOrEqual: lambda v, w: v <= w,
    In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w),
    StringEndsWith: lambda v, w: v.endswith(w), StringContains: lambda v, w: w in v,
}


def header_test(f):
    """``f`` as a test of a header's values with SQL nulls, or None if it needs more than the header."""
    if isinstance(f, Not):
        inner = header_test(f.child)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda row: row[name] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[name] is not None
    value = f.value
    if isinstance(f, EqualNullSafe):
        return lambda row: row[name] == value
    test = _TESTS.get(type(f))
    if test is None or value is None:
        return None
    if isinstance(f, In) and any(v is None for v in value):
        return None
    return lambda row: None if row[name] is None else test(row[name], value)


# The source ---------------------------------------------------------------------


def _url(fields: dict[str, str]) -> str | None:
    own = fields.get(_OWN_URL.lower())
    return fields.get("warc-target-uri") if own is None else json.loads(own)


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    """Options: ``verify`` (true: payloads that are read must have the digest of their header)."""

    def __init__(self, schema, options):
        self.columns = schema.names
        self.folder = options["path"]
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if header_test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        from pyarrow import fs

        where, folder = _files(self.folder)
        names = [x.path for x in where.get_file_info(fs.FileSelector(folder)) if x.is_file]
        lists = [x for x in names if x.rsplit("/", 1)[-1].startswith("_manifest-")]
        if lists:
            listed = set()
            for x in lists:
                with where.open_input_stream(x) as stream:
                    listed |= set(json.loads(stream.read()))
            names = [x for x in names if x.rsplit("/", 1)[-1] in listed]
        return [WarcFile(x) for x in sorted(names) if x.endswith((".warc", ".warc.gz"))]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        if partition is None:  # an archive without files
            return
        tests = [header_test(f) for f in self.filters]
        where, _ = _files(self.folder)
        want_size = "payload_bytes" in self.columns
        want_payload = "payload" in self.columns or self.verify
        with where.open_input_file(partition.path) as stream:
            members = _Members(stream)
            while members.next():
                fields = _fields(members.until(b"\r\n\r\n"))
                digest = fields.get("warc-payload-digest")
                row = {
                    "page_id": _page(fields.get("warc-record-id")),
                    "record_type": fields.get("warc-type"),
                    "url": _url(fields),
                    "refers_to": _page(fields.get("warc-refers-to")),
                    "payload_digest": digest and digest.partition(":")[2],
                    "payload_bytes": None,
                    "payload": None,
                }
                if all(test(row) for test in tests):
                    if want_size or want_payload:
                        self._body(members, fields, row, want_payload)
                    yield tuple(row[c] for c in self.columns)
                members.skip()

    def _body(self, members: _Members, fields: dict, row: dict, want_payload: bool) -> None:
        left = int(fields.get("content-length", "0"))
        if "application/http" in fields.get("content-type", ""):
            http = members.until(b"\r\n\r\n")
            left -= len(http)
            row["payload_bytes"] = int(_fields(http).get("content-length", left))
        else:
            row["payload_bytes"] = left
        if row["record_type"] == "revisit":
            return
        row["payload_bytes"] = left
        if want_payload:
            payload = members.take(left)
            row["payload"] = payload
            if self.verify and hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                raise ValueError(f"payload of page {row['page_id']} differs from its digest")


class WarcFiles(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceWriter):
    """Takes columns page_id, url, payload (string or binary), record_type, refers_to, payload_bytes, payload_digest.

    Options: ``rollBytes`` (64 MB) and ``date``, the date of all records.
    """

    def __init__(self, options):
        self.folder = options["path"]
        self.roll = int(options.get("rollBytes", 64 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator) -> WarcFiles:
        where, folder = _files(self.folder)
        where.create_dir(folder, recursive=True)
        names, stream, size = [], None, 0
        try:
            for row in iterator:
                if stream is None or size >= self.roll:
                    if stream is not None:
                        stream.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    stream, size = where.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                payload = row.payload or b""
                payload = payload.encode() if isinstance(payload, str) else bytes(payload)
                data = member(record(
                    row.record_type, row.page_id, row.url, payload, row.payload_bytes,
                    row.payload_digest, row.refers_to, self.date,
                ))
                stream.write(data)
                size += len(data)
        finally:
            if stream is not None:
                stream.close()
        return WarcFiles(names)

    def commit(self, messages) -> None:
        where, folder = _files(self.folder)
        where.create_dir(folder, recursive=True)
        listed = sorted(n for m in messages if m is not None for n in m.names)
        with where.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}") as stream:
            stream.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        where, folder = _files(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                where.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known and let filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html`` as records: of equal payloads of ``least`` bytes or more, the smallest page_id is the response.

    Null html is an empty payload. Rows that repeat the smallest page_id are
    responses too; a null page_id refers to the smallest id of its payload, and
    is a response if there is none. Groups are found by one aggregate over
    digests; only digests held more than once meet the pages again.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", "html",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    held = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    first = held.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & revisit
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url",
        F.when(~revisit, F.col("html")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_bytes", "payload_digest",
    )


def write_archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    with_revisits(pages).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """Records of an archive; payloads are decoded only if ``columns`` has them or ``verify`` is set."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to an archive in the shared folder and its headers read back, payloads checked; it goes at exit."""
    path = removed_at_exit(scratch(pages.sparkSession, "warc"))
    write_archive(pages, path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_archive(pages.sparkSession, path, columns, verify=True)
