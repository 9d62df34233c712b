"""WARC archives as a PySpark Python data source, ``format("warc")``.

Writing: each task writes one file of records, each record a gzip member of
its own that carries its compressed length in an extra field ("sl").  Files
count only once the job commits: the commit writes a manifest that names the
files and, in each, the offsets at which a reader may start; files of lost or
repeated attempts are never named.

Reading: partitions are planned from the manifest's offsets (or whole files
where a folder has none).  Filters on record type and header fields are pushed
down.  A record's headers are parsed first; where the filters reject it, or the
schema asks for no payload, the rest of the member is skipped, not decoded.

Paths may be of any scheme that pyarrow.fs opens.  ``read`` and ``write`` resolve one
without scheme against the cluster's default file system; given to the format
itself it is each machine's own disk.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from driftline.llm.common import cut, qualified

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, payload_length long, payload binary"
#: Columns of the writer, by name; others are ignored.
WRITE_SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Bytes between two places where a reader may start.
SPLIT_BYTES = 32 << 20
#: Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT_BYTES = 1000
#: Repeated digests that are broadcast at most; with hash table about 200 bytes each.
BROADCAST_DIGESTS = 500_000
MANIFEST = "_manifest-"
ARCHIVES = (".warc", ".warc.gz")
#: Bytes of a record that are decoded at a time in search of its headers.
HEAD_BYTES = 2048
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
_BRACKETED = {"record_id", "refers_to"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _safe_uri(uri: str) -> str:
    """Blanks and control characters percent-encoded, so that no value can add a header line."""
    return quote(uri, safe="".join(chr(c) for c in range(0x21, 0x7F))) if any(c <= " " or c == "\x7f" for c in uri) else uri


def digest_header(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def digest_hex(header: str) -> str:
    """Bare lower-case hex of a digest header, given in base 32 or in hex."""
    value = header.rpartition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def member(content: bytes, level: int = 1) -> bytes:
    """A gzip member that states its own compressed and plain length in the "sl" extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(content) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x04\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload_digest: str, payload_length: int, payload: bytes, date: str) -> bytes:
    """One response or revisit record; its block is an HTTP response, without body in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: {_safe_uri(uri)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {digest_header(payload_digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool = False) -> None:
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, starts, out = 0, [], None
        for batch in iterator:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                if not starts or at - starts[-1] >= SPLIT_BYTES:
                    starts.append(at)
                data = member(record(row["warc_type"], row["record_id"] or f"urn:uuid:{uuid.uuid4()}", row["target_uri"], row["refers_to"], row["payload_digest"], row["payload_length"], row["payload"] or b"", self.date))
                out.write(data)
                at += len(data)
        if out is None:
            return Written([])
        out.close()
        return Written([{"file": name, "starts": starts, "size": at}])

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        new = {f["file"] for f in files}
        old = [n for n in _listed(system, root) if n not in new and (n.startswith(MANIFEST) or n.endswith(ARCHIVES))] if self.overwrite else []
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write("\n".join(json.dumps(x) for x in [*({"replaces": n} for n in old if n.startswith(MANIFEST)), *files]).encode())
        for n in sorted(old, key=lambda n: not n.startswith(MANIFEST)):
            system.delete_file(f"{root}/{n}")

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{root}/{f['file']}")


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int


def _listed(system: fs.FileSystem, root: str) -> dict[str, int]:
    """Name and size of the files of a folder."""
    return {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}


def plan(path: str) -> list[Part]:
    """Partitions: the spans between the offsets of the manifests, or whole files without one."""
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [Part(root, 0, info.size)]
    files = _listed(system, root)
    manifests = {}
    for name in sorted(n for n in files if n.startswith(MANIFEST)):
        with system.open_input_stream(f"{root}/{name}") as f:
            manifests[name] = [json.loads(x) for x in f.read().decode().splitlines()]
    if not manifests:
        return [Part(f"{root}/{n}", 0, size) for n, size in sorted(files.items()) if n.endswith(ARCHIVES) and not n.startswith(("_", "."))]
    replaced = {x["replaces"] for lines in manifests.values() for x in lines if "replaces" in x}
    out = []
    for x in (x for name, lines in manifests.items() if name not in replaced for x in lines if "file" in x):
        out += [Part(f"{root}/{x['file']}", a, b) for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)]
    return out


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            out[k.strip().lower()] = v.strip()
    return out


class _Source:
    """Buffered reads of one partition."""

    def __init__(self, f: object, start: int, end: int) -> None:
        self.f, self.base, self.end = f, start, end
        self.buf, self.at = b"", 0
        f.seek(start)

    def need(self, n: int) -> memoryview:
        """At least n bytes from the present place, or what is left."""
        if len(self.buf) - self.at < n:
            pieces = [self.buf[self.at :]]
            have = len(pieces[0])
            while have < n and (got := self.f.read(max(1 << 18, n - have))):
                pieces.append(got)
                have += len(got)
            self.buf, self.at = b"".join(pieces), 0
        return memoryview(self.buf)[self.at :]

    def find(self, what: bytes) -> int:
        """Where ``what`` lies in the bytes read so far, from the present place."""
        found = self.buf.find(what, self.at)
        return found - self.at if found >= 0 else -1

    def skip(self, n: int) -> None:
        self.base += n
        if n <= len(self.buf) - self.at:
            self.at += n
        else:
            self.buf, self.at = b"", 0
            self.f.seek(self.base)


def records(source: _Source, wanted: object, payload: bool) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None]]:
    """(WARC headers, HTTP headers, payload) of the records that ``wanted`` accepts by header."""
    while source.base < source.end and len(start := source.need(4)):
        yield from (_gzip_record if start[:2] == b"\x1f\x8b" else _plain_record)(source, wanted, payload)


def _split_block(block: bytes, kind: str) -> tuple[dict[str, str], bytes]:
    if block[:5] != b"HTTP/":
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return _headers(head), body


def _headed(block: bytes) -> bool:
    """Whether the start of a block tells all that its HTTP headers do."""
    return len(block) >= 5 and (block[:5] != b"HTTP/" or b"\r\n\r\n" in block)


def _gzip_record(source: _Source, wanted: object, payload: bool) -> Iterator:
    start = source.need(24)
    total = struct.unpack_from("<I", start, 16)[0] if start[3] & 4 and start[12:14] == b"sl" else 0
    z = zlib.decompressobj(31)
    fed, plain = 0, b""

    def more(limit: int) -> bool:
        nonlocal fed, plain
        piece = z.unconsumed_tail
        if not piece:
            piece = source.need(fed + 1)[fed : fed + (1 << 16)]
            if total:
                piece = piece[: total - fed]
            fed += len(piece)
        if not piece or z.eof:
            return False
        plain += z.decompress(piece, limit)
        return True

    while b"\r\n\r\n" not in plain and more(HEAD_BYTES):
        pass
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _headers(head)
    if wanted(fields):
        length = int(fields.get("content-length", 0))
        plain = rest
        while len(plain) < length and (payload or not _headed(plain)) and more(length - len(plain) if payload else HEAD_BYTES):
            pass
        http, body = _split_block(plain[:length], fields.get("warc-type", ""))
        yield fields, http, body if payload else None
    if not total:
        while not z.eof:
            plain = b""
            if not more(1 << 20):
                break
        total = fed - len(z.unused_data)
    source.skip(total)


def _plain_record(source: _Source, wanted: object, payload: bool) -> Iterator:
    at, size = -1, 1 << 12
    while (at := source.find(b"\r\n\r\n")) < 0 and len(source.need(size)) >= size:
        size *= 2
    if at < 0:
        source.skip(source.end - source.base)
        return
    fields = _headers(bytes(source.need(at)[:at]).lstrip(b"\r\n"))
    length = int(fields.get("content-length", 0))
    if wanted(fields):
        size = length if payload else min(length, HEAD_BYTES)
        while True:
            block = bytes(source.need(at + 4 + size)[at + 4 : at + 4 + size])
            if payload or size >= length or _headed(block):
                break
            size = min(length, 2 * size)
        http, body = _split_block(block, fields.get("warc-type", ""))
        yield fields, http, body if payload else None
    source.skip(at + 4 + length + 4)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality, membership, prefix and presence tests of header columns are done while reading."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _FIELD and name != "payload_digest" and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.tests.append((name, f))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return plan(self.path)

    def _value(self, fields: dict[str, str], name: str) -> str | None:
        value = fields.get(_FIELD[name].lower())
        return value.strip("<>") if value and name in _BRACKETED else value

    def _wanted(self, fields: dict[str, str]) -> bool:
        for name, f in self.tests:
            value = self._value(fields, name)
            if value is None or isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # an archive without files
            return
        schema = to_arrow_schema(self.schema)
        names = schema.names
        system, _ = _open(self.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(partition.file) as f:
            for fields, http, payload in records(_Source(f, partition.start, partition.end), self._wanted, "payload" in names):
                row = []
                for name in names:
                    if name == "payload":
                        row.append(payload)
                    elif name == "content_length":
                        row.append(int(fields.get("content-length", 0)))
                    elif name == "payload_length":
                        row.append(int(http["content-length"]) if "content-length" in http else None)
                    elif name == "payload_digest":
                        row.append(digest_hex(v) if (v := fields.get("warc-payload-digest")) else None)
                    else:
                        row.append(self._value(fields, name) if name in _FIELD else None)
                rows.append(tuple(row))
                held += len(payload or b"") + 200
                if held >= 8 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcDataSource(DataSource):
    """Options: ``path``; ``date``, the WARC-Date of written records."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2020-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let its sources take filters; reading needs both."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records under ``path`` with the given columns (a DDL part of ``SCHEMA``); leave ``payload``
    out to skip the decoding of payloads."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(qualified(spark, path))


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows of ``WRITE_SCHEMA`` for (page_id, url, html) pages; other columns are left out.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest page_id is the
    response, the others revisit it.  Per digest one row (largest id) is pre-aggregated and only
    digests that occur twice are joined back, so a payload that fills a third of the table adds
    one row to the small side.  That table is written and counted: up to ``BROADCAST_DIGESTS`` rows
    it is broadcast and no payload is shuffled; beyond, payloads are shuffled by digest, and
    adaptive execution splits a digest of many pages.  A null html has an empty payload; a page without id is always a response with a fresh record
    id; rows that repeat the largest id are all responses."""
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    shared = keyed.filter(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("digest_of"), F.col("size").alias("size_of")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").drop("n")
    shared = cut(shared)
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    joined = keyed.join(shared, (F.col("digest") == F.col("digest_of")) & (F.col("size") == F.col("size_of")), "left")
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, name(F.col("first_id"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append records (columns of ``WRITE_SCHEMA``) to the archive folder at ``path``, or replace
    what it holds (mode "overwrite")."""
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).save(qualified(rows.sparkSession, path))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """Per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Two scans: responses with payload, whose length and digest are computed from the bytes read
    (a header that disagrees fails the job); revisits by headers alone, without decoding."""
    page = lambda c: F.when(F.col(c).startswith("urn:x-page:"), F.substring_index(c, ":", -1)).cast("long")
    full = read(spark, path, "warc_type string, record_id string, payload_digest string, payload_length long, payload binary").filter(F.col("warc_type") == "response")
    sha = F.sha1("payload")
    checked = F.when((sha == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_length")), sha).otherwise(F.raise_error(F.concat(F.lit("payload differs from its header in "), F.col("record_id"))).cast("string"))
    responses = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    brief = read(spark, path, "warc_type string, record_id string, refers_to string, payload_digest string, payload_length long").filter(F.col("warc_type") == "revisit")
    revisits = brief.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def archive_name() -> str:
    return f"warc-{uuid.uuid4().hex}"
