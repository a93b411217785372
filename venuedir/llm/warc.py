"""WARC archives as a Python data source of Spark, for reading and writing.

``spark.read.format("warc")`` plans whole files into partitions, takes predicates on the
record type and on header columns into the scan, and parses the headers of a record before
anything else. The payload is decoded only for records that pass and only if the requested
schema has it: a gzip member that tells its length (extra field ``sl``) is skipped by a seek,
another one is inflated and thrown away piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from venuedir.llm.common import scratch, table
from venuedir.operators.skew import lookup

#: Columns that come from one named header each; predicates on them are decided before any block is read.
HEADER_COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = ("record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, "
          "refers_to string, content_length long, headers map<string,string>, http_status int, payload binary, file string, offset long")
#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"
MANIFEST = "_manifest-"

_CHUNK, _FIRST = 1 << 16, 1 << 11
_MAX_HEADER = 1 << 20
_BATCH_ROWS, _BATCH_BYTES = 1000, 4 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS or an object store), and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# --- records out of bytes -----------------------------------------------------


class _Plain:
    """An archive without compression; one endless member."""

    def __init__(self, raw: io.BufferedReader):
        self.raw = raw

    def open_member(self) -> bool:
        return bool(self.raw.peek(1))

    def offset(self) -> int:
        return self.raw.tell()

    def line(self) -> bytes:
        return self.raw.readline(_MAX_HEADER)

    def take(self, n: int) -> bytes:
        return self.raw.read(n)

    def skip(self, n: int) -> None:
        self.raw.seek(n, io.SEEK_CUR)

    def skip_member(self, filled: int) -> bool:
        return False


class _Gzip:
    """An archive of gzip members, usually one per record; members are opened and left one by one."""

    def __init__(self, raw: io.BufferedReader):
        self.raw = raw
        self.inflate = None
        self.pending = b""

    def open_member(self) -> bool:
        """Read the next member's gzip header; False at the end of the file."""
        self.start = self.raw.tell()
        head = self.raw.read(10)
        if not head:
            return False
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        flags = head[3]
        self.length = self.size = None
        if flags & 4:
            extra = self.raw.read(struct.unpack("<H", self.raw.read(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length, self.size = struct.unpack("<II", extra[4:12])
                extra = extra[4 + n:]
        for flag in (8, 16):  # file name and comment, each ended by a zero byte
            while flags & flag and self.raw.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            self.raw.read(2)
        self.inflate = zlib.decompressobj(-zlib.MAX_WBITS)
        self.pending, self.given, self.tail = b"", 0, b""
        return True

    def offset(self) -> int:
        return self.start

    def _more(self, limit: int = _CHUNK) -> bytes:
        """Some further bytes of the member, none at its end; the file then stands behind it."""
        while not self.inflate.eof:
            data = self.tail or self.raw.read(_CHUNK if self.given else _FIRST)
            if not data:
                raise ValueError("cut gzip member")
            out = self.inflate.decompress(data, limit)
            self.tail = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw.seek(8 - len(self.inflate.unused_data), io.SEEK_CUR)
            if out:
                return out
        return b""

    def line(self) -> bytes:
        while (at := self.pending.find(b"\n")) < 0 and len(self.pending) < _MAX_HEADER:
            more = self._more()
            if not more:
                at = len(self.pending) - 1
                break
            self.pending += more
        out, self.pending = self.pending[:at + 1], self.pending[at + 1:]
        self.given += len(out)
        return out

    def take(self, n: int) -> bytes:
        parts, left = [self.pending[:n]], n - len(self.pending)
        self.pending = self.pending[n:]
        while left > 0 and (more := self._more(max(left, 1))):
            parts.append(more)
            left -= len(more)
        out = b"".join(parts)
        self.given += len(out)
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (gone := len(self.take(min(n, _CHUNK)))):
            n -= gone

    def skip_member(self, filled: int) -> bool:
        """Go to the next member by a seek if the record, ``filled`` more bytes, ends this one."""
        if self.length is None or self.size != self.given + filled:
            return False
        self.raw.seek(self.start + self.length)
        if self.raw.peek(2)[:2] not in (b"\x1f\x8b", b""):
            raise ValueError("wrong length of a gzip member")
        return True


def _fields(stream) -> tuple[str, dict[str, str]] | None:
    """``(first line, headers)`` of the next record; names in lower case, folded lines joined."""
    line = stream.line()
    while line in (b"\r\n", b"\n"):
        line = stream.line()
    if not line:
        return None
    first, out, name, size = line.decode("utf-8", "replace").strip(), {}, "", len(line)
    while True:
        line = stream.line()
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not line or size > _MAX_HEADER:
            raise ValueError("record header without an end")
        if not text:
            return first, out
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()


def _hex_digest(value: str | None) -> str | None:
    """A ``sha1:`` value as lower-case hex, whether written in base 32 or 16; others as they are."""
    kind, colon, digest = (value or "").partition(":")
    if not colon or kind.lower() != "sha1":
        return value
    try:
        return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()
    except ValueError:
        return value


def _split_http(block: bytes) -> tuple[int | None, bytes]:
    """Status and body of an HTTP message; transfer codings are left as they are."""
    found = re.search(rb"\r?\n\r?\n", block)
    status = re.match(rb"HTTP/\S+ (\d{3})", block)
    return int(status[1]) if status else None, block[found.end():] if found else b""


def records(raw: io.BufferedReader, wanted=lambda row: True, payload: bool = True, status: bool = True) -> Iterator[dict]:
    """Records of one archive, headers first.

    Blocks of records that ``wanted`` refuses are not decoded, nor is any block when neither
    payload nor HTTP status is asked for. A revisit record has no payload (None).
    """
    magic = raw.peek(2)[:2]
    stream = _Gzip(raw) if magic == b"\x1f\x8b" else _Plain(raw)
    while stream.open_member():
        while True:
            at = stream.offset()
            head = _fields(stream)
            if head is None:
                break
            first, fields = head
            if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
                raise ValueError("no WARC record")
            length = int(fields["content-length"])
            row = {column: fields.get(name) for column, name in HEADER_COLUMNS.items()}
            row |= {"payload_digest": _hex_digest(row["payload_digest"]), "content_length": length, "headers": fields,
                    "http_status": None, "payload": None, "offset": at}
            keep = wanted(row)
            left = length
            if keep and (payload or status):
                http = (row["content_type"] or "").startswith(HTTP)
                if payload or (http and length <= _MAX_HEADER):
                    block, left = stream.take(length), 0
                    if len(block) != length:
                        raise ValueError("cut record")
                    if http:
                        row["http_status"], block = _split_http(block)
                    row["payload"] = block if payload and row["record_type"] != "revisit" else None
                elif http:
                    block = stream.take(_MAX_HEADER)
                    left -= len(block)
                    row["http_status"] = _split_http(block)[0]
            skipped = stream.skip_member(left + 4)
            if not skipped:
                stream.skip(left)
            if keep:
                yield row
            if skipped:
                break


# --- the source: partitions, predicates, reading ---------------------------------

_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v is not None and v in x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    StringEndsWith: lambda v, x: v is not None and v.endswith(x),
    StringContains: lambda v, x: v is not None and x in v,
    IsNull: lambda v, x: v is None,
    IsNotNull: lambda v, x: v is not None,
}


def _condition(predicate) -> tuple | None:
    """``(column, kind, value, negated)`` of a predicate that headers decide, else None."""
    negated = isinstance(predicate, Not)
    inner = predicate.child if negated else predicate
    column = getattr(inner, "attribute", ())
    if type(inner) not in _TESTS or len(column) != 1 or column[0] not in HEADER_COLUMNS:
        return None
    value = getattr(inner, "value", None)
    if negated and (type(inner) not in (EqualTo, In) or isinstance(value, tuple) and None in value):
        return None
    if type(inner) is In and None in value:
        return None
    return column[0], type(inner), value, negated


def _passes(row: dict, conditions: Sequence[tuple]) -> bool:
    for column, kind, value, negated in conditions:
        got = row[column]
        if (negated and (got is None or _TESTS[kind](got, value))) or (not negated and not _TESTS[kind](got, value)):
            return False
    return True


@dataclass
class Files(InputPartition):
    """Archives of one task; a file is never cut, since a member's start cannot be told from its bytes."""

    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.schema = schema
        self.path = options.get("path")
        self.limit = int(options.get("maxPartitionBytes", 128 << 20))
        self.bad = options.get("onBadFile", "fail")
        self.conditions: list[tuple] = []

    def pushFilters(self, filters):
        for predicate in filters:
            condition = _condition(predicate)
            if condition is None:
                yield predicate
            else:
                self.conditions.append(condition)

    def _files(self) -> list[tuple[str, int]]:
        """Archives below the path: those of its manifests, or, without any, all by their names."""
        system, root = _filesystem(self.path)
        if system.get_file_info(root).type == pafs.FileType.File:
            return [(root, system.get_file_info(root).size)]
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        named = {i.path: i.size for i in found if re.search(r"\.warc(\.gz)?$", i.base_name)}
        lists = [i.path for i in found if i.base_name.startswith(MANIFEST)]
        if not lists:
            return sorted(named.items())
        committed = []
        for one in lists:
            with system.open_input_stream(one) as f:
                committed += json.loads(f.readall())
        paths = [f"{root.rstrip('/')}/{name}" for name in committed]
        return sorted((p, named[p]) for p in paths)

    def partitions(self) -> Sequence[InputPartition]:
        out, size = [], 0
        for path, n in sorted(self._files(), key=lambda x: (-x[1], x[0])):
            if not out or size + n > self.limit:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        names = self.schema.fieldNames()
        kind = to_arrow_schema(self.schema)
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" and r[n] is not None else r[n]
                                                         for r in rows], kind.field(n).type) for n in names], schema=kind)

        for path in partition.paths:
            with system.open_input_file(path) as native:
                try:
                    for row in records(io.BufferedReader(native, _CHUNK), lambda r: _passes(r, self.conditions),
                                       "payload" in names, "http_status" in names):
                        rows.append(row | {"file": path})
                        size += len(row["payload"] or b"") + 500
                        if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                            yield batch()
                            rows, size = [], 0
                except (ValueError, zlib.error) as error:
                    if self.bad == "fail":
                        raise ValueError(f"{path}: {error}") from error
                    mark = dict.fromkeys(SCHEMA_NAMES) | {"record_type": "bad", "headers": {"error": str(error)}, "file": path}
                    if _passes(mark, self.conditions):
                        rows.append(mark)
        if rows:
            yield batch()


SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]

# --- writing ---------------------------------------------------------------------


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member whose extra field ``sl`` tells its whole length and that of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = pack.compress(data) + pack.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: object) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(value)).strip()


def record_bytes(row: dict) -> bytes:
    """One WARC record; responses are wrapped in an HTTP message, revisits have no block."""
    kind, payload = row["record_type"], row.get("payload") or b""
    block, content_type = payload, row.get("content_type") or "application/octet-stream"
    if kind == "response":
        content_type = f"{HTTP}; msgtype=response"
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)) + payload
    elif kind == "revisit":
        block, content_type = b"", f"{HTTP}; msgtype=response"
    digest = row.get("payload_digest")
    if digest and re.fullmatch("[0-9a-f]{40}", digest):
        digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    uri = row.get("target_uri")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id")), ("WARC-Date", row.get("date")),
             ("WARC-Target-URI", uri and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)),
             ("WARC-Payload-Digest", digest), ("WARC-Refers-To", row.get("refers_to")),
             ("WARC-Profile", PROFILE if kind == "revisit" else None), *(row.get("headers") or {}).items(),
             ("Content-Type", content_type), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {_clean(value)}\r\n" for name, value in lines if value is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """One archive per task. Only files named in a manifest, written last, belong to the table."""

    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.path = options["path"]
        self.level = int(options.get("compressionLevel", 6))
        self.date = options.get("date", "2000-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            info = {"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "date": self.date,
                    "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
            out.write(member(record_bytes(info), self.level))
            for batch in iterator:
                for start in range(0, batch.num_rows, 100):
                    for row in batch.slice(start, 100).to_pylist(maps_as_pydicts="lossy"):
                        out.write(member(record_bytes({"date": self.date} | {k: v for k, v in row.items() if v is not None}),
                                         self.level))
        return Written(name)

    def commit(self, messages) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        old = [i.path for i in system.get_file_info(pafs.FileSelector(root))] if self.overwrite else []
        names = [m.name for m in messages if m is not None]
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())
        for path in old:
            name = path.rsplit("/", 1)[1]
            if name not in names and re.search(rf"^{MANIFEST}.*\.json$|\.warc(\.gz)?$", name):
                system.delete_file(path)

    def abort(self, messages) -> None:
        """Unlisted files are never read; those of finished tasks are removed."""
        system, root = _filesystem(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{root}/{message.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options ``path``, ``maxPartitionBytes``, ``onBadFile`` (``fail`` or ``mark``).

    A broken archive fails the scan, or, with ``mark``, ends its file with one row of type ``bad``.
    Rows to be written take the columns ``record_type`` and any of ``record_id, target_uri, date,
    content_type, payload_digest, refers_to, headers, payload``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let its predicates into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: Sequence[str] = (), **options: str) -> DataFrame:
    """Records below ``path``. With ``columns``, nothing else is parsed into rows; leave ``payload`` out to skip all blocks."""
    register(spark)
    kinds = dict(zip(SCHEMA_NAMES, SCHEMA.split(", "), strict=True))
    wanted = ", ".join(kinds[c] for c in columns or SCHEMA_NAMES)
    return spark.read.format("warc").schema(wanted).options(**options).load(path)


# --- pages to archives and back -----------------------------------------------------


def _record_id(key: str, digest: str) -> str:
    """A record's URI from its page and payload, so that a revisit can name its response without seeing it."""
    raw = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(digest)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(raw, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                 least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages as records to be written: equal payloads of ``least`` bytes or more are stored once.

    The page with the largest key keeps the payload, the others become revisits of it. NULL html is an
    empty payload, a NULL url leaves the header out. Rows that repeat the largest key and payload are all
    responses; NULL keys revisit a keyed page and are responses where there is none. Payloads
    are equal when length and SHA-1 are. Groups are found by a combining aggregate and joined
    with a skew-tolerant lookup, so that copies of one page may be a third of all rows.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"_digest": F.sha1("payload"), "_n": F.octet_length("payload").cast("long")})
    again = (rows.where(F.col("_n") >= least).groupBy("_digest", "_n").agg(F.max("_key").alias("_last"), F.count("*").alias("_copies"))
             .where("_copies > 1 and _last is not null").drop("_copies"))
    rows = lookup(rows, again, ["_digest", "_n"])
    revisit = F.col("_last").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_last"))
    headers = F.map_filter(F.map_from_arrays(
        F.array(F.lit("X-Page-ID"), F.lit("X-Payload-Length"), F.lit("X-Refers-To-Page-ID")),
        F.array(F.col("_key").cast("string"), F.col("_n").cast("string"), F.when(revisit, F.col("_last").cast("string")))),
        lambda k, v: v.isNotNull())
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id("_key", "_digest").alias("record_id"),
        F.col("_url").alias("target_uri"), F.col("_digest").alias("payload_digest"),
        F.when(revisit, _record_id("_last", "_digest")).alias("refers_to"), headers.alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Archives of ``rows`` below ``path``, one gzip member per record."""
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).options(**options).save(path)


def archived_pages(archives: DataFrame) -> DataFrame:
    """Page, length and digest of the full payload, record type and the page that a revisit refers to.

    Length and digest of responses are computed from the payload that was read; revisits tell theirs in the header.
    """
    pages = archives.where(F.col("record_type").isin("response", "revisit"))
    stored = F.col("record_type") == "response"
    return pages.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"))


def payload_digest(payload: bytes) -> str:
    """Bare lower-case hex SHA-1, as stored and compared."""
    return hashlib.sha1(payload, usedforsecurity=False).hexdigest()


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, read back."""
    path = scratch(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return archived_pages(read_warc(spark, path, ["record_type", "payload_digest", "headers", "payload"]))


SQL = """with p as (select page_id, coalesce(html, '') as h from pages),
m as (select h, max(page_id) as last from p where strlen(h) >= 1000 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
  case when last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when last is not null and page_id is distinct from last then last end as refers_to
from p left join m on p.h = m.h"""
