"""WARC files as a Spark data source, to read and to write.

Reading: files are planned into partitions of at most ``partitionBytes``, and so many that each of ``parallelism`` tasks has
some (a file is never split, as a record boundary inside could only be guessed: a block may hold whole WARC records). Predicates on the record's type, URI, length, dates and the other header columns are pushed down. For
each record the headers are parsed first; the block of a record that the predicates reject is skipped unread, by its
length in plain files and by the skip length of the standard's Annex D in compressed ones (or inflated and thrown away
where a writer gave none). HTTP headers and bodies are decoded only if a requested column needs them.

Writing: rows of the same columns become one gzip member each. A task writes files under a temporary name of its own;
the commit on the driver renames those of the successful tasks, so a task that runs twice leaves no copy. ``overwrite``
then deletes the WARC files that were there before.

Defined results: a NULL header column is a header that is not written, and a missing header is read as NULL. A NULL
block is an empty one; an empty payload is read as empty, not NULL. A record that is cut short, text that is no record, and
headers of more than ``MOST_HEADERS`` bytes are errors; with ``mode=skip`` reading goes on at the next gzip member or plain
record. A very long block is read whole if it is asked for. Repeated records are all read, in any order. A
folder without files, or only empty ones, has no rows. Extra headers are in ``headers``, with lower-case names; of a
repeated name the last counts.
"""

from __future__ import annotations

import gzip
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, type string, date string, target_uri string, content_type string, content_length long, headers map<string,string>, "
    "http_status int, http_headers map<string,string>, payload binary, file string, offset long"
)
ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
    ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])
#: Columns that need a record's block; the others come from its headers.
BLOCK_COLUMNS = {"http_status", "http_headers", "payload"}
HEADER_COLUMNS = {"record_id": "warc-record-id", "type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type"}
BATCH_BYTES = 8 << 20


def _fields(block: bytes) -> dict[str, str]:
    """Header lines, with folded ones joined."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if name and line[:1] in (" ", "\t"):
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _value(row: dict[str, Any], f: Filter) -> Any:
    return row.get(f.attribute[0])


def accepts(row: dict[str, Any], f: Filter) -> bool:
    """Whether a record's header columns pass a filter; a comparison with NULL does not."""
    if isinstance(f, Not):
        return (_value(row, f.child) is not None or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe))) and not accepts(row, f.child)
    v = _value(row, f)
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return v.endswith(f.value)
    if isinstance(f, StringContains):
        return f.value in v
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    if isinstance(f, LessThan):
        return v < f.value
    return v <= f.value


def _can(f: Filter) -> bool:
    """Whether a filter can be decided by the headers of a record alone."""
    if isinstance(f, Not):
        return not isinstance(f.child, Not) and _can(f.child)
    kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
    if not isinstance(f, kinds) or len(f.attribute) != 1 or f.attribute[0] not in (*HEADER_COLUMNS, "content_length"):
        return False
    if isinstance(f, In):
        return all(v is not None for v in f.value)
    return isinstance(f, (IsNull, IsNotNull)) or f.value is not None


class _Plain:
    """A block inside an uncompressed file."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def skip(self, n: int) -> None:
        self.stream.seek(n, 1)


class _Inflating:
    """A gzip member of a file, inflated as far as it is read."""

    CHUNK = 1 << 16

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.z, self.out = stream, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.stream.read(self.CHUNK)
        if not data:
            return False
        self.out += self.z.decompress(data, self.CHUNK * 4)
        return True

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n and (self.out or self._more()):
            part, self.out = self.out[: n - have], self.out[n - have :]
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def line_end(self, mark: bytes, most: int) -> bytes | None:
        while mark not in self.out and len(self.out) < most and self._more():
            pass
        at = self.out.find(mark)
        if at < 0:
            return None
        head, self.out = self.out[: at + len(mark)], self.out[at + len(mark) :]
        return head

    def skip(self, n: int) -> None:
        while n > 0 and (self.out or self._more()):
            n, self.out = n - min(n, len(self.out)), self.out[n:]
        if n > 0:
            raise EOFError("a compressed record is cut short")

    def finish(self) -> bool:
        """Past the blank lines that close a record. Whether the member ends there; then the file stands behind it."""
        while True:
            self.out = self.out.lstrip(b"\r\n")
            if self.out:
                return False
            if self.z.eof:
                break
            if not self._more():
                raise EOFError("a compressed record is cut short")
        back = len(self.z.unused_data)
        if back:
            self.stream.seek(-back, 1)
        return True


def _skip_length(head: bytes) -> int:
    """The compressed length of a gzip member by its ``sl`` subfield, 0 without."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return 0
    size = struct.unpack("<H", head[10:12])[0]
    at, extra = 0, head[12 : 12 + size]
    while at + 4 <= len(extra):
        name, n = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if name == b"sl" and n == 8:
            return struct.unpack("<I", extra[at + 4 : at + 8])[0]
        at += 4 + n
    return 0


MOST_HEADERS = 1 << 20


def _next_record(stream: BinaryIO, at: int, end: int) -> int | None:
    """Where the next gzip member with a record, or plain record, begins behind a damaged one."""
    size, kept = 1 << 20, b""
    stream.seek(at + 1)
    base = at + 1
    while base < end:
        data = stream.read(size)
        if not data:
            return None
        window, start = kept + data, base - len(kept)
        for m in re.finditer(rb"\x1f\x8b\x08|\nWARC/1\.[01]\r\n", window):
            place = start + m.start()
            if m[0][:1] == b"\n":
                return place + 1
            stream.seek(place)
            try:
                if zlib.decompressobj(31).decompress(stream.read(1 << 12), 16).startswith(b"WARC/"):
                    return place
            except zlib.error:
                continue
        base += len(data)
        kept = window[-16:]
        stream.seek(base)
    return None


def _http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and decoded body of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    first, _, rest = head.partition(b"\n")
    parts = first.split(None, 2)
    status = int(parts[1]) if len(parts) > 1 and parts[0].startswith(b"HTTP/") and parts[1].isdigit() else None
    headers = _fields(rest)
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(out) if out else body
    if headers.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # some crawlers store the body decoded and keep the header
    return status, headers, body


def records(stream: BinaryIO, name: str, filters: list[Filter], columns: set[str], strict: bool = True) -> Iterator[dict[str, Any]]:
    """The records of an open file that pass, with the columns asked for."""
    need = columns & BLOCK_COLUMNS
    end = stream.seek(0, 2)
    stream.seek(0)
    member: _Inflating | None = None  # that holds more records
    at = 0
    while member or (at := stream.tell()) < end:
        peek = b""
        if not member:
            peek = stream.read(28)
            stream.seek(at)
        try:
            if member or peek[:2] == b"\x1f\x8b":
                source: Any = member or _Inflating(stream)
                head = source.line_end(b"\r\n\r\n", MOST_HEADERS)
            else:
                lead = 0
                while lead < len(peek) and peek[lead : lead + 1] in (b"\r", b"\n"):
                    lead += 1
                if lead:
                    stream.seek(at + lead)
                    continue
                source, head = _Plain(stream), b""
                while not head.endswith(b"\r\n\r\n"):
                    line = stream.readline(MOST_HEADERS)
                    head += line
                    if not line or len(head) > MOST_HEADERS:
                        head = None
                        break
            if not head or not head.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {at} of {name}")
            headers = _fields(head.partition(b"\n")[2])
            length = int(headers.get("content-length", "0"))
            row: dict[str, Any] = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()} | {"content_length": length}
            ok = all(accepts(row, f) for f in filters)
            block = source.read(length) if ok and need else None
            if block is not None and len(block) < length:
                raise EOFError(f"the record at byte {at} of {name} is cut short")
            if isinstance(source, _Plain):
                if block is None:
                    if stream.tell() + length > end:
                        raise EOFError(f"the record at byte {at} of {name} is cut short")
                    source.skip(length)
            elif (skip := _skip_length(peek)) and at + skip <= end:
                stream.seek(at + skip)
            else:
                if block is None:
                    source.skip(length)
                member = None if source.finish() else source
        except (ValueError, EOFError, zlib.error):
            if strict:
                raise
            member, again = None, _next_record(stream, at, end)
            if again is None:
                return
            stream.seek(again)
            continue
        if ok:
            row |= {"headers": list(headers.items()), "file": name, "offset": at}
            if block is not None:
                if "http" in (row["content_type"] or ""):
                    row["http_status"], http, row["payload"] = _http(block)
                    row["http_headers"] = list(http.items())
                else:
                    row["payload"] = block
            yield {c: row.get(c) for c in columns}


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 256 << 20)))
        self.parallelism = int(options.get("parallelism", 8))
        self.columns = set(filter(None, options.get("columns", "").split(","))) or set(ARROW.names)
        self.strict = options.get("mode", "fail") != "skip"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _can(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files = sorted((f.size, f.path) for f in found if f.is_file and f.size and f.base_name[0] not in "._" and f.base_name.endswith((".warc", ".warc.gz")))
        plan: list[Files] = []
        most = min(self.bytes, -(-sum(n for n, _ in files) // self.parallelism))
        size = 0
        for n, name in reversed(files):  # the largest begin first
            if plan and size + n <= most:
                plan[-1].paths.append(name)
                size += n
            else:
                plan.append(Files([name]))
                size = n
        return plan

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        rows, size = [], 0
        for name in partition.paths if partition else []:
            with fs.open_input_file(name) as stream:
                for row in records(stream, name, self.filters, self.columns, self.strict):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member with its skip lengths."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    plain = b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(plain) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32:
        return gzip.compress(plain, level)
    extra = b"sl" + struct.pack("<HII", 8, total, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 4))
        self.roll = int(options.get("filebytes", options.get("fileBytes", 1 << 30)))
        self.job = uuid.uuid4().hex[:12]

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        fs, path = self._fs()
        fs.create_dir(path, recursive=True)
        files: list[tuple[str, str]] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > self.roll:
                    if out:
                        out.close()
                    final = f"{path}/part-{part:05d}-{len(files):03d}-{self.job}.warc.gz"
                    files.append((f"{path}/_{part:05d}-{len(files):03d}-{attempt}-{uuid.uuid4().hex[:8]}", final))
                    out = fs.open_output_stream(files[-1][0], compression=None)
                headers = [(h.title().replace("Warc", "WARC").replace("Uri", "URI").replace("Id", "ID"), row[c]) for c, h in HEADER_COLUMNS.items() if row.get(c) is not None]
                known = {*HEADER_COLUMNS.values(), "content-length"}
                headers += [(k, v) for k, v in row.get("headers") or [] if k.lower() not in known and v is not None]
                out.write(member([(k, v.replace("\r", " ").replace("\n", " ")) for k, v in headers], row.get("payload") or b"", self.level))
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = self._fs()
        fs.create_dir(path, recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))] if self.overwrite else []
        for m in messages:
            for temporary, final in m.files if m else []:
                fs.move(temporary, final)
        for old in before:
            fs.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = self._fs()
        for m in messages:
            for temporary, _ in m.files if m else []:
                fs.delete_file(temporary)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Records of the WARC files under ``path``; only ``columns`` are decoded. Filter the result by header columns and
    the filters go down to the reader."""
    register(spark)
    reader = spark.read.format("warc").option("parallelism", spark.sparkContext.defaultParallelism)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    df = reader.options(**options).load(path)
    return df.select(*columns) if columns else df


def write_warc(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Writes rows with some of the columns of the source, ``payload`` being the whole block."""
    register(df.sparkSession)
    have = set(df.columns)
    plain = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA).fields]
    df.select(*plain).write.format("warc").mode(mode).options(**options).save(path)


def pages_as_records(pages: DataFrame) -> DataFrame:
    """A request and a response record for each web page; ``x-page-id`` names the page."""
    key = F.sha2(F.concat_ws("\0", F.col("page_id").cast("string"), "url", "html"), 256)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")).cast("binary")
    response = F.concat(F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    kinds = F.array(F.struct(F.lit("request").alias("type"), request.alias("payload")), F.struct(F.lit("response").alias("type"), response.alias("payload")))
    row = pages.select("page_id", F.col("url").alias("target_uri"), key.alias("key"), F.col("html").isNull().alias("none"), F.explode(kinds).alias("r"))
    headers = F.map_from_arrays(F.array(F.lit("x-page-id"), F.lit("x-no-html")), F.array(F.col("page_id").cast("string"), F.col("none").cast("string")))
    return row.select(
        F.concat(F.lit("<urn:sha256:"), "key", F.lit("-"), "r.type", F.lit(">")).alias("record_id"), F.col("r.type").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("date"), "target_uri",
        F.concat(F.lit("application/http; msgtype="), "r.type").alias("content_type"), headers.alias("headers"), "r.payload",
    )


def pages_from_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, http_status, n_bytes, html of the response records under ``path``; requests are never decoded."""
    df = read_warc(spark, path, ["type", "target_uri", "headers", "http_status", "payload"]).filter("type = 'response'")
    html = F.when(F.col("headers")["x-no-html"] != "true", F.col("payload").cast("string"))
    return df.select(F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), "http_status", F.octet_length(html).cast("long").alias("n_bytes"), html.alias("html"))
