"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files. A record's header is parsed first;
pushed filters on header columns (record type, URI, digest, date, length ...)
decide before anything else is touched, HTTP headers are parsed only if a column
asks for them, and a payload is read and decoded only if the schema has it.
Plain files are skipped by their lengths. In ``.gz`` files each record is a
member of its own; members written here carry both their lengths (extra field
SL), so an unwanted payload is not even inflated. Foreign members without
lengths, or with several records, are inflated to their end.

Writing (``Writer``): a task writes hidden files of at most ``max_bytes``; the
commit shows those of the tasks that count, so a lost or repeated task leaves
nothing to be read. ``pages_to_records`` finds the copies: of equal payloads
the record with the smallest id is the response, others revisit it, which is
decided by digests alone; a revisit keeps its HTTP headers and no payload.

Defined results: a null payload is empty; null ids rank last and have no
reference; of repeated rows (id and payload) one is the response; a null URI is
no header; an empty table gives archives without pages. A file that ends inside
a record is an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .shared import new_dir, open_files, stored

#: Columns of the record's own header, by the name of their field (fixed values of the format).
FIELDS = {"record_id": "warc-record-id", "warc_type": "warc-type", "warc_date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "content_length": "content-length", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = "record_id string, warc_type string, warc_date string, target_uri string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, http_status int, payload_bytes long, payload binary, file string, offset long"
HTTP, BODY = ("http_status", "payload_bytes"), "payload"
WINDOW = 1 << 20


# --- bytes of a file ---------------------------------------------------------------------------------------------------


class Plain:
    """The bytes of a file, read through a window; what is skipped beyond the window is not read."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at = source, size, 0
        self._window, self._begin = b"", 0
        self.out = bytearray()

    def raw(self, n: int) -> bytes:
        """Up to n bytes of the file from ``at`` on."""
        k = self.at - self._begin
        if not 0 <= k < len(self._window):
            self.source.seek(self.at)
            self._begin, self._window, k = self.at, self.source.read(min(WINDOW, self.size - self.at)), 0
        part = self._window[k : k + n]
        self.at += len(part)
        return part

    def more(self) -> bool:
        part = self.raw(8192)
        self.out += part
        return bool(part)

    def until(self, end: bytes, most: int | None = None) -> bytes:
        """What comes up to ``end`` and with it; less at the end of the file or after ``most`` bytes."""
        seen = 0
        while (k := self.out.find(end, max(seen - len(end), 0))) < 0:
            seen = len(self.out)
            if (most is not None and seen >= most) or not self.more():
                return self.take(seen if most is None else min(seen, most))
        return self.take(k + len(end) if most is None else min(k + len(end), most))

    def take(self, n: int) -> bytes:
        while len(self.out) < n and self.more():
            pass
        part = bytes(self.out[:n])
        del self.out[:n]
        return part

    def skip(self, n: int) -> int:
        """Leave n bytes; how many there were."""
        k = min(n, len(self.out))
        del self.out[:k]
        rest = min(n - k, self.size - self.at)
        self.at += rest
        return k + rest

    def place(self) -> int:
        return self.at - len(self.out)


class Members(Plain):
    """The inflated bytes of a file of gzip members. A member that says its lengths is left without being inflated to its end."""

    engine = None
    member = end = whole = given = 0

    def more(self) -> bool:
        if self.engine is None:
            if self.at >= self.size:
                return False
            self.member, self.whole, self.given = self.at, 0, 0
            head = self.raw(24)
            if head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"SL\x08\x00" and len(head) == 24:
                packed, self.whole = struct.unpack("<II", head[16:24])
                self.end = self.member + packed
            self.at, self.engine = self.member, zlib.decompressobj(31)
        part = self.raw(4096 if not self.given else 65536)
        if not part:
            raise ValueError("a gzip member ends early")
        data = self.engine.decompress(part)
        self.given += len(data)
        self.out += data
        if self.engine.eof:
            self.at -= len(self.engine.unused_data)
            self.engine = None
        return True

    def skip(self, n: int) -> int:
        done = min(n, len(self.out))
        del self.out[:done]
        while done < n:
            if self.engine is not None and self.whole and self.given + n - done == self.whole:
                self.at, self.engine = self.end, None
                return n
            if not self.more():
                break
            k = min(n - done, len(self.out))
            del self.out[:k]
            done += k
        return done

    def place(self) -> int:
        return self.member


# --- reading -----------------------------------------------------------------------------------------------------------


@dataclass
class Files(ds.InputPartition):
    """Whole files that one task reads, with their sizes."""

    files: list

    def __init__(self, files: list):
        super().__init__(files)
        self.files = files


def parse_fields(head: bytes) -> dict[str, str]:
    """Header lines as fields by lower-case name; a folded line belongs to the one before it."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _compare(f: ds.Filter, value: object) -> bool | None:
    """A filter of one column as SQL has it: null for a null value, but for the null tests."""
    if isinstance(f, ds.Not):
        inner = _compare(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None or (not isinstance(f, ds.In) and f.value is None):
        return None
    if isinstance(f, ds.In):
        return True if value in f.value else None if None in f.value else False
    return {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a}[type(f)](value, f.value)


def _column_of(f: ds.Filter) -> str | None:
    """The one header column that a filter names, if it is of a kind that is known here."""
    if isinstance(f, ds.Not):
        return _column_of(f.child)
    known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    return f.attribute[0] if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in FIELDS else None


def decoded(http: dict[str, str], body: bytes) -> bytes:
    """A body without its transfer and content encodings (chunked, gzip, deflate); others stay as they are."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
            out.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(out)
    kind = http.get("content-encoding", "").lower()
    return zlib.decompress(body, 47) if kind in ("gzip", "x-gzip", "deflate") and body else body


class Reader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options, self.filters = schema, dict(options), []

    def pushFilters(self, filters):
        for f in filters:
            if _column_of(f) is None:
                yield f
            else:
                self.filters.append((_column_of(f), f))

    def partitions(self) -> list[Files]:
        """Files in order of their names, joined until a partition has ``split_bytes``; a larger file is one by itself."""
        import pyarrow.fs as fs

        files, path = open_files(self.options["path"])
        found = files.get_file_info([path])[0]
        found = [found] if found.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
        seen = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"^[^._].*\.warc(\.gz)?$", f.base_name))
        total = sum(size for _, size in seen)
        most = int(self.options.get("split_bytes") or min(128 << 20, max(4 << 20, total // 256)))
        out, held = [], 0
        for path, size in seen:
            if not out or held + size > most:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += size
        return [Files(x) for x in out or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, kinds = self.schema.names, to_arrow_schema(self.schema)
        rows, held = [], 0
        for values in self._records(partition):
            rows.append(values)
            held += 512 + len(values.get(BODY) or b"")
            if held >= 8 << 20:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], kinds)

    def _records(self, partition: Files) -> Iterator[dict]:
        files, _ = open_files(self.options["path"])
        for path, size in partition.files:
            with files.open_input_file(path) as source:
                bytes_of = (Members if path.endswith(".gz") else Plain)(source, size)
                try:
                    yield from self._file(bytes_of, path)
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}, near byte {bytes_of.place()}: {e}") from e

    def _file(self, data: Plain, path: str) -> Iterator[dict]:
        wanted = set(self.schema.names)
        while True:
            while data.out[:2] == b"\r\n":  # blank lines between records
                data.skip(2)
            if not data.out and not data.more():
                return
            if data.out[:1] in (b"\r", b""):
                if not data.more() and not data.out.strip():
                    return
                continue
            place, head = data.place(), data.until(b"\r\n\r\n")
            fields = parse_fields(head)
            if not head.startswith(b"WARC/") or not head.endswith(b"\r\n\r\n") or not fields.get("content-length", "").isdigit():
                raise ValueError("no record header")
            row = {c: fields.get(f) for c, f in FIELDS.items()}
            length = row["content_length"] = int(row["content_length"])
            left = length
            if all(_compare(f, row[c]) is True for c, f in self.filters):
                row |= {"file": path, "offset": place}
                if "headers" in wanted:
                    row["headers"] = fields
                if wanted & {*HTTP, BODY}:
                    http, inner = {}, b""
                    if (row["content_type"] or "").startswith("application/http"):
                        inner = data.until(b"\r\n\r\n", left)
                        http = parse_fields(inner)
                        status = re.match(rb"HTTP/\S+ (\d{3})", inner)
                        row["http_status"] = int(status[1]) if status else None
                    left -= len(inner)
                    said = http.get("content-length", "")
                    row["payload_bytes"] = int(said) if said.isdigit() else left
                    if BODY in wanted and (left or row["warc_type"] != "revisit"):
                        body = data.take(left)
                        if len(body) < left:
                            raise ValueError("a record ends early")
                        left, row[BODY] = 0, decoded(http, body)
                yield row
            if data.skip(left + 4) < left:  # the two ends of line are part of a record
                raise ValueError("a record ends early")


# --- writing -----------------------------------------------------------------------------------------------------------


@dataclass
class Written(ds.WriterCommitMessage):
    """The hidden files of one task."""

    files: list


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A value of one line: control characters and blanks at the ends would end the field or change it."""
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(row: dict, date: str) -> bytes:
    """One record: a page's as an HTTP response, of which a revisit keeps the headers alone."""
    payload, kind = row.get("payload") or b"", row.get("warc_type") or "resource"
    block, content = payload, row.get("content_type") or "application/octet-stream"
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: {_line(content)}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block, content = http + (payload if kind == "response" else b""), "application/http; msgtype=response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("warc_date") or date), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to"))]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    if kind != "warcinfo":
        fields.append(("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)))
    fields += [("Content-Type", content), ("Content-Length", len(block))]
    head = "".join(f"{name}: {_line(value)}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with its packed and whole lengths in the extra field SL, if they fit it."""
    engine = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = engine.compress(data) + engine.flush()
    total, tail = 10 + 14 + len(packed) + 8, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(total, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + packed + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"SL\x08\x00" + struct.pack("<II", total, len(data)) + packed + tail


class Writer(ds.DataSourceArrowWriter):
    """Options: compression (gzip or none), level, max_bytes of a file, date of records that have none."""

    def __init__(self, schema, options, overwrite: bool):
        self.schema, self.options, self.overwrite = schema, dict(options), overwrite
        self.packed = self.options.get("compression", "gzip") != "none"

    def write(self, iterator) -> Written:
        import datetime

        files, path = open_files(self.options["path"])
        files.create_dir(path, recursive=True)
        most, level = int(self.options.get("max_bytes", 256 << 20)), int(self.options.get("level", 3))
        date = self.options.get("date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out = [], None
        form = (lambda data: member(data, level)) if self.packed else (lambda data: data)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is not None and out.tell() >= most:
                        out.close()
                        out = None
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.packed else "")
                        names.append(name)
                        out = files.open_output_stream(f"{path}/.{name}", compression=None)  # it is packed by record
                        out.write(form(record({"warc_type": "warcinfo", "content_type": "application/warc-fields", "payload": f"format: WARC file version 1.1\r\nfilename: {name}\r\n".encode()}, date)))
                    out.write(form(record(row, date)))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        import pyarrow.fs as fs

        files, path = open_files(self.options["path"])
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path, recursive=True)):
                if f.is_file and re.search(r"^[^._].*\.warc(\.gz)?$", f.base_name):
                    files.delete_file(f.path)
        for name in (name for m in messages if m for name in m.files):
            files.move(f"{path}/.{name}", f"{path}/{name}")

    def abort(self, messages) -> None:
        files, path = open_files(self.options["path"])
        for name in (name for m in messages if m for name in m.files):
            files.delete_file(f"{path}/.{name}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """Records of a file or folder; ``columns``, a part of SCHEMA, says what is parsed and read at all."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


# --- pages -------------------------------------------------------------------------------------------------------------

URN = "<urn:lodestone:page:"


def pages_to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Pages as records: of equal payloads of at least ``least`` bytes all but the first revisit it.

    Only digests are grouped, and only repeated ones are joined back: a table that the planner broadcasts if it is small and
    otherwise joins by digest. A row is known by its place in the scan, so ``pages`` must be a plain table.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    named = lambda c: F.concat(F.lit(URN), F.url_encode(c.cast("string")), F.lit(">"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("digest", "first"), "copies")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return rows.join(groups, "digest", "left").select(
        F.coalesce(named(F.col("id")), F.lit(f"{URN}>")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri",
        F.lit("text/html; charset=utf-8").alias("content_type"), F.when(revisit, named(F.col("first.id"))).alias("refers_to"), "payload",
    )


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, **options) -> None:
    """Write a record a page into archives at ``path``."""
    register(pages.sparkSession)
    pages_to_records(pages, id_col, url_col, html_col, least).write.format("warc").mode("append").options(**options).save(path)


def page_digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages in archives, from headers alone."""
    rows = read(spark, path, "record_id string, warc_type string, payload_digest string, refers_to string, payload_bytes long").where("warc_type IN ('response', 'revisit')")
    own = lambda c: F.nullif(F.url_decode(F.regexp_extract(c, URN + "(.*)>", 1)), F.lit("")).cast(id_type)
    return rows.select(own("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), own("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_dir(spark, "warc")
    archive(pages, path, id_col, least=least)
    return page_digests(spark, path, pages.schema[id_col].dataType.simpleString())


_LETTERS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {0}) & 31 AS INTEGER) + 1, 1)"
PAGES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT *, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)), lambda v: {" || ".join(_LETTERS.format(s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
 CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""
