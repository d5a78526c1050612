"""WARC archives as a PySpark Python data source (operator 10).

``spark.read.format("skein_warc").load(folder)`` plans archive files as partitions, takes predicates on the record type
and on header fields from Spark's filter push-down (or from options), parses a record's header first, and
skips the payload of every record that the predicates reject, or all payloads with option ``payload=false``. Records
are gzip members of their own; the writer notes a member's length in its gzip header, so a skipped payload is
neither inflated nor, beyond its first block, read.

``df.write.format("skein_warc").mode("append").save(folder)`` writes archives of about ``ROTATE`` bytes. A task's files count
only once the driver has named them in a manifest, so lost and repeated tasks leave no records behind.

``archive`` stores one record per row, equal payloads once: of records whose payloads are equal and have at least
``min_bytes`` bytes, the one with the largest id is a response and the others are revisits that refer to it.

Null payloads count as empty, null URLs leave the target header out. Rows with a null id are revisits of the largest id
among their equals, and responses if there is none; rows that repeat the largest id are responses. Response ids derive from the archive and the page, so rows that repeat an id repeat the record id. Other columns are
ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from skein.session import discard, materialize, shared_dir

FORMAT = "skein_warc"
#: Bytes after which a task begins another archive file.
ROTATE = 64 << 20
_MANIFEST = "_manifest-"
#: Columns that are header fields, by header name. Fixed values of the WARC standard, then two of our own.
HEADERS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "date",
    "WARC-Payload-Digest": "payload_digest",
    "X-Page-Id": "page_id",
    "X-Payload-Length": "payload_length",
    "X-Refers-To-Page": "refers_to",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, page_id long, payload_length long, refers_to long, content_type string, payload binary"
_ARROW = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "payload_digest")] + [(c, pa.int64()) for c in ("page_id", "payload_length", "refers_to")] + [("content_type", pa.string()), ("payload", pa.binary())])
_NUMBERS = {"page_id", "payload_length", "refers_to"}
_FILTERED = frozenset(HEADERS.values()) | {"content_type"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, and file:///x alike."""
    return f"file:///{path[5:].lstrip('/')}" if path.startswith("file:") else path


_ODD = re.compile(r"[%\s]")


def _line(value: str) -> tuple[str, bool]:
    """A header value, and whether it had to be escaped: line ends or outer spaces wouldn't come back."""
    odd = value != value.strip() or "\r" in value or "\n" in value
    return (_ODD.sub(lambda m: quote(m[0], safe=""), value) if odd else value), odd


def record_id(archive_name: str, page_id: int) -> str:
    """The record id of a page's response in an archive, which its revisits name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive_name}/{page_id}')}>"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds the member's own length and that of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 12 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if size >> 32:  # the field can't hold it: readers find the end by inflating
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, size, len(data) & 0xFFFFFFFF) + body + tail


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, refers_to: int | None, date: str = _DATE, payload_digest: str | None = None, archive_name: str = "", refers_url: str | None = None) -> bytes:
    """One WARC record, without compression."""
    block = b"" if kind == "revisit" else _HTTP % len(payload) + payload
    name = record_id(archive_name, page_id) if kind != "revisit" and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    for field, value in (("WARC-Target-URI", url), ("WARC-Refers-To-Target-URI", refers_url)):
        if value is not None:
            text, odd = _line(value)
            head += [(field, text), *([("X-Escaped", field)] if odd else [])]
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest or digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    head += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if kind == "revisit":
        head += [("WARC-Profile", _REVISIT)]
        head += [("WARC-Refers-To", record_id(archive_name, refers_to)), ("X-Refers-To-Page", str(refers_to))] if refers_to is not None else []
    head += [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Members:
    """The records of one file: headers first, the block only on demand."""

    FIRST = 4096

    def __init__(self, stream, start: int, end: int):
        self.stream, self.at, self.end = stream, start, end

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        while self.at < self.end:
            self.stream.seek(self.at)
            head = self.stream.read(self.FIRST)
            if head[:2] == b"\x1f\x8b":
                yield from self._zipped(head)
            elif head.startswith(b"WARC/"):
                yield from self._plain(head)
            elif head[:1] in (b"\r", b"\n"):
                self.at += len(head) - len(head.lstrip(b"\r\n"))
            else:
                raise ValueError(f"no WARC record at byte {self.at}")

    def _zipped(self, head: bytes):
        start, size = self.at, 0
        if head[3] & 4 and head[12:14] == b"sl":
            size = struct.unpack_from("<I", head, 16)[0]
        unzip = zlib.decompressobj(31)
        data, raw = b"", head
        while b"\r\n\r\n" not in data and not unzip.eof:
            data += unzip.decompress(raw, 1 << 14)
            raw = unzip.unconsumed_tail
            if not raw and not unzip.eof and not (raw := self.stream.read(self.FIRST)):
                raise ValueError(f"the record at byte {start} ends too soon")
        cut = data.index(b"\r\n\r\n") + 4
        rest = [data[cut:]]

        def block() -> bytes:
            more = raw
            while not unzip.eof:
                if not more and not (more := self.stream.read(max(self.FIRST, start + size - self.stream.tell()) if size else 1 << 16)):
                    raise ValueError(f"the record at byte {start} ends too soon")
                rest.append(unzip.decompress(more))
                more = b""
            rest[:] = [b"".join(rest)]
            return rest[0]

        yield _fields(data[:cut]), block
        if size:
            self.at = start + size
        else:  # another writer's member: only inflating it finds its end
            block()
            self.at = self.stream.tell() - len(unzip.unused_data)

    def _plain(self, head: bytes):
        while (cut := head.find(b"\r\n\r\n")) < 0:
            head += (more := self.stream.read(self.FIRST))
            if not more:
                raise ValueError(f"the header at byte {self.at} ends too soon")
        fields, begin = _fields(head[: cut + 4]), self.at + cut + 4

        def block() -> bytes:
            self.stream.seek(begin)
            return self.stream.read(int(fields.get("Content-Length", 0)))

        yield fields, block
        self.at = begin + int(fields.get("Content-Length", 0))


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon and name.strip() == "X-Escaped":
            out[value.strip()] = unquote(out.get(value.strip(), ""))
        elif colon:
            out[name.strip()] = value.strip()
    return out


def _row(fields: dict[str, str]) -> dict:
    row: dict = dict.fromkeys(_ARROW.names)
    for name, column in HEADERS.items():
        if (value := fields.get(name)) is not None:
            row[column] = int(value) if column in _NUMBERS else value
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["content_type"] = fields.get("Content-Type")
    return row


def _payload(fields: dict[str, str], block: bytes) -> bytes | None:
    if fields.get("WARC-Type") == "revisit":
        return None
    block = block[: int(fields.get("Content-Length", len(block)))]
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _uri(options["path"])
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}
        if types := options.get("types"):
            self.wanted["record_type"] = set(types.split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in _FILTERED:
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _fs(self.folder)
        found = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root)) if f.is_file}
        named = [p for p in found if p.rpartition("/")[2].startswith(_MANIFEST)]
        files = {f"{root}/{name}": size for p in named for name, size in json.loads(store.open_input_stream(p).read())}
        if not named:
            files = {p: n for p, n in found.items() if p.endswith((".warc", ".warc.gz"))}
        return [_File(p, n) for p, n in sorted(files.items())]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _fs(self.folder)
        rows: list[dict] = []
        held = 0
        with store.open_input_file(partition.path) as stream:
            for fields, block in _Members(stream, 0, partition.size):
                row = _row(fields)
                if any(row[c] not in ok for c, ok in self.wanted.items()):
                    continue
                if self.payload and row["record_type"] != "revisit":
                    row["payload"] = _payload(fields, block())
                    held += len(row["payload"])
                rows.append(row)
                if len(rows) >= 4096 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Done(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Takes (page_id, url, record_type, refers_to, refers_url, digest, payload) rows."""

    def __init__(self, options: dict):
        self.folder = _uri(options["path"])
        self.rotate = int(options.get("rotate", ROTATE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _fs(self.folder)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                columns = (batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "refers_url", "payload_digest", "payload"))
                for page_id, url, kind, refers_to, refers_url, own, payload in zip(*columns, strict=True):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    made = record(page_id.as_py(), url.as_py(), kind.as_py(), payload.as_py() or b"", refers_to.as_py(), payload_digest=own.as_py(), archive_name=root, refers_url=refers_url.as_py())
                    member = gzip_member(made)
                    out.write(member)
                    size += len(member)
                    if size >= self.rotate:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return _Done(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _fs(self.folder)
        store.create_dir(root, recursive=True)
        named = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(named).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _fs(self.folder)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to; use mode('append')")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row of ``df`` to archives in ``folder``."""
    register(df.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    marked = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    equals = marked.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("largest"), F.max_by("url", "page_id").alias("their_url"), F.count(F.lit(1)).alias("n"))
    # only digests that occur twice are joined; their table is written first, so that its true size decides how
    repeated = materialize(equals.where("n > 1 and largest is not null").select(F.col("sha").alias("k"), F.col("bytes").alias("b"), "largest", "their_url"), "repeated")
    named = marked.join(repeated, (F.col("sha") == F.col("k")) & (F.col("bytes") == F.col("b")), "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    named.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("largest")).alias("refers_to"),
        F.when(again, F.col("their_url")).alias("refers_url"),
        F.lit(None).cast("string").alias("payload_digest"),
        "payload",
    ).write.format(FORMAT).mode("append").save(folder)
    discard(repeated)


def read_archive(spark: SparkSession, folder: str, payload: bool = True, types: tuple[str, ...] = ()) -> DataFrame:
    """The records of the archives in ``folder``; filters on header columns are pushed into the reader."""
    register(spark)
    reader = spark.read.format(FORMAT).option("payload", str(payload).lower())
    return (reader.option("types", ",".join(types)) if types else reader).load(folder)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``df`` to new archives in the shared folder and return what the records say when read back.

    A response's length and digest come from its payload as read, a revisit's from its header. The record type is pushed into the
    reader: one pass decodes the payloads of responses only, the other reads the headers of revisits and no payload.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/skein-warc-{uuid.uuid4().hex}"
    archive(df, folder, id_col, url_col, payload_col, min_bytes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bodies = [p.as_py() for p in batch.column("payload")]
            sizes = [n if p is None else len(p) for p, n in zip(bodies, batch.column("payload_length").to_pylist(), strict=True)]
            own = [d if p is None else digest(p) for p, d in zip(bodies, batch.column("payload_digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(own, pa.string()), batch.column("record_type"), batch.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    columns = ("page_id", "payload_length", "payload_digest", "record_type", "refers_to", "payload")
    back = read_archive(spark, folder).where("record_type = 'response'").select(*columns)
    back = back.unionAll(read_archive(spark, folder, payload=False).where("record_type = 'revisit'").select(*columns))
    return back.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("page_id", id_col)


#: The query's rows, for DuckDB.
ORACLE = """
WITH raw AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
marked AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM raw),
best AS (SELECT hex, n, max(page_id) AS largest FROM marked GROUP BY hex, n)
SELECT page_id, CAST(marked.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(marked.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest OR largest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM largest OR largest IS NULL THEN NULL ELSE largest END AS refers_to
FROM marked JOIN best USING (hex, n)
"""
