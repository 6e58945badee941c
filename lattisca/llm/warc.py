"""WARC archives: a writer, and a data source that plans file partitions, takes filters down to the headers, and leaves payloads
that nobody asked for undecoded."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from lattisca.llm.common import durable, join_split, shared_path, table

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, page_id long, content_length long, file string, offset long"
SCHEMA_PAYLOAD = SCHEMA + ", payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns whose equality filters are settled by the headers alone.
FROM_HEADERS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "page_id")
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 18
#: Bytes of a member that are fed at once, and decoded at first.
STEP, HEAD = 1 << 14, 1 << 11
#: How a gzip member begins that has an extra field, and that field where it holds both lengths of the member.
MEMBER, LENGTHS = b"\x1f\x8b\x08\x04", b"\x0c\x00sl\x08\x00"
#: A task takes whole files up to so many bytes.
PARTITION_BYTES = 64 << 20
#: Digests of repeated payloads that are broadcast at most (20 bytes and a number each); more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def safe_uri(url: str | None) -> str | None:
    """Header lines hold no control characters or blanks; those are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, digest: str) -> bytes:
    """A ``response`` has the payload behind an HTTP header; a ``revisit`` has the HTTP header alone and names the response."""
    block = HTTP + (payload if record_type == "response" else b"")
    head = [("WARC-Type", record_type), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", safe_uri(url)))
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def info_record(file: str) -> bytes:
    """What an archive begins with: a ``warcinfo`` that names it."""
    block = b"software: lattisca\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{file}>"), ("WARC-Date", DATE), ("WARC-Filename", file), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member of its own whose extra field tells how long it is, packed and not."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    size = 24 + len(body) + 8
    if max(size, len(record)) >> 32:  # no room for the lengths
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return MEMBER + b"\x00\x00\x00\x00\x00\xff" + LENGTHS + size.to_bytes(4, "little") + len(record).to_bytes(4, "little") + body + tail


class _Done(WriterCommitMessage):
    def __init__(self, file: str | None, size: int):
        self.file, self.size = file, size


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, payload, payload_sha1, record_type, refers_to) to one archive per task; the manifest names those that count."""

    def __init__(self, options: dict):
        self.path, self.gzip = options["path"], options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, place = _fs(self.path)
        fs.create_dir(place, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        out, size = None, 0
        pack = gzip_member if self.gzip else bytes
        for batch in iterator:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(f"{place}/{name}", compression=None)
                size = out.write(pack(info_record(name)))
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_sha1", "record_type", "refers_to")), strict=True):
                who, url, html, sha1, kind, of = (x.as_py() for x in row)
                size += out.write(pack(encode_record(who, url, html or b"", kind, of, base64.b32encode(sha1).decode())))
        if out is None:
            return _Done(None, 0)
        out.close()
        return _Done(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, place = _fs(self.path)
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/manifest.json") as f:
            f.write(json.dumps(sorted([m.file, m.size] for m in messages if m is not None and m.file)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, place = _fs(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{place}/{m.file}")


class _Source:
    """Bytes of an archive, plain or gzip, with a skip that does not keep what it passes. A gzip member that tells its own
    length (``gzip_member``) is left undecoded where it is skipped to its end."""

    def __init__(self, file: pa.NativeFile, gzip: bool):
        self.file, self.gzip = file, gzip
        self.buffer, self.pos, self.at = b"", 0, 0  # decoded bytes, how many of them are passed, and all that are
        self.raw, self.raw_pos, self.raw_at = b"", 0, 0  # compressed bytes, how many are used, and the first one's place
        self.unpacker = None
        self.decoded = 0
        self.member: tuple[int, int] | None = None  # where the next one begins in the file, and in what is decoded

    def _begin(self) -> None:
        if len(self.raw) - self.raw_pos < 24:
            self.raw, self.raw_at, self.raw_pos = self.raw[self.raw_pos :] + self.file.read(CHUNK), self.raw_at + self.raw_pos, 0
        head = self.raw[self.raw_pos : self.raw_pos + 24]
        self.unpacker, self.member = zlib.decompressobj(31), None
        if head[:4] == MEMBER and head[10:16] == LENGTHS:
            size, plain = (int.from_bytes(head[k : k + 4], "little") for k in (16, 20))
            self.member = (self.raw_at + self.raw_pos + size, self.decoded + plain)

    def _decode(self) -> bytes:
        while True:
            if self.raw_pos == len(self.raw):
                self.raw, self.raw_at, self.raw_pos = self.file.read(CHUNK), self.raw_at + len(self.raw), 0
                if not self.raw:
                    if self.unpacker is not None:
                        raise ValueError("the archive ends inside a record")
                    return b""
            most = CHUNK
            if self.unpacker is None:
                self._begin()
                most = HEAD  # often no more than the header is wanted
            piece = self.raw[self.raw_pos : self.raw_pos + STEP]
            data = self.unpacker.decompress(piece, most)
            self.raw_pos += len(piece) - len(self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail)
            if self.unpacker.eof:
                self.unpacker = None
            if data:
                self.decoded += len(data)
                return data

    def _more(self) -> bool:
        data = self._decode() if self.gzip else self.file.read(CHUNK)
        self.buffer, self.pos = self.buffer[self.pos :] + data, 0
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed too; None at the end of the archive."""
        seen = self.pos
        while (i := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - self.pos - len(mark) + 1)
            if not self._more():
                if self.buffer[self.pos :].strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out = self.buffer[self.pos : i]
        self.pos = i + len(mark)
        self.at += len(out) + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer[self.pos :]], len(self.buffer) - self.pos
        while have < n:
            self.buffer, self.pos = b"", 0
            if not self._more():
                raise ValueError("the archive ends inside a record")
            parts.append(self.buffer)
            have += len(self.buffer)
        self.pos = len(self.buffer) - (have - n)
        self.at += n
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        self.at += n
        left = n - (len(self.buffer) - self.pos)
        if left <= 0:
            self.pos += n
            return
        self.buffer, self.pos = b"", 0
        if not self.gzip:
            self.file.seek(self.file.tell() + left)
        elif self.unpacker is not None and self.member is not None and self.member[1] == self.at:
            place = self.member[0]
            if place <= self.raw_at + len(self.raw):
                self.raw_pos = place - self.raw_at
            else:
                self.file.seek(place)
                self.raw, self.raw_pos, self.raw_at = b"", 0, place
            self.unpacker, self.decoded = None, self.at
        else:
            while left > 0:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
                step = min(left, len(self.buffer))
                self.pos, left = step, left - step


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def read_records(file: pa.NativeFile, name: str, gzip: bool, wanted: dict[str, set], payloads: bool, present: Iterable[str] = ()) -> Iterator[tuple]:
    """Headers first; a record that the filters reject (``wanted`` values, ``present`` fields), or whose payload isn't
    wanted, has its block skipped."""
    source = _Source(file, gzip)
    while True:
        at = source.at
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "surrogatepass").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name} has no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        row = {
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in fields else None,
            "refers_to": fields.get("warc-refers-to"), "page_id": _page(fields.get("warc-record-id")),
        }
        if any(row[c] not in some for c, some in wanted.items()) or any(row[c] is None for c in present):
            source.skip(length + 4)
            continue
        size = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
        body = None
        if row["record_type"] == "response" and (payloads or size is None):
            block = source.take(length)
            body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
            if row["payload_digest"] is not None and digest32(body) != row["payload_digest"]:
                raise ValueError(f"{name}: the payload at {at} doesn't fit its digest")
            size = len(body)
            source.skip(4)
        else:
            source.skip(length + 4)
        yield (row["record_type"], row["record_id"], row["target_uri"], row["payload_digest"], size, row["refers_to"], row["page_id"], length, name, at, *((body,) if payloads else ()))


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class WarcReader(DataSourceReader):
    """A partition holds whole files, as many as fit ``PARTITION_BYTES``."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.payloads = "payload" in schema.fieldNames()
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, IN and presence of header fields are settled here; the others go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FROM_HEADERS:
                values = ({f.value} if isinstance(f, EqualTo) else set(f.value)) - {None}  # null equals nothing
                c = f.attribute[0]
                self.wanted[c] = self.wanted[c] & values if c in self.wanted else values
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in FROM_HEADERS:
                self.present.add(f.attribute[0])
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, place = _fs(self.path)
        if fs.get_file_info(f"{place}/manifest.json").type == pa.fs.FileType.File:
            with fs.open_input_stream(f"{place}/manifest.json") as f:
                files = [(n, s) for n, s in json.loads(f.read())]
        else:
            files = sorted((i.base_name, i.size) for i in fs.get_file_info(pa.fs.FileSelector(place)) if re.search(r"\.warc(\.gz)?$", i.base_name))
        out: list[list[str]] = []
        room = 0
        for name, size in files:
            if size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(name)
            room -= size
        return [_Files(names) for names in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, place = _fs(self.path)
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * self.payloads
        names = NAMES + ["payload"] * self.payloads

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for name in partition.value:
            rows, size = [], 0
            with fs.open_input_file(f"{place}/{name}") as file:
                for row in read_records(file, name, name.endswith(".gz"), self.wanted, self.payloads, self.present):
                    rows.append(row)
                    size += 200 + (len(row[-1] or b"") if self.payloads else 0)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    """``format("lattisca_warc")``: options path, payload=true for the payloads, and on writing compression=gzip."""

    @classmethod
    def name(cls) -> str:
        return "lattisca_warc"

    def schema(self) -> str:
        return SCHEMA_PAYLOAD if self.options.get("payload") == "true" else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "none") -> None:
    """A record per row, behind a ``warcinfo`` in each file. Of equal payloads of at least ``min_bytes`` the one with the
    smallest key is a response, the others revisit it; smaller ones are all responses.

    Keys are whole numbers of 64 bits. A null html is an empty payload; a null url has no target line; a null key sorts
    behind all others; rows that repeat the smallest key are responses each; other columns are not read; an empty table
    gives a manifest alone.

    Digests alone are shuffled, those that come twice or more are broadcast, and payloads are written where they
    were read, however common one of them is. Beyond BROADCAST_DIGESTS, the keys of revisits are joined instead.
    """
    pages.sparkSession.dataSource.register(WarcSource)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_sha1", F.unhex(F.sha1("payload")))
    digests = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "payload_sha1")
    firsts = durable(digests.groupBy("payload_sha1").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n"))
    if firsts.count() <= BROADCAST_DIGESTS:
        met = rows.join(F.broadcast(firsts), "payload_sha1", "left")
    else:
        revisits = join_split(digests, firsts, ["payload_sha1"]).where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(F.col("page_id").alias("_id"), F.col("payload_sha1").alias("_sha1"), "_first").distinct()
        met = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_sha1") == F.col("_sha1")), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    out = met.select("page_id", "url", "payload", "payload_sha1", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))
    out.write.format("lattisca_warc").mode("append").options(path=path, compression=compression).save()


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("lattisca_warc").options(path=path, payload=str(payload).lower()).load()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, compression="gzip")
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", r"(-?\d+)>", 1).cast("long").alias("refers_to"))
