"""WARC archives as a Spark data source.

Reading: archives are planned into partitions of whole files of about the same number of bytes; every
record is its own gzip member. A record's header lines are parsed first. Filters on the record type and
other header fields that Spark pushes down are applied to them, and the block of an unwanted record is
skipped without being decoded or copied. Writing: tasks write archives of a bounded size under names of
their own and the driver lists the finished ones in a manifest, so attempts that are lost or repeated
leave nothing that readers see. Paths go through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import plain, shared_dir, small_side, staged

SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, date string, "
    "payload_bytes long, payload binary"
)
#: Header fields behind the columns that filters may name.
FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "date": "warc-date",
}
FILE_BYTES, PARTITION_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 64 << 20, 1 << 20, 4 << 20
MANIFEST = "_manifest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Members:
    """The record stream of one archive, plain or with gzip members, read in blocks."""

    def __init__(self, raw):
        self.raw, self.data, self.inflate = raw, b"", None
        self.packed = False

    def _more(self) -> bool:
        if self.packed and self.inflate is not None and not self.inflate.eof and self.inflate.unconsumed_tail:
            block = self.inflate.unconsumed_tail
        else:
            block = self.inflate.unused_data if self.packed and self.inflate.eof else b""
            block = block or self.raw.read(READ_BYTES)
            if not block:
                return False
            if self.inflate is None:
                self.packed, self.inflate = block[:2] == b"\x1f\x8b", True
            if self.packed and (self.inflate is True or self.inflate.eof):
                self.inflate = zlib.decompressobj(31)
        self.data += self.inflate.decompress(block, READ_BYTES) if self.packed else block
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the archive."""
        at = 0
        while (i := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if not self._more():
                return None
        out, self.data = self.data[: i + len(mark)], self.data[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if not self.data and not self._more():
                raise EOFError("the archive ends within a record")
            part = self.data[:n]
            parts.append(part)
            self.data, n = self.data[n:], n - len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.data and not self._more():
                raise EOFError("the archive ends within a record")
            part = min(n, len(self.data))
            self.data, n = self.data[part:], n - part


def records(raw, wanted=None, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, payload) of the records whose header passes ``wanted``; payload is None where not asked for."""
    stream = Members(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(header["content-length"])
        if wanted is not None and not wanted(header):
            stream.skip(size + 4)
            continue
        if payloads:
            block = stream.take(size)
            stream.skip(4)
            if header.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
                block = block[block.index(b"\r\n\r\n") + 4 :]
            yield header, block
        else:
            stream.skip(size + 4)
            yield header, None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def planned(sizes: list[tuple[str, int]], limit: int = PARTITION_BYTES) -> list[list[str]]:
    """Whole files in partitions of about ``limit`` bytes."""
    out, room = [], 0
    for path, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(path)
        room -= size
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Equality, membership and presence of header fields are tested here; the rest stays with Spark."""
        for f in filters:
            field = FIELDS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if field and isinstance(f, (EqualTo, In)):
                self.tests.append((field, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            elif field and isinstance(f, IsNotNull):
                self.tests.append((field, None))
            else:
                yield f

    def wanted(self, header: dict[str, str]) -> bool:
        return all(k in header if values is None else header.get(k) in values for k, values in self.tests)

    def partitions(self):
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=False)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        sizes = {f.path: f.size for f in found if f.path.endswith((".warc", ".warc.gz"))}
        lists = [f.path for f in found if f.base_name.startswith(MANIFEST)]
        if lists:
            listed = {f"{root.rstrip('/')}/{name}" for p in lists for name in json.loads(store.open_input_stream(p).read())}
            sizes = {k: v for k, v in sizes.items() if k in listed}
        return [Files(paths) for paths in planned(list(sizes.items()))] or [Files([])]

    def read(self, partition):
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        store, _ = _open(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw:
                for header, payload in records(raw, self.wanted, self.payload):
                    row = {c: header.get(k) for c, k in FIELDS.items()}
                    length = header.get("payload-length")
                    rows.append(row | {"payload": payload, "payload_bytes": int(length) if length else None if payload is None else len(payload)})
                    held += 200 + len(payload or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, gzip: bool):
        self.path, self.gzip = path, gzip

    def record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        block = b"" if revisit else _HTTP % len(payload) + payload if row["record_type"] == "response" else payload
        head = {
            "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z",
            "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": row["payload_digest"], "WARC-Refers-To": row["refers_to"],
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
            "Payload-Length": len(payload) if row.get("payload_bytes") is None else row["payload_bytes"],
            "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
        }
        lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head.items() if v is not None)
        out = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
        if self.gzip:
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            out = packer.compress(out) + packer.flush()
        return out

    def write(self, iterator):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = io.BufferedWriter(_Sink(store.open_output_stream(f"{root}/{names[-1]}", compression=None)), 1 << 20), 0
                data = self.record(batch.slice(i, 1).to_pylist()[0])
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        store, root = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                store.delete_file(f"{root}/{name}")


class _Sink(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(data)
        return len(data)

    def close(self):
        if not self.closed:
            self.stream.close()
        super().close()


class WarcSource(DataSource):
    """``format("warc")``. Options: path; payload (false: headers only); gzip (writing, true by default)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], self.options.get("gzip", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC records; equal payloads of that many bytes are kept once.

    Of a group of equal payloads that with the largest page_id is the response and the others revisit it; of several rows with
    that page_id one with the smallest url (null first) is the response. A null html is an empty payload, a null page_id the id 'page:null',
    which is never the response of others; rows that all lack an id are all responses. A payload of any length is one value of a row.
    """
    pages = plain(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("key", F.sha1(F.encode("html", "utf-8")))
    pages = pages.withColumn("n", F.octet_length("html").cast("long"))
    ids = pages.where(F.col("n") >= min_revisit_bytes).groupBy("key", "page_id").agg(F.count("*").alias("c"))
    groups = ids.groupBy("key").agg(F.max(F.struct("page_id", "c")).alias("m"), F.sum("c").alias("copies")).where("copies > 1")
    groups = staged(groups.select("key", F.col("m.page_id").alias("first"), F.col("m.c").alias("ties")), "groups")
    pages = pages.join(small_side(groups, 500_000), "key", "left")
    tied = F.coalesce((F.col("page_id") == F.col("first")) & (F.col("ties") > 1), F.lit(False))
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    decided = lambda df: df.select("key", "page_id", "url", "n", "html", "first", copy.alias("copy"))
    rows = decided(pages)
    if not groups.where("first is not null AND ties > 1").isEmpty():
        rows = decided(pages.where(~tied)).unionByName(_one_response(pages.where(tied)))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(F.col("copy"), "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.concat(F.lit("sha1:"), _base32(F.col("key"))).alias("payload_digest"),
        F.when(F.col("copy"), name(F.col("first"))).alias("refers_to"), F.lit(None).cast("string").alias("date"),
        F.col("n").alias("payload_bytes"), F.when(F.col("copy"), F.lit(b"")).otherwise(F.encode("html", "utf-8")).alias("payload"),
    )


def _one_response(tied: DataFrame) -> DataFrame:
    """Rows of one page_id and payload: one is the response, the others revisit it. Rows of a url are counted before they move, html goes once a key."""
    urls = tied.groupBy("key", "page_id", "n", "first", "url").agg(F.count("*").alias("c"))
    lead = tied.groupBy("key").agg(F.min(F.struct("url", "html")).alias("lead"))
    counted = urls.join(lead.select("key", F.col("lead.url").alias("lead_url")), "key")
    left = F.col("c") - F.when(F.col("url").eqNullSafe(F.col("lead_url")), 1).otherwise(0)
    revisits = counted.withColumn("left", left).where("left > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    revisits = revisits.select("key", "page_id", "url", "n", F.lit("").alias("html"), "first", F.lit(True).alias("copy"))
    ids = urls.select("key", "page_id", "n", "first").distinct()
    responses = ids.join(lead, "key").select("key", "page_id", F.col("lead.url").alias("url"), "n", F.col("lead.html").alias("html"), "first", F.lit(False).alias("copy"))
    return responses.unionByName(revisits)


def _base32(hexadecimal):
    """Base32 of 40 hexadecimal digits: 5 digits are 4 letters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), digits, letters)


def write_warc(records: DataFrame, path: str, gzip: bool = True) -> None:
    register(records.sparkSession)
    records.write.format("warc").option("path", path).option("gzip", str(gzip)).mode("append").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; without ``payload`` no block is decoded and that column is null."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload)).load()


def page_id_of(column: str):
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive folder in the shared folder and read it back.

    One row a row of ``pages``: page_id, payload_bytes, payload_digest (bare), record_type, refers_to. Bytes and digest
    of responses come from the decoded payload, those of revisits from their header. Null ids, repeated rows and ties are as in ``page_records``.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages, min_revisit_bytes), path)
    full = read_warc(spark, path).where("record_type = 'response'").withColumn("own", F.sha1("payload"))
    full = full.select("record_id", "refers_to", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), _base32(F.col("own")).alias("payload_digest"))
    light = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    light = light.select("record_id", "refers_to", "record_type", "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"))
    out = full.unionByName(light)
    return out.select(page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of("refers_to").alias("refers_to"))
