"""WARC archives in seekable Zstandard bundles, written and read by Spark tasks.

A bundle is a row of independent Zstandard frames, each with some whole WARC records, and a footer: the seek table of
the public seekable format, a skippable frame that lists the sizes of all frames.  Any Zstandard reader can unpack the
file; the seek table finds a frame without reading the others, and the index table next to the bundles tells for each
record its file, its frame and the offset inside the unpacked frame.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmergrid.llm.common import small
from kmergrid.session import materialize

#: unpacked bytes from which on a frame is closed, and the compression level
FRAME = 1 << 18
LEVEL = 3
#: the capture date of records whose table has none
DATE = "2024-01-01T00:00:00Z"
#: copies of one row that are listed by one task at a time
COPIES = 8192

# fixed values of the public formats: the seek table's magic numbers and the profile of a revisit record
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")

#: bytes of payloads in a batch of read records
_READ_BYTES = 1 << 24

INDEX = "record_id string, page_id long, file string, frame int, offset long, length long"
RECORDS = ("record_id string, record_type string, page_id long, url string, payload binary, payload_digest string, "
           "refers_to string, file string, frame int, offset long")


def _target(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Collects records into frames; the seek table is written on closing.

    The name is new for each attempt of a task, and only the attempt that Spark commits gets into the index, so
    repeated or lost tasks leave no doubt about which file counts.
    """

    def __init__(self, folder: str, frame: int, level: int):
        self.path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        fs, name = _target(self.path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink, self.limit = fs.open_output_stream(name, compression=None), frame  # else it would compress by the name's ending
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.held, self.size, self.sizes = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame of the record and its offset inside the unpacked frame."""
        if self.size and self.size + len(record) > self.limit:
            self._flush()
        place = len(self.sizes), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        packed = self.packer.compress(b"".join(self.held))
        self.sink.write(packed)
        self.sizes.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.sink.close()


class Bundle:
    """Random access to the frames of a bundle."""

    def __init__(self, path: str):
        fs, name = _target(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"no seek table: {path}")
        width = 12 if flags & 0x80 else 8  # entries may carry checksums
        table = np.frombuffer(self.file.read_at(count * width, size - 9 - count * width), "<u4").reshape(count, width // 4).astype(np.int64)
        self.packed, self.plain = table[:, 0], table[:, 1]
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])

    def __len__(self) -> int:
        return len(self.packed)

    def frame(self, i: int) -> bytes:
        data = self.file.read_at(int(self.packed[i]), int(self.starts[i]))
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.plain[i]))


def _header(value: str) -> str:
    """A header's value: blanks, controls and everything beyond ASCII percent-encoded."""
    return urllib.parse.quote(value, safe="%/:?#[]@!$&'()*+,;=-._~")


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, first_id: str | None = None, date: str = DATE) -> bytes:
    """A response record, or, with the id of the record it repeats, a revisit record without the payload."""
    kind = "revisit" if first_id else "response"
    block = _HTTP % len(payload) + (b"" if first_id else payload)
    heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _header(url or "about:blank")),
             ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if first_id:
        heads += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{first_id}>")]
    if page_id is not None:
        heads.append(("Page-ID", str(page_id)))
    heads += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, offset: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, headers, block`` of the records from ``offset`` on; header names in lower case."""
    while offset < len(data):
        stop = data.index(b"\r\n\r\n", offset)
        version, _, rest = data[offset:stop + 2].partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        heads = {k.decode().lower(): v.decode() for k, v in _HEAD.findall(rest)}
        start, size = stop + 4, int(heads["content-length"])
        yield offset, heads, data[start:start + size]
        offset = start + size + 4


def _write(batches: Iterator[pa.RecordBatch], out: str, frame: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    writer = None
    for batch in batches:
        ids, pages, urls, htmls, firsts = (c.to_pylist() for c in batch.columns)
        places, lengths = [], []
        for rid, page, url, html, first in zip(ids, pages, urls, htmls, firsts, strict=True):
            writer = writer or BundleWriter(out, frame, level)
            data = record(rid, page, url, (html or "").encode(), first, date)
            places.append(writer.add(data))
            lengths.append(len(data))
        if ids:
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(pages, pa.int64()), pa.array([writer.path] * len(ids)), pa.array([f for f, _ in places], pa.int32()),
                                   pa.array([o for _, o in places], pa.int64()), pa.array(lengths, pa.int64())],
                                  names=["record_id", "page_id", "file", "frame", "offset", "length"])
    if writer:
        writer.close()


def _record_id(*cols: Column) -> Column:
    """A record id that a row's contents decide: the MD5 of the parts in the form of a UUID."""
    parts = F.concat_ws("", *(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols))
    h = F.md5(parts.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _first_of(ids: list[str]) -> Column:
    """Orders rows by id, nulls last."""
    return F.struct(*(x for c in ids for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c).alias(c))))


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``record_id, page_id, url, html, first_id``: one row per row of ``pages(page_id, url, html)``.

    ``first_id`` is null for responses; a row whose payload of at least ``least`` bytes an earlier row has as well names
    that row's record.  Rows are ordered by page id, then address, nulls last.  Only hashes and ids are shuffled: the
    rows that repeat something are found on a narrow table and joined to the pages, broadcast when few.
    """
    body = F.coalesce(F.col("html"), F.lit("")).alias("html")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body).withColumn("sha", F.sha2("html", 256))
    row = ["sha", "page_id", "url"]
    keys = materialize(hashed.groupBy(*row).agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("html")).alias("bytes")), "payloads")
    shared = keys.where(F.col("bytes") >= least).groupBy("sha").agg(F.sum("n").alias("of"), F.min(_first_of(["page_id", "url"])).alias("o")) \
        .where("of > 1").select("sha", F.lit(True).alias("shared"), F.col("o.page_id").alias("first_page"), F.col("o.url").alias("first_url"))
    again = keys.where("n > 1").select(*(F.col(c).alias(f"again_{c}") for c in row), "n")
    met = (F.col("sha") == F.col("again_sha")) & F.col("page_id").eqNullSafe(F.col("again_page_id")) & F.col("url").eqNullSafe(F.col("again_url"))
    marked = hashed.join(small(again), met, "left").drop("again_sha", "again_page_id", "again_url")
    single = marked.where("n is null").drop("n").withColumn("copy", F.lit(0).cast("long"))
    # equal rows: one of each, listed as often as it occurs, in two steps so that no task has to list them all
    parts = marked.where("n is not null").groupBy(*row).agg(F.first("html").alias("html"), F.first("n").alias("n")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))) \
        .repartition("sha", "page_id", "url", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    listed = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).select(*single.columns)
    whole = single.unionByName(listed).join(small(shared), "sha", "left")
    here = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 0)
    own = _record_id(F.col("page_id"), F.col("url"), F.col("sha"), F.col("copy"))
    first = _record_id(F.col("first_page"), F.col("first_url"), F.col("sha"), F.lit(0).cast("long"))
    return whole.select(own.alias("record_id"), "page_id", "url", "html", F.when(F.col("shared") & ~here, first).alias("first_id"))


def write_archives(pages: DataFrame, out: str, least: int = 0, frame: int = FRAME, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)`` to bundles in ``out`` and their index to ``out/index``.

    Of the rows with equal payloads (the UTF-8 bytes of ``html``) of at least ``least`` bytes the first, by page id and
    address, is a response; the others are revisits of it, whose records leave the payload out.  Every task writes
    one bundle; pages go to bundles as they come, without a shuffle of their texts, however few or many share a payload.
    ``out`` must be a folder that every executor reaches.

    A null text is an empty one, a null address ``about:blank``; a null page id sorts last and is left out of the record.
    Equal rows get a record each.  An empty table gives an empty index and no bundle.  Other columns are ignored.

    Returns the index: ``record_id, page_id, file, frame, offset, length``.
    """
    index = plan_records(pages, least).mapInArrow(functools.partial(_write, out=out, frame=frame, level=level, date=date), INDEX)
    index.write.parquet(f"{out}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{out}/index")


def _rows(path: str, i: int, data: bytes, offset: int = 0, count: int | None = None) -> Iterator[tuple]:
    for k, (at, heads, block) in enumerate(parse(data, offset)):
        if k == count:
            return
        kind, page, http = heads["warc-type"], heads.get("page-id"), block.partition(b"\r\n\r\n")[2]
        refers = heads.get("warc-refers-to")
        yield (heads["warc-record-id"].strip("<>"), kind, int(page) if page is not None else None, heads.get("warc-target-uri"),
               http if kind == "response" else None, digest(http) if kind == "response" else heads["warc-payload-digest"].removeprefix("sha1:"),
               refers.strip("<>") if refers else None, path, i, at)


_KINDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("file", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4] or b"") + 200
        if size > _READ_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _KINDS, strict=True)], schema=_KINDS)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _KINDS, strict=True)], schema=_KINDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            bundle = Bundle(path)
            yield from _batches(r for i in range(len(bundle)) for r in _rows(path, i, bundle.frame(i)))


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by file, frame and offset; rows come sorted, so each frame is unpacked once."""
    def rows() -> Iterator[tuple]:
        path, bundle, at, data = None, None, None, b""
        for batch in batches:
            for file, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != path:
                    path, bundle, at = file, Bundle(file), None
                if frame != at:
                    at, data = frame, bundle.frame(frame)
                yield from _rows(file, frame, data, offset, 1)
    yield from _batches(rows())


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """All records of the bundles in ``out``, one row each, as they stand in the files (:data:`RECORDS`).

    A response's digest is worked out from the payload read, a revisit has the digest its header gives and no payload.
    ``refers_to`` is the id of the record that a revisit repeats.
    """
    files = spark.read.schema(INDEX).parquet(f"{out}/index").select("file").distinct()
    return files.repartition(max(1, files.count()), "file").mapInArrow(_read, RECORDS)


def fetch(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted(record_id)`` only: the index gives their places, and only their frames are unpacked."""
    places = spark.read.schema(INDEX).parquet(f"{out}/index").join(small(wanted.select("record_id").distinct()), "record_id", "left_semi")
    return places.select("file", "frame", "offset").repartition("file").sortWithinPartitions("file", "frame", "offset").mapInArrow(_seek, RECORDS)


def catalog(spark: SparkSession, out: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, per record, from the archives alone.

    Size and digest are those of the full payload, for revisits that of the record they repeat; ``refers_to`` is that
    record's page id.
    """
    read = read_archives(spark, out).select("record_id", "record_type", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                            "payload_digest", "refers_to")
    read = materialize(read, "records")
    plain = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    repeats = read.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("record_id"))
    named = repeats.select("record_id").distinct()
    firsts = materialize(read.join(small(named), "record_id", "left_semi").select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"), "firsts")
    resolved = repeats.join(small(firsts), "record_id", "left").select(*plain.columns)
    return plain.unionByName(resolved)
