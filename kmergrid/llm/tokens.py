"""Token sequences of equal length in Arrow files, written and read by Spark tasks."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmergrid.llm.common import frugal, slices_of, small_batches
from kmergrid.llm.encoder import encoder, forget

#: ids of a sequence, and sequences of a record batch
LENGTH = 2048
BATCH = 512


def _target(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class SequenceWriter:
    """Packs a stream of ids into rows of ``length``; the last row is filled with zeros that the mask leaves out.

    A row's mask is as many ones as it has ids, then zeros, so the file keeps that number; a mask of bytes beside ids of
    two bytes would make the file half as large again.

    The file is written under a name of its own and gets its final name when it is complete, so a task that is
    repeated, or runs twice, leaves one whole file.
    """

    def __init__(self, path: str, dtype: np.dtype, length: int, batch: int):
        self.fs, self.path = _target(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.length, self.rows, self.dtype = length, batch, dtype
        kinds = {"ids": pa.list_(pa.from_numpy_dtype(dtype), length), "valid": pa.int32()}
        self.schema = pa.schema([pa.field(k, v, False) for k, v in kinds.items()])
        self.sink = self.fs.open_output_stream(self.draft)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        self.total += len(data) // self.dtype.itemsize
        if self.size >= self.rows * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.held), self.rows * self.length * self.dtype.itemsize
        at = 0
        while len(data) - at >= step or (last and at < len(data)):
            ids = np.frombuffer(data[at:at + step], self.dtype)
            at += step
            n = -(-len(ids) // self.length) * self.length
            valid = np.clip(len(ids) - np.arange(0, n, self.length), 0, self.length).astype(np.int32)
            ids = np.concatenate([ids, np.zeros(n - len(ids), self.dtype)])
            rows = pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type)
            self.writer.write_batch(pa.record_batch([rows, pa.array(valid)], schema=self.schema))
        self.held, self.size = [data[at:]], max(0, len(data) - at)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)


class Shard:
    """Random access to the sequences of one file; local files are mapped, so the ids point into them.

    All masks are windows of one array of ones and zeros: none is unpacked or copied.
    """

    def __init__(self, path: str):
        fs, name = _target(path)
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.ramp = np.arange(2 * self.length) < self.length

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a record batch in order, without a copy where the file is mapped."""
        return self.file.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, r = divmod(i, self.rows)
        batch = self.file.get_batch(b)
        ids, masked = batch.column("ids").values.to_numpy(zero_copy_only=True), self.length - batch.column("valid")[r].as_py()
        return ids[r * self.length:(r + 1) * self.length], self.ramp[masked:masked + self.length]

    def stream(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from position ``start`` of the file on, in pieces."""
        step = self.rows * self.length
        while count:
            b, at = divmod(start, step)
            part = self.flat(b)[at:at + count]
            yield part
            start, count = start + len(part), count - len(part)


@frugal(forget)
def _write(batches: Iterator[pa.RecordBatch], out: str, path: str, end: int, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, enc = TaskContext.get().partitionId(), encoder(path)
    name = f"{out}/part-{part:06d}.arrow"
    writer, first, docs = None, None, 0
    index_kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    stop = np.array([end], enc.dtype).tobytes()
    index = None
    for batch in (part_of for whole in batches for part_of in slices_of(whole, 1)):
        ids, starts, counts = batch.column(0).to_pylist(), [], []
        for data in enc.encode([t or "" for t in batch.column(1).to_pylist()]):
            if writer is None:
                writer = SequenceWriter(name, enc.dtype, length, rows)
                index = (sink := writer.fs.open_output_stream(f"{writer.draft}.index")), pa.ipc.new_file(sink, index_kind)
            starts.append(writer.total)
            writer.add(data)
            writer.add(stop)
            counts.append(writer.total - starts[-1])
        first, docs = (ids[0] if docs == 0 else first), docs + len(ids)
        index[1].write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in (ids, starts, counts)], schema=index_kind))
    if writer is not None:
        index[1].close()
        index[0].close()
        writer.fs.move(f"{writer.draft}.index", f"{writer.path}.index")
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs], "tokens": [writer.total]},
                                         schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))


def write_sequences(docs: DataFrame, out: str, path: str, end: int = 0, length: int = LENGTH, rows: int = BATCH) -> DataFrame:
    """Encode all documents and write their ids, in ascending ``doc_id`` order, to Arrow files in ``out``.

    Texts are dealt by ranges of ``doc_id`` and sorted; each task packs its documents, each closed by ``end``, into one file
    of fixed-size lists (ids and mask) plus an index of its documents.  Files in the order of their names are the
    whole stream; only the last row of a file can be filled up.  ``out`` must be a folder that every executor reaches.

    Returns the files' list ``file, docs, tokens, base`` (``base``: ids in all files before), also kept as
    ``out/files``.  A null text is an empty one and gives just ``end``; null ids come first.  Rows with the same id are
    ordered by text.  An empty table writes an empty list.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    with small_batches(spark):
        written = ordered.mapInArrow(functools.partial(_write, out=out, path=path, end=end, length=length, rows=rows),
                                     "part long, file string, docs long, tokens long").collect()
    base, listed = 0, []
    for r in sorted(written, key=lambda r: r["part"]):
        listed.append((r["file"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    files = spark.createDataFrame(listed, "file string, docs long, tokens long, base long")
    files.coalesce(1).write.parquet(f"{out}/files")
    return spark.read.parquet(f"{out}/files")


@frugal()
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(name)
            fs, path = _target(name)
            index = pa.ipc.open_file(fs.open_input_file(f"{path}.index"))
            for k in range(index.num_record_batches):
                own = index.get_batch(k)
                sums = []
                for start, n in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                    crc = 0
                    for part in shard.stream(start, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.record_batch([own.column(0), pa.array(own.column(1).to_numpy() + base), own.column(2), pa.array(sums, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """What the files in ``out`` hold of each document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it in the whole stream; the checksum covers the document's ids
    with the end id, as little-endian unsigned 32-bit integers.
    """
    files = spark.read.parquet(f"{out}/files").select("file", "base")
    return files.repartition(max(1, files.count()), "file").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
