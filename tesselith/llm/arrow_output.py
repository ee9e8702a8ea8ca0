"""Token ids as Arrow stream files of fixed-size-list batches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.llm.common import new_path, steps, to_batch
from tesselith.llm.word_tokens import ENCODE_BYTES, vocabulary

#: Tokens of a sequence, sequences of a record batch, and tokens from which on a file is closed after a document.
LENGTH, BATCH, FILE_TOKENS = 2048, 512, 1 << 26
#: Bytes of text for which the writer gets a partition; ids drawn to place the partitions' ends, per partition and at most.
PARTITION_BYTES, DRAWN, MOST_DRAWN = 1 << 27, 200, 1_000_000
#: Place of null ids in the order.
FIRST = -(1 << 63)
#: Files whose starts are joined by broadcast; more are joined by a shuffle.
BROADCAST_FILES = 100_000
#: A row per document: its file, its place there, its id and how many ids the file has of it.
INDEX = "file string, part int, place long, doc_id long, n_tokens long"


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    """`ids` and `mask` (1: an id, 0: padding) are fixed-size lists of whole bytes: row i of a batch starts at i * length in its buffer."""
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), length))])


class SequenceWriter:
    """Appends ids to one stream file; only the last sequence is padded."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind, self.schema = length, kind, file_schema(length, kind)
        self.out, self.held, self.count, self.total = pa.ipc.new_stream(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.length * BATCH:
            ids = np.concatenate(self.held)
            whole = len(ids) // (self.length * BATCH) * self.length * BATCH
            for i in range(0, whole, self.length * BATCH):
                self._write(ids[i : i + self.length * BATCH], self.length * BATCH)
            self.held, self.count = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, valid: int) -> None:
        lists = (pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((pa.array(ids, self.kind), pa.array((np.arange(len(ids)) < valid).astype(np.uint8))), self.schema, strict=True))
        self.out.write_batch(pa.RecordBatch.from_arrays(list(lists), schema=self.schema))

    def close(self) -> None:
        if self.count:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()


class Ends:
    """The ends of partitions in the order of (doc_id, hash of the text)."""

    def __init__(self, rows: DataFrame, n: int, count: int):
        rate = min(1.0, min(DRAWN * n, MOST_DRAWN) / max(count, 1))
        drawn = rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id")).where(F.rand(7) < rate)
        ids = np.sort(drawn.toArrow().column("id").to_numpy())
        self.ids = ids[[len(ids) * k // n for k in range(1, n)]] if len(ids) else ids
        self.hashes = np.full(len(self.ids), FIRST)
        own, at, times = np.unique(self.ids, return_index=True, return_counts=True)
        hot = own[times > 1].tolist()
        if hot:  # an id over several partitions is cut by the texts' hashes
            drawn = rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("hash")).where(F.col("id").isin(hot)).where(F.rand(8) < rate).toArrow()
            found, hashes = drawn.column("id").to_numpy(), drawn.column("hash").to_numpy()
            for i, begin, m in zip(own[times > 1], at[times > 1], times[times > 1], strict=True):
                of = np.sort(hashes[found == i])
                if len(of):
                    self.hashes[begin : begin + m] = of[[len(of) * k // (m + 1) for k in range(1, m + 1)]]

    def partitions(self, ids: np.ndarray, hashes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The partition of each row; one whose key is the end of several goes to any of them."""
        left, right = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero(left != right).tolist():
            own = self.hashes[left[i] : right[i]]
            begin = left[i]
            left[i], right[i] = begin + np.searchsorted(own, hashes[i], "left"), begin + np.searchsorted(own, hashes[i], "right")
        return rng.integers(left, right + 1)


def write_sequences(df: DataFrame, path: str, folder: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the index.

    Rows are encoded where they are read, and their compressed ids dealt to ranges
    of doc_id (ties by a hash of the text, so that one id with very many rows
    spreads, and repeated rows by chance), sorted and written, to a new file after
    `file_tokens`. The index, a Parquet table under `folder`, has a row per
    document, so neither a task nor a cell holds a file's documents; a retried
    task's earlier files are not in it. `folder` must be one that pyarrow's file
    systems reach.
    """
    spark = df.sparkSession
    kind = pa.uint16() if len(vocabulary(path).ends) <= 1 << 16 and end_id < 1 << 16 else pa.uint32()
    wide = np.dtype("<u2") if kind == pa.uint16() else np.dtype("<u4")
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    encoded_schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, pack, rng = vocabulary(path), zstandard.ZstdCompressor(level=3, write_checksum=False).compress, np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for part in steps(batch, "text", ENCODE_BYTES):
                ids = [pack(np.frombuffer(x + end, "<u4").astype(wide)) for x in own.encode(part.column("text").to_pylist())]
                at = ends.value.partitions(np.asarray(part.column("doc_id").fill_null(FIRST)), np.asarray(part.column("hash")), rng)
                yield to_batch({"part": at.astype(np.int32), "doc_id": part.column("doc_id"), "hash": part.column("hash"), "ids": ids}, encoded_schema)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out, place = zstandard.ZstdDecompressor().decompress, None, 0
        system, at = fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            for part in steps(batch, "ids"):
                number = part.column("part")[0].as_py()
                if out is None:
                    system.create_dir(at, recursive=True)
                    name = f"part-{number:06d}-{place:012d}-{uuid.uuid4().hex}.arrows"
                    sink = system.open_output_stream(f"{at}/{name}")
                    out = SequenceWriter(sink, length, kind)
                got = list(map(unpack, part.column("ids").to_pylist()))
                out.add(np.frombuffer(b"".join(got), wide))
                sizes = np.array([len(x) // wide.itemsize for x in got], np.int64)
                yield to_batch({"file": pa.array([f"{folder}/data/{name}"]).take(pa.array(np.zeros(len(part), np.int64))), "part": np.full(len(part), number, np.int32), "place": np.arange(place, place + len(part)), "doc_id": part.column("doc_id"), "n_tokens": sizes}, schema)
                place += len(part)
                if out.total >= file_tokens:
                    out.close()
                    sink.close()
                    out = None
        if out is not None:
            out.close()
            sink.close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PARTITION_BYTES)
    ends = spark.sparkContext.broadcast(Ends(rows, n, count))
    encoded = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(encode, "part int, doc_id long, hash long, ids binary")
    encoded.repartitionById(n, "part").sortWithinPartitions("doc_id", "hash").mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a written folder: doc_id, start, n_tokens, ids_crc32, from the files' own ids."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # one light row per file: where its ids begin among all
    files = index.groupBy("file").agg(F.min("part").alias("part"), F.min("place").alias("place"), F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, start = None, None, 0
        for batch in batches:  # a file's documents follow each other, by place
            if not len(batch):
                continue
            names = batch.column("file").to_pylist()
            sizes, starts_, crc = batch.column("n_tokens").to_pylist(), [], []
            for name, base, n in zip(names, batch.column("base").to_pylist(), sizes, strict=True):
                if name != last:
                    if ids is not None:
                        ids.end()
                    last, ids, start = name, _Ids(name), base
                crc.append(ids.crc(n))
                starts_.append(start)
                start += n
            yield to_batch({"doc_id": batch.column("doc_id"), "start": starts_, "n_tokens": sizes, "ids_crc32": crc}, schema)
        if ids is not None:
            ids.end()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_file = index.join(F.broadcast(starts) if files.count() <= BROADCAST_FILES else starts, "file")
    return by_file.repartition(n, "file").sortWithinPartitions("file", "place").select("file", "base", "doc_id", "n_tokens").mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


class _Ids:
    """The ids of one file that are no padding, taken from the front, a batch in memory."""

    def __init__(self, file: str):
        system, at = fs.FileSystem.from_uri(file)
        self.file, self.source = file, system.open_input_file(at)
        self.stream, self.held = pa.ipc.open_stream(self.source), b""

    def _more(self) -> bool:
        batch = next(self.stream, None)
        if batch is None:
            return False
        ids, mask = (batch.column(i).values.to_numpy(zero_copy_only=True) for i in (0, 1))
        self.held = memoryview(ids[mask.view(bool)].astype("<u4")).cast("B")
        return True

    def crc(self, n: int) -> int:
        """crc32 of the next n ids."""
        out, left = 0, 4 * n
        while left:
            if not len(self.held) and not self._more():
                raise ValueError(f"{self.file}: {left // 4} ids less than its documents have")
            out = zlib.crc32(self.held[:left], out)
            took = min(left, len(self.held))
            self.held, left = self.held[took:], left - took
        return out

    def end(self) -> None:
        """Closes the file, which has to be used up."""
        if len(self.held) or self._more():
            raise ValueError(f"{self.file}: more ids than its documents have")
        self.source.close()


class SequenceFile:
    """Random access to a local file's sequences, as views of the memory-mapped file.

    All batches but the last have BATCH sequences, so their messages are equally
    long: the place of any is computed from the first one's, and nothing before it
    is read.
    """

    def __init__(self, path: str):
        self.source = pa.memory_map(path)
        with pa.ipc.open_stream(self.source) as stream:
            self.schema = stream.schema
        self.length = self.schema.field("ids").type.list_size
        self.source.seek(0)
        pa.ipc.read_message(self.source)
        self.begin = self.source.tell()
        self.step = None
        if self.source.size() > self.begin + 8:  # 8: the mark of the end
            self.rows = len(self._batch(self.begin))
            self.step = self.source.tell() - self.begin

    def _batch(self, at: int) -> pa.RecordBatch:
        self.source.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, index: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence, no copies."""
        at = None if self.step is None or index < 0 else self.begin + index // self.rows * self.step
        if at is None or at + 8 >= self.source.size():
            raise IndexError(index)
        batch, begin = self._batch(at), index % self.rows * self.length
        if index % self.rows >= len(batch):
            raise IndexError(index)
        return tuple(c.values.to_numpy(zero_copy_only=True)[begin : begin + self.length] for c in batch.columns)


def arrow_output(df: DataFrame, path: str, folder: str | None = None, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids in the file format, reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone. Null ids come first and stay null;
    equal ids lie in the order of a hash of their texts; repeated rows are
    written each; an empty table writes no files and gives no rows; other columns
    are not read.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "sequences")
    write_sequences(df, path, folder, end_id, length, id_col, text_col)
    return read_sequences(spark, folder)
