"""Byte-level BPE over a global shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import STEP_BYTES, new_path, steps, to_batch

#: A chunk of documents shares one dictionary; it ends at so many bytes of text or distinct words.
CHUNK_BYTES, CHUNK_WORDS = 32 << 20, 600_000
DICTIONARY = "at long, word string"
#: Dictionary rows for which the word shuffle gets a partition.
PARTITION_WORDS = 2_000_000
#: Where a word lies: from the lowest bits its number in a chunk's dictionary (0 has the chunk's file), the task, the task's chunk.
PLACE_BITS, TASK_BITS = 24, 23
#: White space in some libraries only.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: No pre-token reaches over these: a blank is at the start of one, or follows white space (of any Unicode version).
SAFE_CUTS = re.compile(r"(?<=[^\s\u180e\u200b])(?= )")


class ByteVocabulary:
    """Ranks of a tiktoken file: encodes single pre-tokens, and has each token's bytes as one flat table."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.unstable = _unstable_letters()
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.sizes = np.array(list(map(len, table)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.kind = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")

    def unlike(self, text: str) -> bool:
        """Whether libraries may split the text differently."""
        if text.isascii():
            return any(map(text.__contains__, SEPARATORS))
        return bool(self.unstable[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def words(self, text: str) -> list[str]:
        """The text's pre-tokens; a stretch between safe cuts that libraries may split differently stays whole."""
        if not self.unlike(text):
            return self.split(text)
        return [w for x in SAFE_CUTS.split(text) for w in ([x] if self.unlike(x) else self.split(x))]

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, or of a stretch of several."""
        return np.array(self.library.encode_ordinary(word), self.kind).tobytes()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids joined with the token-byte table: all bytes, and the end of each id's bytes."""
        return gather(self.bytes, self.starts, self.sizes, ids)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[r] : starts[r] + sizes[r]] for each r one after another, and where each ends."""
    n = sizes[refs]
    ends = np.cumsum(n)
    at = np.repeat(starts[refs] - ends + n, n)
    at += np.arange(len(at))
    return values[at], ends


def _unstable_letters() -> np.ndarray:
    """By code point, whether Unicode versions since 3.2 class the character differently.

    Libraries follow different Unicode versions; only letters, numbers and white
    space matter to the split. The information separators count as white space
    in some libraries only.
    """
    kind = lambda c, db: "s" if c.isspace() and db.category(c) != "Cn" else k if (k := db.category(c)[0]) in "LN" else ""
    return np.array([c in range(0x1C, 0x20) or kind(chr(c), unicodedata) != kind(chr(c), unicodedata.ucd_3_2_0) for c in range(sys.maxunicode + 1)])


@lru_cache(maxsize=2)
def byte_vocabulary(path: str, pattern: str) -> ByteVocabulary:
    """One vocabulary per process and path."""
    return ByteVocabulary(path, pattern)


#: What a chunk file holds of each document: its words' places in the dictionary.
#: The places' bytes lie apart, low to high, for they compress better so.
CHUNK_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"byte{i}", pa.list_(pa.uint8())) for i in range(PLACE_BITS // 8))])
DICTIONARY_SCHEMA = pa.schema([("at", pa.int64()), ("word", pa.string())])


class _Places(dict):
    """Numbers new words from 1, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self) + 1
        return at


class _Chunk:
    """Documents dictionary-encoded into one file of the shared folder."""

    def __init__(self, folder: str, number: int):
        self.system, at = fs.FileSystem.from_uri(folder)
        self.system.create_dir(at, recursive=True)
        self.number, self.name = number, f"{number}-{uuid.uuid4().hex}.arrow"
        self.sink = self.system.open_output_stream(f"{at}/{self.name}")
        self.file = pa.ipc.new_stream(self.sink, CHUNK_SCHEMA, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6)))
        self.places = _Places()
        self.size = 0

    def add(self, own: ByteVocabulary, part: pa.RecordBatch) -> None:
        get, refs, ends = self.places.__getitem__, [], [0]
        for text in part.column("text").to_pylist():
            words = own.words(text or "")
            refs.append(np.fromiter(map(get, words), np.uint32, len(words)))
            ends.append(ends[-1] + len(words))
        self.size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        ends, refs = pa.array(ends, pa.int32()), np.concatenate(refs)
        planes = {f"byte{i}": pa.ListArray.from_arrays(ends, pa.array((refs >> np.uint32(8 * i)).astype(np.uint8))) for i in range(PLACE_BITS // 8)}
        self.file.write_batch(to_batch({"doc_id": part.column("doc_id")} | planes, CHUNK_SCHEMA))

    def close(self) -> pa.RecordBatch:
        """The dictionary, after the file's name; by word, for neighbours then compress better in the shuffle."""
        self.file.close()
        self.sink.close()
        words = sorted(self.places)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        return to_batch({"at": np.append(0, at) + (self.number << PLACE_BITS), "word": [self.name, *words]}, DICTIONARY_SCHEMA)


def _refs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words of a chunk's batch, and where each document's begin."""
    planes = [batch.column(f"byte{i}") for i in range(PLACE_BITS // 8)]
    refs = sum(p.values.to_numpy().astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(planes))
    return refs, planes[0].offsets.to_numpy()


def byte_bpe(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Encodes every text and decodes the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    1. Each chunk of documents is exploded into pre-tokens by position and
       pre-aggregated: a file of the shared folder keeps, by document and
       position, the place of the word in the chunk's dictionary, and only the
       dictionary goes on, so a word has one row per chunk however often it occurs.
    2. Dictionary rows are shuffled by word and sorted, each distinct word is
       encoded once, and its ids are joined back to the chunks that have it.
    3. Each chunk reassembles its documents by position and joins the ids with
       the token-byte table (its size is fixed by the vocabulary).

    A null text is empty: no ids, the digests of no bytes. Null ids stay null,
    repeated rows are encoded each, an empty table gives no rows, other columns
    are not read. A stretch between blanks with a letter that Unicode versions class
    differently goes through the shuffle as one word, which the library splits.
    `folder` must be one that pyarrow's file systems reach.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "byte-bpe")

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, chunk, number = byte_vocabulary(path, pattern), None, TaskContext.get().partitionId()
        for batch in batches:
            for part in steps(batch, "text", min(STEP_BYTES, chunk_bytes)):
                if chunk is None:
                    chunk, number = _Chunk(f"{folder}/chunks", number), number + (1 << TASK_BITS)
                chunk.add(own, part)
                if chunk.size >= chunk_bytes or len(chunk.places) >= chunk_words:
                    yield chunk.close()
                    chunk = None
        if chunk:
            yield chunk.close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(explode, DICTIONARY).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{folder}/dictionary")
    dictionary = spark.read.schema(DICTIONARY).parquet(f"{folder}/dictionary")

    encoded_schema = pa.schema([("at", pa.int64()), ("ids", pa.binary())])
    place_mask = (1 << PLACE_BITS) - 1

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, ids = byte_vocabulary(path, pattern), None, b""
        for batch in batches:
            out = []
            named = np.asarray(batch.column("at")) & place_mask == 0
            for word, name in zip(batch.column("word").to_pylist(), named.tolist(), strict=True):
                if name:
                    out.append(word.encode())
                    continue
                if word != last:  # sorted: equal words follow each other
                    last, ids = word, own.encode_word(word)
                out.append(ids)
            yield to_batch({"at": batch.column("at"), "ids": out}, encoded_schema)

    # a word has a row per chunk at most, so no word outweighs a partition
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-dictionary.count() // PARTITION_WORDS))
    encoded = dictionary.repartition(n, "word").sortWithinPartitions("word").mapInArrow(encode, "at long, ids binary")

    digest_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []
        for batch in batches:  # sorted: a chunk's rows follow each other, by place
            of = np.asarray(batch.column("at")) >> PLACE_BITS
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for i, j in zip(begin, [*begin[1:], len(of)], strict=True):
                if of[i] != chunk:
                    if held:
                        yield from digests(held)
                    chunk, held = of[i], []
                held.append(batch.column("ids").slice(i, j - i))
        if held:
            yield from digests(held)

    def digests(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        own, ids = byte_vocabulary(path, pattern), pa.concat_arrays(held)
        sizes = np.asarray(pc.binary_length(ids)).astype(np.int64)
        name, sizes = ids[0].as_py().decode(), sizes // own.kind.itemsize
        flat = np.frombuffer(b"".join(ids[1:].to_pylist()), own.kind)
        sizes[0] = 0
        system, at = fs.FileSystem.from_uri(f"{folder}/chunks/{name}")
        with system.open_input_stream(at) as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                yield _digests(own, batch, flat, np.cumsum(sizes) - sizes, sizes)

    def _digests(own: ByteVocabulary, batch: pa.RecordBatch, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        refs, begins = _refs(batch)
        ids, ends = gather(flat, starts, sizes, refs)
        bounds = np.append(0, ends)[begins]
        decoded, ends = own.decode(ids)
        byte_bounds = np.append(0, ends)[bounds]
        wide, n, a, b = ids.astype("<u4"), [], [], []
        for i in range(len(batch)):
            x, y = wide[bounds[i] : bounds[i + 1]], decoded[byte_bounds[i] : byte_bounds[i + 1]]
            n.append(len(x))
            a.append(hashlib.sha256(x.tobytes()).hexdigest())
            b.append(hashlib.sha256(y.tobytes()).hexdigest())
        return to_batch({"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}, digest_schema)

    chunks = dictionary.where(F.col("at").bitwiseAND(place_mask) == 0).count()
    by_chunk = encoded.repartition(max(least, chunks), F.shiftright("at", PLACE_BITS)).sortWithinPartitions("at")
    return by_chunk.mapInArrow(reassemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
