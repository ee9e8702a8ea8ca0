"""WARC archives with revisit resolution by payload digest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm.common import join_counted, new_path, steps, stored, to_batch

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file is closed at so many bytes.
FILE_BYTES = 1 << 30
MANIFEST = "file string, n_records long"
HEADERS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page's id in its free bits (all 64 of them, and one for null)."""
    n = (page_id or 0) & (1 << 64) - 1
    bits = (n >> 62 | (page_id is None) << 2) << 64 | n & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=bits | 8 << 76 | 2 << 62)}>"


def page_of(record: str) -> int | None:
    """The page's id in a record id that record_id() gave."""
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if bits >> 66 & 1:
        return None
    n = (bits >> 64 & 3) << 62 | bits & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _uri(url: str | None) -> str:
    """A target URI that keeps to one header line."""
    from urllib.parse import quote

    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")


def render(page_id: int | None, url: str | None, payload: bytes, origin: tuple[int | None, str | None] | None, date: str) -> bytes:
    """One record with fresh headers; origin (page, url) makes it a revisit, whose block has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if origin else http + payload
    lines = [("WARC-Type", "revisit" if origin else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if origin:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(origin[0])), ("WARC-Refers-To-Target-URI", _uri(origin[1])), ("WARC-Refers-To-Date", date)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip-compressed archive."""
    with gzip.GzipFile(fileobj=source) as f:
        while line := f.readline():
            if line.strip() != VERSION:
                raise ValueError(f"not a record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            block = f.read(int(headers["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record that does not end where its length says")
            yield headers, block


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Which records revisit which: page_id, digest, origin, origin_url, for revisits only.

    `headers` (a stored table: page_id, url, digest) is shuffled by digest, summed
    first, so that a payload with very many copies is one row per task. Of equal
    payloads the largest page_id is the original; others, and null ids beside
    one, revisit it. Rows that repeat the original's id and payload are
    responses as it is. One row per page_id and digest.
    """
    origins = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "copies", F.col("first.page_id").alias("origin"), F.col("first.url").alias("origin_url"))
    origins, _ = stored(origins, "warc-origins")
    copied = headers.select("page_id", "digest")
    found = join_counted(copied, origins, "digest", "copies", headers.count())
    return found.where(F.col("origin").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("origin")))).select("page_id", "digest", "origin", "origin_url").distinct()


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row into gzip-compressed archives, payloads once; returns the manifest.

    Every record is a gzip member of its own. The manifest, a Parquet table in
    `folder`, names the files of the attempts that count. `folder` must be one
    that pyarrow's file systems reach.
    """
    spark = df.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    headers, _ = stored(pages.select("page_id", "url", "digest"), "warc-headers")
    revisits = resolve_revisits(headers).withColumnsRenamed({"page_id": "p", "digest": "d"}).withColumn("revisit", F.lit(True))
    # by page and digest: no page has many rows, whatever payload it has
    decided = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "origin", "origin_url", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for part in steps(batch, "html"):
                for row in part.to_pylist():
                    if out is None:
                        system, at = fs.FileSystem.from_uri(f"{folder}/archives")
                        system.create_dir(at, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, n, size = system.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                    packer = zlib.compressobj(3, wbits=31)
                    data = packer.compress(render(row["page_id"], row["url"], row["html"].encode(), (row["origin"], row["origin_url"]) if row["revisit"] else None, date)) + packer.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                        yield to_batch({"file": [f"{folder}/archives/{name}"], "n_records": [n]}, schema)
        if out is not None:
            out.close()
            yield to_batch({"file": [f"{folder}/archives/{name}"], "n_records": [n]}, schema)

    decided.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of a written folder; digests of responses are computed anew and must agree."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])

    def rows(file: str) -> Iterator[tuple]:
        system, at = fs.FileSystem.from_uri(file)
        with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as source:
            for headers, block in records(source):
                http, _, body = block.partition(b"\r\n\r\n")
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if kind == "response" and (size != len(body) or _digest(body) != digest):
                    raise ValueError(f"{file}: {headers['warc-record-id']} does not have the payload that its headers name")
                yield page_of(headers["warc-record-id"]), size, digest, kind, page_of(headers["warc-refers-to"]) if kind == "revisit" else None, headers["warc-target-uri"], headers["warc-record-id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held: list[tuple] = []
                for row in rows(file):
                    held.append(row)
                    if len(held) == 4096:
                        yield to_batch(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)
                        held = []
                if held:
                    yield to_batch(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count(), 1)  # files are large
    return manifest.repartition(n, "file").mapInArrow(run, HEADERS)


def warc_round_trip(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes deduplicated archives of all rows and reads them back: a row per record.

    A null html has the empty payload; null ids and urls are kept (ids as null,
    urls as about:blank); repeated rows have a record each; an empty table writes
    no archive and gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "warc")
    write_archives(df, folder, id_col, url_col, html_col)
    return read_archives(spark, folder)
