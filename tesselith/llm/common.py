"""Helpers that the corpus operators share: stored tables, batching, joins of uneven keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.sources.shared import new_path, remove

__all__ = ["join_counted", "new_path", "release", "remove", "steps", "stored", "to_batch"]

#: Bytes of text that one Python step holds as word lists at a time.
STEP_BYTES = 4 << 20


#: Rows that Spark hands to Python at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """The frame written as Parquet to the shared folder and read back, and its path.

    This cuts the lineage without tying blocks to executors. Where rows are wide,
    `batch_rows` keeps the batches that go to Python and back small meanwhile.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path), path


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` bytes of text, one row at least."""
    lengths = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(lengths), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def release() -> None:
    """Gives memory that a task has freed back to the system, for Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside of glibc
    if trim is not None:
        trim(0)


def to_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the schema, from lists or arrays by column name."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


#: A key with over this share of the rows is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1 / 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row per key and, in `count`, how many rows have it.

    Keys with over HOT_SHARE of all rows (fewer than 1000) are joined by
    broadcast, so that no task gets all rows of such a key; the others by a
    shuffle. `rows` and `table` are read twice and should be stored tables.
    """
    hot = table.where(F.col(count) > total * HOT_SHARE)
    cold = table.where(F.col(count) <= total * HOT_SHARE)
    first = rows.join(F.broadcast(hot), key)
    return first.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
