"""Shards of near-equal bytes by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.llm.common import join_counted, stored, to_batch

#: Groups that one task packs, tasks at most (beyond them each packs more), and bundles a shard is made of at least.
TASK_GROUPS, TASKS, BUNDLES = 50_000, 4096, 512
#: Keys in a leaf of the tree; a fuller leaf splits in two.
LEAF = 256


class RoomTree:
    """Open bins by (room, bin) in a two-level balanced tree of sorted leaves."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = [(0, 0)]

    def add(self, room: int, bin_: int) -> None:
        at = min(bisect_left(self.tops, (room, bin_)), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, (room, bin_))
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops[at : at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Takes out the tightest bin with room for the size (ties: the lower bin)."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves) or not self.leaves[at]:
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[at], self.tops[at]
        else:
            self.tops[0] = (0, 0)
        return found


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> Iterator[int]:
    """The bin of each size, given in descending order; a larger size than the capacity has a bin alone."""
    tree, bins = RoomTree(), 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            found, bins = (max(capacity, size), bins), bins + 1
        room, at = found
        if room > size:
            tree.add(room - size, at)
        yield at


def fewest_capacity(sizes: list[int], bins: int) -> list[int]:
    """The bin of each size under a capacity, found by bisection, for which best-fit decreasing needs at most `bins`.

    Of the capacities that bisection tries it is the least that suffices; as the
    rule may need more bins under a larger capacity, a smaller one can exist.
    A size over an even share of what is left has a bin alone, so that it does
    not leave the other bins to a few.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ranked = [sizes[i] for i in order]
    alone, rest = 0, sum(ranked)
    while alone < min(bins - 1, len(ranked)) and ranked[alone] * (bins - alone) > rest:
        rest -= ranked[alone]
        alone += 1
    ranked = ranked[alone:]
    low = max(-(-rest // (bins - alone)), max(ranked, default=0))
    high, best = 2 * low, None
    while low <= high:
        capacity = (low + high) // 2
        placed = list(best_fit_decreasing(ranked, capacity))
        if max(placed, default=0) < bins - alone:
            best, high = placed, capacity - 1
        else:
            low = capacity + 1
    if best is None:  # twice the bound always suffices: two bins that can't be joined hold more than a capacity
        raise AssertionError("best fit needs more bins than twice the bound allows")
    out = [0] * len(sizes)
    for i, b in zip(order, [*range(alone), *(alone + b for b in best)], strict=True):
        out[i] = b
    return out


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals documents to shards of near-equal bytes; documents of equal text stay together.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, law (`bytes`), shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Groups are summed by a digest of the text before anything is shuffled. Tasks
    of about TASK_GROUPS groups pack them by best fit decreasing into bundles of
    a 512th of a shard at most (a larger group is a bundle alone), so at most
    two bundles per such share and one per task (about 30,000 for 24 shards, of any
    table) reach the driver, which packs them by the same rule under the least
    capacity, found by bisection, that needs no more shards.
    Groups with over a thousandth of the rows, a thousand at most, are joined by
    broadcast, the rest by a shuffle. A null text has no bytes and groups with
    the empty text; null ids stay null; repeated rows get a slot each; an empty
    table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light, _ = stored(df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest")), "shard-rows")
    groups, _ = stored(light.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    count, total, rows = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("rows")).first()
    share = max(1, (total or 0) // (shards * BUNDLES))
    schema = pa.schema([("digest", pa.binary()), ("rows", pa.int64()), ("bytes", pa.int64()), ("bundle", pa.int64())])

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, packed = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            sizes = iter(batch.column("bytes").to_pylist())
            if packed is None:
                feed = [sizes]
                packed = best_fit_decreasing(iter(lambda: next(feed[0]), None), share)
            feed[0] = sizes
            at = np.fromiter((next(packed) for _ in range(len(batch))), np.int64, len(batch))
            yield to_batch({c: batch.column(c) for c in ("digest", "rows", "bytes")} | {"bundle": base + at}, schema)

    bundled, _ = stored(groups.repartition(min(-(-count // TASK_GROUPS) or 1, TASKS), "digest").sortWithinPartitions(F.desc("bytes"), "digest").mapInArrow(bundle, "digest binary, rows long, bytes long, bundle long"), "shard-bundles")
    items = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").toPandas()
    bins = fewest_capacity(items["bytes"].tolist(), shards)
    placed = spark.createDataFrame([(int(a), int(b)) for a, b in zip(items["bundle"], bins, strict=True)], "bundle long, shard int")
    by_digest = bundled.join(placed, "bundle").select("digest", "rows", "shard")
    dealt = join_counted(light, by_digest, "digest", "rows", rows or 0).select("doc_id", "size", "text_crc32", "shard")

    numbered_schema = T.StructType([*dealt.schema, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            ranked = shard[order]
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(shard, minlength=shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)], names=numbered_schema.names)

    numbered, _ = stored(dealt.mapInArrow(number, numbered_schema), "shard-numbered")
    # a row per task and shard: what the tasks before it have put there
    before = numbered.groupBy("part", "shard").agg((F.max("local") + 1).alias("n")).select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(before, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("local") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
