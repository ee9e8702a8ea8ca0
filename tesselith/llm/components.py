"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import join_counted, remove, stored, to_batch

#: Links that a task contracts together before anything is shuffled.
CONTRACTED = 1_000_000
#: Links from which on those of a node with very many are dealt to all tasks.
MANY_LINKS = 1_000_000
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a stretch replaced by a star around each of its components' least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(root(x), x) for x in parent]
        pairs = [(r, x) for r, x in pairs if r != x]
        return to_batch(dict(zip("ab", np.array(pairs, np.int64).reshape(-1, 2).T, strict=True)), LINKS)

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > CONTRACTED:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node that has a link.

    Links (a, b: long) are contracted task by task, then large-star and
    small-star steps alternate until nothing changes, each written to the shared
    folder. Nothing but counts reaches the driver. A link of a node to itself, a
    null and a repeated link do no harm.
    """
    edges, path = stored(links.select("a", "b").where("a is not null and b is not null and a != b").mapInArrow(_contract, "a long, b long").distinct(), "component-links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: larger neighbours of a node go to the least of its surroundings
        large = _join(both.where("b > a"), least, 2 * state[0]).select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: a node's smaller neighbours, and itself, likewise
        smaller, small_path = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "component-large")
        least = smaller.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _join(smaller, least, 2 * state[0]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        next_, next_path = stored(small, "component-links")
        remove(links.sparkSession, small_path)
        remove(links.sparkSession, path)
        edges, path, before, state = next_, next_path, state, _state(next_)
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _join(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links and what is known of their node a; of many links, those of a hub are not joined by one task."""
    return join_counted(links, least, "a", "n", total) if total >= MANY_LINKS else links.join(least, "a")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
