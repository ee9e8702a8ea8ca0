"""Scans of blocks as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.metadata.layout import Layout
from tesselith.metadata.schema import BLOCK_ID, TID
from tesselith.plans.scans import Scan


def read_blocks(spark: SparkSession, layout: Layout, partition: int, ids: Iterable[int] | None = None) -> DataFrame:
    """Blocks of one partition. Block ids are folders, so others are not even listed for reading."""
    p, ids = layout.partitions[partition], None if ids is None else sorted(ids)
    stored = T.StructType([T.StructField(TID, T.LongType()), *layout.schema.struct(p.columns), T.StructField(BLOCK_ID, T.IntegerType())])
    df = spark.read.schema(stored).parquet(p.path)
    if ids is None or len(ids) == len(p.blocks):
        return df
    return df.where(f"{BLOCK_ID} in ({', '.join(map(str, map(int, ids)))})" if ids else "false")


def merged(scans: Iterable[Scan]) -> list[tuple[Scan, list[int]]]:
    """Scans that differ in the block alone as one read, so the plan grows with partitions, not blocks."""
    groups: dict[tuple, tuple[Scan, list[int]]] = {}
    for s in scans:
        groups.setdefault(s.key(), (s, []))[1].append(s.block.block_id)
    return list(groups.values())


def filtered(spark: SparkSession, layout: Layout, scan: Scan, ids: list[int]) -> DataFrame:
    """The rows that pass the scan's predicates and lie where others need them."""
    df = read_blocks(spark, layout, scan.partition, ids)
    for condition in (scan.box.column(), scan.regions.column() if scan.regions else None):
        if condition is not None:
            df = df.where(condition)
    return df


def typed(layout: Layout, name: str, there: bool):
    """The column, or a typed null."""
    return F.col(name) if there else F.lit(None).cast(layout.schema[name].type).alias(name)
