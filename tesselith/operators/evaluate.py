"""From scans to results."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.functions import mask_has, mask_or, mask_union, reconstruct
from tesselith.metadata.layout import Layout
from tesselith.metadata.schema import TID
from tesselith.plans.query import BoundQuery, bits
from tesselith.plans.scans import Scan, ScanPlan, estimated_rows
from tesselith.sources.scan import filtered, merged, typed

PASSED, DIRECT, VALID = "__passed", "__direct", "__valid"
_FINAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _evaluated(df: DataFrame, query: BoundQuery, there: dict[str, Column]) -> DataFrame:
    """Group columns, and each measure's argument where `there` holds; rows without any go.

    Residual columns belong to every measure, so where one is there the residual
    can be tested.
    """
    df = df.where(reduce(or_, there.values()))
    if query.residual:
        df = df.where(F.expr(query.residual))
    names = {m.name: f"__m{i}" for i, m in enumerate(query.measures)}
    return df.select(*query.group_by, *[F.when(there[m.name], F.expr(m.expression)).alias(names[m.name]) for m in query.measures])


def direct_rows(spark: SparkSession, layout: Layout, query: BoundQuery, scans: Iterable[Scan]) -> list[DataFrame]:
    """Measures evaluated on single blocks; no shuffle, and tid is not read."""
    out = []
    for scan, ids in merged(scans):
        df = filtered(spark, layout, scan, ids)
        df = df.select(*[typed(layout, c, c in scan.columns) for c in query.columns])
        there = {m.name: F.lit(bool(scan.direct >> i & 1)) for i, m in enumerate(query.measures)}
        out.append(_evaluated(df, query, there))
    return out


def _fragments(spark: SparkSession, layout: Layout, query: BoundQuery, scans: Iterable[Scan], columns: tuple[str, ...]) -> list[DataFrame]:
    """tid, masks and columns of each scan; a cell that is not stored there is null."""
    out = []
    for scan, ids in merged(scans):
        df = filtered(spark, layout, scan, ids)
        out.append(df.select(TID, _long(scan.passed).alias(PASSED), _long(scan.direct).alias(DIRECT), _long(bits(set(scan.columns) & set(columns), columns)).alias(VALID), *[typed(layout, c, c in scan.columns) for c in columns]))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _sortable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def by_aggregation(spark: SparkSession, layout: Layout, query: BoundQuery, scans: list[Scan], columns: tuple[str, ...]) -> DataFrame:
    """Tuples put together by grouping on tid: one shuffle, combined before it."""
    rows = _union(_fragments(spark, layout, query, scans, columns))
    return rows.groupBy(TID).agg(mask_union(PASSED).alias(PASSED), mask_union(DIRECT).alias(DIRECT), mask_union(VALID).alias(VALID), *[reconstruct(c, _sortable(layout.schema[c].type)).alias(c) for c in columns])


class MiniTables:
    """Scans of one component as tables of one row per tuple, in join order, and what a tuple needs to be of use.

    Each table has all scans, of those that are left, with the column of which
    most tuples qualify; a cell is stored once, so their tuples differ. A tuple
    is of use if it can get all columns of some set in `wanted`, and pass all
    `filters`; `helpers` are masks that are joined later.
    """

    def __init__(self, layout: Layout, scans: list[Scan], wanted: list[set[str]], filters: int, helpers: Iterable[Scan] = ()):
        self.wanted, self.filters, self.helpers = wanted, filters, list(helpers)
        self.tables: list[list[Scan]] = []
        rest = [(s, estimated_rows(s, layout)) for s in scans]
        while rest:
            held: dict[str, float] = {}
            for s, n in rest:
                for c in s.columns:
                    held[c] = held.get(c, 0.0) + n
            first = max(sorted(held), key=held.__getitem__)
            self.tables.append([s for s, _ in rest if first in s.columns])
            rest = [x for x in rest if first not in x[0].columns]
        # tables that a tuple has to be in come first: the joins after them need not be full, and keep the partitioning
        first = [self.needed([k]) for k in range(len(self.tables))]
        self.tables = [t for t, x in zip(self.tables, first, strict=True) if x] + [t for t, x in zip(self.tables, first, strict=True) if not x]

    def columns(self, numbers: Iterable[int]) -> set[str]:
        return {c for k in numbers for s in self.tables[k] for c in s.columns}

    def needed(self, numbers: Iterable[int]) -> bool:
        """Whether a tuple in none of these tables is of no use: others lack a column of every wanted set, or pass too few filters."""
        numbers = set(numbers)
        others = [k for k in range(len(self.tables)) if k not in numbers]
        elsewhere = self.columns(others)
        if all(w - elsewhere for w in self.wanted):
            return True
        # a helper of a block has no tuple that the block's own scan lacks
        own = {(s.partition, s.block.block_id) for k in numbers for s in self.tables[k]}
        passed = [s.passed for k in others for s in self.tables[k]] + [s.passed for s in self.helpers if (s.partition, s.block.block_id) not in own]
        return reduce(or_, passed, 0) & self.filters != self.filters

    def join_type(self, k: int) -> str:
        """How table k joins those before it."""
        right, left = self.needed([k]), self.needed(range(k))
        return "inner" if left and right else "left" if left else "right" if right else "full_outer"


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on tid; a cell comes from the side that stores it, masks are united. But for full joins, the side that stays keeps its partitioning."""
    left, right = set(a.columns), set(b.columns)
    a, b = a.alias("l"), b.alias("r")
    tid = {"inner": F.col(f"l.{TID}"), "left": F.col(f"l.{TID}"), "right": F.col(f"r.{TID}")}.get(how, F.coalesce(F.col(f"l.{TID}"), F.col(f"r.{TID}")))
    masks = [mask_or(F.col(f"l.{m}"), F.col(f"r.{m}")).alias(m) for m in (PASSED, DIRECT, VALID)]
    cells = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) if c in left and c in right else F.col(f"l.{c}" if c in left else f"r.{c}").alias(c) for c in sorted((left | right) - {TID, PASSED, DIRECT, VALID})]
    return a.join(b, F.col(f"l.{TID}") == F.col(f"r.{TID}"), how).select(tid.alias(TID), *masks, *cells)


def _joined(spark: SparkSession, layout: Layout, query: BoundQuery, mini: MiniTables, columns: tuple[str, ...], direct: bool) -> DataFrame:
    """The component's tables joined one by one; between joins go the tuples that no wanted set can be had of any more.

    With `direct`, the wanted sets are the measures, of which those do not count
    that a direct read contributes.
    """
    out = None
    for k, table in enumerate(mini.tables):
        own = mini.columns([k])
        rows = _union(_fragments(spark, layout, query, table, columns)).drop(*(c for c in columns if c not in own))
        out = rows if out is None else _join(out, rows, mini.join_type(k))
        later = mini.columns(range(k + 1, len(mini.tables)))
        settled = [w - later for w in mini.wanted]
        if later and all(settled):
            alive = [mask_has(F.col(VALID), bits(w, columns)) & ((F.col(DIRECT).bitwiseAND(_long(1 << i)) == 0) if direct else F.lit(True)) for i, w in enumerate(settled)]
            out = out.where(reduce(or_, alive))
    return out.select(TID, PASSED, DIRECT, VALID, *[typed(layout, c, c in out.columns) for c in columns])


def by_joins(spark: SparkSession, layout: Layout, query: BoundQuery, plan: ScanPlan, columns: tuple[str, ...], direct: bool) -> DataFrame:
    """Tuples put together by joins, component by component, then the helpers' masks by a left join.

    Components over the same partitions are joined as one, so the plan does not
    grow with blocks; a tuple that lies in several is put together once. A block's
    own scan has the masks that it gives as a helper, so a component's blocks help
    others only.
    """
    together: dict[frozenset[int], list[Scan]] = {}
    for c in plan.components:
        together.setdefault(frozenset(s.partition for s in c), []).extend(c)
    components = list(together.values())
    wanted = [set(m.columns) for m in query.measures] if direct else [set(columns)]
    place = lambda s: (s.partition, s.block.block_id)
    members = [set(map(place, c)) for c in components]
    helpers = [s for s in plan.helpers if any(place(s) not in m for m in members)]
    every = bits(query.filters, query.filters)
    rows = _union([_joined(spark, layout, query, MiniTables(layout, c, wanted, every, helpers), columns, direct) for c in components])
    if not helpers:
        return rows
    masks = _union(_fragments(spark, layout, query, helpers, ())).groupBy(F.col(TID).alias("__tid")).agg(mask_union(PASSED).alias("__more"))
    return rows.join(masks, F.col(TID) == F.col("__tid"), "left").withColumn(PASSED, mask_or(F.col(PASSED), F.col("__more"))).drop("__tid", "__more")


def late_rows(spark: SparkSession, layout: Layout, query: BoundQuery, plan: ScanPlan, how: str) -> list[DataFrame]:
    """Rebuilt tuples that pass all filters, with the measures that no direct read contributes."""
    if not plan.components:
        return []
    columns = query.columns
    rows = by_aggregation(spark, layout, query, plan.rebuild, columns) if how == "agg" else by_joins(spark, layout, query, plan, columns, True)
    rows = rows.where(mask_has(F.col(PASSED), bits(query.filters, query.filters)))
    there = {m.name: mask_has(F.col(VALID), bits(m.columns, columns)) & (F.col(DIRECT).bitwiseAND(_long(1 << i)) == 0) for i, m in enumerate(query.measures)}
    return [_evaluated(rows, query, there)]


def early_rows(spark: SparkSession, layout: Layout, query: BoundQuery, plan: ScanPlan, how: str) -> list[DataFrame]:
    """All tuples rebuilt first; those stay that have every referenced column, each filtered where it is stored."""
    if not plan.rebuild:
        return []
    columns = query.referenced
    rows = by_aggregation(spark, layout, query, plan.rebuild, columns) if how == "agg" else by_joins(spark, layout, query, plan, columns, False)
    rows = rows.where(mask_has(F.col(VALID), bits(columns, columns)))
    return [_evaluated(rows, query, {m.name: F.lit(True) for m in query.measures})]


def final(spark: SparkSession, layout: Layout, query: BoundQuery, rows: list[DataFrame]) -> DataFrame:
    """The query's result: partial sums per task, then one row, or one per group."""
    if not rows:  # no block qualifies: SQL's answer to no rows
        empty = spark.createDataFrame([], layout.schema.struct(query.columns))
        rows = [_evaluated(empty, query, {m.name: F.lit(True) for m in query.measures})]
    together = _union(rows)
    measure = lambda i, m: _FINAL[m.aggregate](f"__m{i}").alias(m.name)
    columns = [measure(i, m) for i, m in enumerate(query.measures)]
    return together.groupBy(*query.group_by).agg(*columns) if query.group_by else together.agg(*columns)


def plain(spark: SparkSession, df: DataFrame, query: BoundQuery) -> DataFrame:
    """The same query over the whole table, for comparison."""
    if query.boundary is None:
        df = df.where(F.lit(False))
    elif (condition := query.boundary.column()) is not None:
        df = df.where(condition)
    if query.residual:
        df = df.where(F.expr(query.residual))
    columns = [_FINAL[m.aggregate](F.expr(m.expression)).alias(m.name) for m in query.measures]
    return df.groupBy(*query.group_by).agg(*columns) if query.group_by else df.agg(*columns)


