"""Materialising a layout: tuple ids once, then each partition's blocks as folders of Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.errors import PlanError
from tesselith.metadata.boundary import Boundary
from tesselith.metadata.index import CutTree
from tesselith.metadata.interval import Interval
from tesselith.metadata.layout import Block, Layout, Partition
from tesselith.metadata.schema import BLOCK_ID, TID, Schema
from tesselith.sources.shared import remove


#: Blocks of a partition that are told apart by nested conditions; more are walked through.
NESTED = 32


def table_stats(df: DataFrame) -> tuple[Boundary, frozenset[str], int]:
    """Least and largest value by column, the columns with nulls, and the row count: one pass."""
    ranged = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)) and f.name != TID]
    parts = [F.count(F.lit(1)).alias("n")]
    for f in df.schema:
        parts.append((F.count(F.lit(1)) - F.count(f.name)).alias(f"nulls:{f.name}"))
    for name in ranged:
        parts += [F.min(name).alias(f"low:{name}"), F.max(name).alias(f"high:{name}")]
    row = df.agg(*parts).first().asDict()
    domain = Boundary({c: Interval(row[f"low:{c}"], row[f"high:{c}"]) for c in ranged if row[f"low:{c}"] is not None})
    return domain, frozenset(f.name for f in df.schema if row[f"nulls:{f.name}"]), row["n"]


def with_tid(df: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """The table with a tuple id, written once and read back, so that all blocks derive from the same ids.

    `key` names a unique column to serve as the id; else one is assigned.
    """
    tid = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    df.withColumn(TID, tid).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def inside(boundary: Mapping[str, Interval], nullable: frozenset[str]) -> Column:
    """Whether a row lies in a boundary; a null lies where there is no lower end."""
    parts = []
    for a, x in sorted(boundary.items()):
        c = x.column(a)
        if c is not None:
            parts.append(c if a not in nullable else F.coalesce(c, F.lit(x.low is None)))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


class _Steps:
    """The blocks of a partition as one-attribute tests that lead from step to step, after a tree of cuts.

    Step k compares attribute `attribute[k]` with `value[k]`: below (or equal, if
    `equal[k]`) leads to `yes[k]`, above to `no[k]`; a null goes to `yes[k]` where
    `null[k]`. Targets from 0 on are steps, others are -1 (done). `hit[k]` is the
    block that a row lies in if it takes the side `side[k]`.
    """

    def __init__(self, blocks: list[Block]):
        self.blocks, self.rows = blocks, []
        self.depth = self._add(CutTree([b.boundary for b in blocks]), Boundary())

    def _add(self, tree: CutTree, region: Boundary) -> int:
        """Appends the tree's steps, the first of them next in line; the longest way through them."""
        if not tree.cut:
            return self._tests([(self.blocks[i].block_id, Boundary({a: x for a, x in self.blocks[i].boundary.items() if not x.covers(region.of(a))})) for i in tree.members])
        name, value, first = tree.cut
        row = [name, value, first, True, len(self.rows) + 1, None, None, None]
        self.rows.append(row)
        depths = []
        for side, x in zip(tree.sides, tree.halves(), strict=True):
            row[5] = len(self.rows)
            depths.append(self._add(side, Boundary(region | {name: region.of(name).intersection(x) or x})))
        return 1 + max(depths)

    def _tests(self, members: list[tuple[int, Boundary]]) -> int:
        """Steps that test a leaf's blocks one after another; each has one at least."""
        begun = len(self.rows)
        for place, (block, rest) in enumerate(members):
            tests = [(a, v, equal, low) for a, x in sorted(rest.items()) for v, equal, low in ((x.low, x.low_open, True), (x.high, not x.high_open, False)) if v is not None]
            after = len(self.rows) + max(len(tests), 1)
            after = after if place + 1 < len(members) else -1
            if not tests:  # nothing is left to be tested: any row lies in it
                self.rows.append([None, None, False, False, after, after, block, None])
            for k, (a, v, equal, low) in enumerate(tests):
                on = len(self.rows) + 1 if k + 1 < len(tests) else after
                hit = block if k + 1 == len(tests) else None
                # a lower end: below lies outside, and nulls with it; an upper one: nulls are inside if there is no lower end
                self.rows.append([a, v, equal, True, after, on, hit, False] if low else [a, v, equal, rest[a].low is None, on, after, hit, True])
        if not members:
            self.rows.append([None, None, False, False, -1, -1, None, None])
        return len(self.rows) - begun

    def column(self) -> Column:
        """A struct of the first block that a row lies in (or null) and the number of blocks it lies in; the plan's size does not grow with blocks but for constant arrays."""
        names = sorted({r[0] for r in self.rows if r[0] is not None})
        values: dict[str, dict] = {a: {} for a in names}
        at = [values[r[0]].setdefault(r[1], len(values[r[0]])) if r[0] is not None else 0 for r in self.rows]
        numbers = lambda x: F.split(F.lit(",".join(str(int(v)) for v in x)), ",").cast("array<int>")
        attribute = numbers(names.index(r[0]) if r[0] is not None else -1 for r in self.rows)
        equal, null, yes, no, place = (numbers(x) for x in ([r[2] for r in self.rows], [r[3] for r in self.rows], [r[4] for r in self.rows], [r[5] for r in self.rows], at))
        hit = numbers(-1 if r[6] is None else r[6] for r in self.rows)
        side = numbers(2 if r[7] is None else int(r[7]) for r in self.rows)
        cuts = [F.array(*map(F.lit, values[a])) for a in names]

        def step(acc: Column, _: Column) -> Column:
            k = acc["step"]
            below = F.lit(True)
            for i, a in enumerate(names):
                cut = F.get(cuts[i], F.get(place, k))
                below = F.when(F.get(attribute, k) == i, F.coalesce((F.col(a) < cut) | ((F.get(equal, k) == 1) & (F.col(a) == cut)), F.get(null, k) == 1)).otherwise(below)
            took = F.when(below, F.lit(1)).otherwise(F.lit(0))
            lies = (F.get(hit, k) >= 0) & ((F.get(side, k) == 2) | (F.get(side, k) == took))
            on = F.struct(
                F.when(below, F.get(yes, k)).otherwise(F.get(no, k)).alias("step"),
                F.when(lies & acc["block"].isNull(), F.get(hit, k)).otherwise(acc["block"]).alias("block"),
                (acc["n"] + F.when(lies, F.lit(1)).otherwise(F.lit(0))).alias("n"),
            )
            return F.when(k < 0, acc).otherwise(on)

        start = F.struct(F.lit(0).alias("step"), F.lit(None).cast("int").alias("block"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), start, step, lambda acc: F.struct(acc["block"].alias("block"), acc["n"].alias("n")))


def located(blocks: Iterable[Block], nullable: frozenset[str]) -> Column:
    """A struct of `block`, the id of the first block that a row lies in, or null, and `n`, in how many it lies.

    Few blocks are nested conditions, which are compiled; many are walked through
    along a tree of cuts, so that a row is tested against few of them.
    """
    blocks = list(blocks)
    if len(blocks) > NESTED:
        return _Steps(blocks).column()
    first, n = F.lit(None).cast("int"), F.lit(0)
    for b in reversed(blocks):
        here = inside(b.boundary, nullable)
        first = F.when(here, F.lit(b.block_id)).otherwise(first)
        n = n + F.when(here, F.lit(1)).otherwise(F.lit(0))
    return F.struct(first.alias("block"), n.alias("n"))


def check_cells(base: DataFrame, partitions: list[Partition], schema: Schema, nullable: frozenset[str]) -> None:
    """Raises unless every (row, column) cell lies in exactly one block; one pass over the base.

    Columns that the same blocks hold are counted as one; blocks of a partition
    that overlap in a row count as often as the row lies in them.
    """
    holders = {c: tuple(i for i, p in enumerate(partitions) if c in p.columns) for c in schema}
    wrong = sorted(c for c, own in holders.items() if not own)
    if wrong:
        raise PlanError(f"columns that no block holds: {', '.join(wrong)}")
    groups = sorted(set(holders.values()))
    if not groups:
        return
    within = base.select([located(p.blocks, nullable)["n"].alias(f"__in{i}") for i, p in enumerate(partitions)])
    sums = [F.count(F.when(reduce(Column.__add__, [F.col(f"__in{i}") for i in g]) != 1, 1)).alias(f"w{k}") for k, g in enumerate(groups)]
    counts = within.agg(*sums).first()
    bad = {c: counts[groups.index(g)] for c, g in holders.items() if counts[groups.index(g)]}
    if bad:
        raise PlanError(f"rows by column that are not stored once: {bad}")


def write_layout(df: DataFrame, partitions: Iterable[Partition], path: str, key: str | None = None, widths: dict[str, int] | None = None, complete: bool = True) -> Layout:
    """Writes a table by a layout and its catalog (path/layout.json).

    Rows of a partition are dealt by block, large blocks over several tasks, so
    that a block is a few files of even size. Row counts are those written.
    With `complete`, every (tuple, column) cell has to be stored exactly once:
    that is tested on every row before anything is written.
    """
    spark, partitions = df.sparkSession, list(partitions)
    base = with_tid(df, f"{path}/base", key)
    schema = Schema.of(df.schema, widths)
    if TID in schema or BLOCK_ID in schema:
        raise PlanError(f"columns may not be named {TID} or {BLOCK_ID}")
    domain, nullable, rows = table_stats(base)
    if complete:
        check_cells(base, partitions, schema, nullable)
    written = []
    for p in partitions:
        out = f"{path}/{p.name}"
        dealt = base.withColumn(BLOCK_ID, located(p.blocks, nullable)["block"]).where(F.col(BLOCK_ID).isNotNull()).select(TID, *p.columns, BLOCK_ID)
        dealt.hint("rebalance", BLOCK_ID).write.mode("overwrite").partitionBy(BLOCK_ID).parquet(out)
        counts = {r[0]: r[1] for r in spark.read.schema(T.StructType([T.StructField(TID, T.LongType()), T.StructField(BLOCK_ID, T.IntegerType())])).parquet(out).groupBy(BLOCK_ID).count().collect()}
        written.append(replace(p, path=out, blocks=tuple(replace(b, rows=counts.get(b.block_id, 0)) for b in p.blocks)))
    layout = Layout(schema, written, domain, nullable, rows)
    save_layout(spark, layout, f"{path}/layout.json")
    remove(spark, f"{path}/base")
    return layout


def save_layout(spark, layout: Layout, path: str) -> None:
    """Writes the catalog by Spark's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(layout.to_json().encode())
    finally:
        out.close()


def load_layout(spark, path: str) -> Layout:
    """Reads a catalog that save_layout() wrote."""
    return Layout.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
