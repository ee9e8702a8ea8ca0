"""Registered queries of the set operations on intervals, boxes and blocks, and of the cost model, each with its SQL.

The operands are derived from the tables (a box per nation, the blocks of a
layout), so there are few; the operations run where the planner runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.api import Measure, Predicate, Query
from tesselith.errors import IntervalError
from tesselith.metadata.boundary import Boundary, ComplexBoundary
from tesselith.metadata.interval import Interval
from tesselith.metadata.layout import Layout
from tesselith.partition.cost import CostModel, io_cost, query_cost
from tesselith.sources.scan import read_blocks

#: One sum on a block's own column, and one that spans two groups of columns of the layout `vertical`.
SPANNING = Query([Measure("quantity", "sum", "l_quantity"), Measure("discounted", "sum", "l_extendedprice * l_discount")])
FILTERED = Query([Measure("revenue", "sum", "l_extendedprice")], [Predicate("l_quantity", ">=", 30.0), Predicate("l_discount", "<=", 0.05)])
#: The box that blocks of the layout `stripes` are held against.
BOX = {"l_quantity": Interval(15.0, 33.0)}
_STRIPES = "(VALUES (0, 1.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 30.0), (3, 30.0, 40.0), (4, 40.0, 50.0))"


def _boxes(spark: SparkSession, sf_dir: str) -> list[tuple[int, Boundary]]:
    """The suppliers of each nation as a box of keys and balances; at most a row per nation."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.min("s_suppkey"), F.max("s_suppkey"), F.min("s_acctbal"), F.max("s_acctbal"))
    return [(r[0], Boundary({"s_suppkey": Interval(r[1], r[2]), "s_acctbal": Interval(r[3], r[4])})) for r in rows.collect()]


def _ends(x: Interval | None) -> tuple:
    return (None, None) if x is None else (x.low, x.high)


def interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation, intersection, union and share of every two nations' key intervals."""
    own = [(k, b["s_suppkey"]) for k, b in _boxes(spark, sf_dir)]
    rows = [(i, j, a.relation(b).value, *_ends(a.intersection(b)), *_ends(a.union(b)), round(a.ratio(b), 6)) for i, a in own for j, b in own]
    return spark.createDataFrame(rows, "a int, b int, relation string, low long, high long, union_low long, union_high long, share double")


def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's key interval cut at the middle of all, which goes to the first or to the second part."""
    own = [(k, b["s_suppkey"]) for k, b in _boxes(spark, sf_dir)]
    whole = own[0][1]
    for _, x in own:
        whole = whole.union(x)
    rows = []
    for k, x in own:
        for first in (True, False):
            parts = x.split(whole.middle(), first)
            rows.append((k, first, *(_ends(parts[0]) + _ends(parts[1]) if parts else (None,) * 4)))
    return spark.createDataFrame(rows, "nation int, first boolean, low_1 long, high_1 long, low_2 long, high_2 long")


def boundary_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operations on every two nations' boxes, and the relation of the boxes cut down to the keys."""
    own, rows = _boxes(spark, sf_dir), []
    for i, a in own:
        for j, b in own:
            try:
                common = a.intersection(b)
            except IntervalError:
                common = None
            keys = a.keep(["s_suppkey"]).relation(b.keep(["s_suppkey"])).value
            inside = _ends(common["s_suppkey"]) + _ends(common["s_acctbal"]) if common else (None,) * 4
            both = a.union(b)
            rows.append((i, j, a.relation(b).value, keys, *inside, *_ends(both["s_suppkey"]), *_ends(both["s_acctbal"]), round(a.ratio(b, {}), 6)))
    columns = "a int, b int, relation string, key_relation string, low_key long, high_key long, low_balance double, high_balance double, union_low_key long, union_high_key long, union_low_balance double, union_high_balance double, share double"
    return spark.createDataFrame(rows, columns)


def complex_boundary_intersection(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """Rows of a cover of disjoint boxes, cut down to another box, and the share of that box that it has."""
    cover = ComplexBoundary.of_boxes([{"l_suppkey": Interval(lo, lo + 1), "l_quantity": Interval(5.0, 45.0)} for lo in (1, 2, 5, 7)])
    box = Boundary({"l_suppkey": Interval(2, 7), "l_discount": Interval(0.02, 0.08)})
    rows = read_blocks(spark, layout, 0).where(cover.intersection(box).column())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines")).withColumn("share", F.round(F.lit(cover.ratio_of(box, {"l_quantity": Interval(1.0, 50.0)})), 6))


def block_algebra(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """Each block against a box of rows and columns, its estimated rows there, its bytes, and its rows cut at 25."""
    rows = []
    for b in layout.partitions[0].blocks:
        parts = b.split("l_quantity", 25.0, True, layout.domain)
        split = [round(p.rows, 6) for p in parts] if parts else [None, None]
        rows.append((b.block_id, b.rows, b.relation(BOX, ["l_quantity", "l_discount"]).value, round(b.estimate_rows(Boundary(BOX), layout.domain), 6), int(b.io_bytes(["l_quantity", "l_discount"], layout.schema)), *split))
    return spark.createDataFrame(rows, "block_id int, n long, relation string, estimated double, bytes long, rows_1 double, rows_2 double")


def cost_of_blocks(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """Seconds by the cost model of a query that reads blocks directly, and the bytes of its columns in the blocks that it touches."""
    bound, model = FILTERED.bound(layout.schema), CostModel()
    touched = io_cost([b for _, b in layout.blocks()], [bound], layout)
    return spark.createDataFrame([(round(query_cost(layout, bound, model, True), 9), round(query_cost(layout, bound, model, False), 9), int(touched))], "late double, early double, touched long")


def cost_of_rebuilding(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """Seconds by the cost model of a query that rebuilds tuples from two groups of columns."""
    bound, model = SPANNING.bound(layout.schema), CostModel()
    return spark.createDataFrame([(round(query_cost(layout, bound, model, True), 9), round(query_cost(layout, bound, model, False), 9))], "late double, early double")


def queries(layout_of: Callable[[SparkSession, str, str], Layout]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (interval_algebra, interval_split, boundary_algebra)}
    for f, name in ((complex_boundary_intersection, "stripes"), (block_algebra, "stripes"), (cost_of_blocks, "stripes"), (cost_of_rebuilding, "vertical")):
        out[f.__name__] = lambda spark, sf_dir, f=f, name=name: f(spark, sf_dir, layout_of(spark, sf_dir, name))
    return out


def _relation(apart: str, equal: str, inside: str, around: str) -> str:
    return f"CASE WHEN {apart} THEN 'disjoint' WHEN {equal} THEN 'equal' WHEN {inside} THEN 'subset' WHEN {around} THEN 'superset' ELSE 'intersect' END"


def oracle_sql() -> dict[str, str]:
    boxes = "SELECT s_nationkey AS k, min(s_suppkey) AS lo, max(s_suppkey) AS hi, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier GROUP BY 1"
    key = {"apart": "(a.hi < b.lo OR b.hi < a.lo)", "equal": "(a.lo = b.lo AND a.hi = b.hi)", "inside": "(a.lo >= b.lo AND a.hi <= b.hi)", "around": "(a.lo <= b.lo AND a.hi >= b.hi)"}
    balance = {k: v.replace(".lo", ".least").replace(".hi", ".most") for k, v in key.items()}
    apart = f"({key['apart']} OR {balance['apart']})"
    share = f"CASE WHEN {key['apart']} THEN 0.0 ELSE (least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) * 1.0 / (a.hi - a.lo + 1) END"
    share_2 = f"CASE WHEN {balance['apart']} THEN 0.0 WHEN {balance['inside']} THEN 1.0 ELSE (least(a.most, b.most) - greatest(a.least, b.least)) / (a.most - a.least) END"
    both = {k: f"({key[k]} AND {balance[k]})" for k in ("equal", "inside", "around")}
    inside = "l_quantity BETWEEN 15 AND 33"
    stripes = f"SELECT s.id, s.lo, s.hi, (SELECT count(*) FROM lineitem WHERE (l_quantity > s.lo OR s.id = 0) AND l_quantity <= s.hi) AS n FROM {_STRIPES} AS s(id, lo, hi)"
    per_mib = "0.0111 / 1048576"
    return {
        "interval_algebra": f"WITH v AS ({boxes}) SELECT a.k AS a, b.k AS b, {_relation(**key)} AS relation, CASE WHEN NOT {key['apart']} THEN greatest(a.lo, b.lo) END AS low, CASE WHEN NOT {key['apart']} THEN least(a.hi, b.hi) END AS high, least(a.lo, b.lo) AS union_low, greatest(a.hi, b.hi) AS union_high, round(CAST({share} AS DOUBLE), 6) AS share FROM v a, v b",
        "interval_split": (
            f"WITH v AS ({boxes}), m AS (SELECT (min(lo) + (max(hi) - min(lo)) // 2) AS p FROM v) "
            "SELECT k AS nation, first, CASE WHEN cut THEN lo END AS low_1, CASE WHEN cut THEN p - CASE WHEN first THEN 0 ELSE 1 END END AS high_1, CASE WHEN cut THEN p + CASE WHEN first THEN 1 ELSE 0 END END AS low_2, CASE WHEN cut THEN hi END AS high_2 "
            "FROM (SELECT k, lo, hi, p, first, CASE WHEN first THEN lo <= p AND p < hi ELSE lo < p AND p <= hi END AS cut FROM v, m, (VALUES (true), (false)) AS f(first))"
        ),
        "boundary_algebra": (
            f"WITH v AS ({boxes}) SELECT a.k AS a, b.k AS b, {_relation(apart=apart, **both)} AS relation, {_relation(**key)} AS key_relation, "
            f"CASE WHEN NOT {apart} THEN greatest(a.lo, b.lo) END AS low_key, CASE WHEN NOT {apart} THEN least(a.hi, b.hi) END AS high_key, CASE WHEN NOT {apart} THEN greatest(a.least, b.least) END AS low_balance, CASE WHEN NOT {apart} THEN least(a.most, b.most) END AS high_balance, "
            f"least(a.lo, b.lo) AS union_low_key, greatest(a.hi, b.hi) AS union_high_key, least(a.least, b.least) AS union_low_balance, greatest(a.most, b.most) AS union_high_balance, round(CAST(({share}) * ({share_2}) AS DOUBLE), 6) AS share FROM v a, v b"
        ),
        "complex_boundary_intersection": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(5.0 / 6 * 40 / 49, 6) AS share FROM lineitem WHERE (l_suppkey BETWEEN 2 AND 3 OR l_suppkey BETWEEN 5 AND 7) AND l_quantity BETWEEN 5 AND 45 AND l_discount BETWEEN 0.02 AND 0.08",
        "block_algebra": (
            f"SELECT id AS block_id, n, CASE WHEN hi < 15 OR lo >= 33 THEN 'disjoint' ELSE 'intersect' END AS relation, round(CAST(n * greatest(least(hi, 33) - greatest(lo, 15), 0) / (hi - lo) AS DOUBLE), 6) AS estimated, n * 16 AS bytes, "
            f"CASE WHEN lo < 25 AND hi > 25 THEN round(CAST(n * (25 - lo) / (hi - lo) AS DOUBLE), 6) END AS rows_1, CASE WHEN lo < 25 AND hi > 25 THEN round(CAST(n * (hi - 25) / (hi - lo) AS DOUBLE), 6) END AS rows_2 FROM ({stripes})"
        ),
        "cost_of_blocks": f"SELECT round(sum(CASE WHEN id = 2 THEN 24 WHEN id > 2 THEN 16 ELSE 0 END * n) * {per_mib}, 9) AS late, round(sum(CASE WHEN id >= 2 THEN 24 * n ELSE 0 END) * {per_mib}, 9) AS early, CAST(sum(CASE WHEN id >= 2 THEN 24 * n ELSE 0 END) AS BIGINT) AS touched FROM ({stripes})",
        "cost_of_rebuilding": "SELECT round(40 * n * 0.0111 / 1048576 + (0.7224 * 2 * n + 0.01 * 4 * n + 0.011 * 2 * n) / 1048576, 9) AS late, round(40 * n * 0.0111 / 1048576 + (0.3172 * 2 * n + 0.00419 * 6 * n + 0.0263 * 3 * n) / 1048576, 9) AS early FROM (SELECT count(*) * 1.0 AS n FROM lineitem)",
    }
