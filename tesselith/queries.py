"""Registered queries of the engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith import catalog_queries
from tesselith.api import Measure, Predicate, Query, run
from tesselith.functions import mask_and, mask_count, mask_get, mask_or, mask_union
from tesselith.metadata.boundary import ComplexBoundary
from tesselith.metadata.interval import Interval
from tesselith.metadata.layout import Layout, Partition, group
from tesselith.partition.choose import partition_table
from tesselith.plans.scans import plan_skipping
from tesselith.sources.scan import read_blocks
from tesselith.sources.shared import new_path, shared_dir
from tesselith.sources.writer import write_layout

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_D1998 = dt.datetime(1998, 1, 1)
_LOW, _HIGH = {"l_quantity": Interval(None, 25.0)}, {"l_quantity": Interval(25.0, None, True)}
_EARLIER, _LATER = {"l_shipdate": Interval(None, _D1998, False, True)}, {"l_shipdate": Interval(_D1998, None)}


def _rest(*used: str) -> tuple[str, ...]:
    return tuple(c for c in LINEITEM if c not in used)


def lineitem_layouts() -> dict[str, list[Partition]]:
    """Hand-made layouts: whole rows, columns apart, both irregularly, and a mix of wide and narrow blocks."""
    return {
        "regular": [group("all", LINEITEM, [_LOW, _HIGH])],
        "vertical": [group("qd", ("l_quantity", "l_discount")), group("et", ("l_extendedprice", "l_tax")), group("rest", _rest("l_quantity", "l_discount", "l_extendedprice", "l_tax"))],
        "irregular": [group("qd", ("l_quantity", "l_discount"), [_LOW, _HIGH]), group("et", ("l_extendedprice", "l_tax"), [_EARLIER, _LATER]), group("rest", _rest("l_quantity", "l_discount", "l_extendedprice", "l_tax"))],
        "mixed": [
            group("wide", ("l_quantity", "l_discount", "l_extendedprice"), [_HIGH]),
            group("qd", ("l_quantity", "l_discount"), [_LOW]),
            group("e", ("l_extendedprice",), [_LOW]),
            group("rest", _rest("l_quantity", "l_discount", "l_extendedprice")),
        ],
        "stripes": [group("all", LINEITEM, [{"l_quantity": Interval(lo, hi, lo is not None)} for lo, hi in ((None, 10.0), (10.0, 20.0), (20.0, 30.0), (30.0, 40.0), (40.0, None))])],
    }


def grid_layout(years: int = 7, quantities: int = 10) -> list[Partition]:
    """Many blocks: lines of a quarter and a range of quantities are cut into two groups of columns, the prices apart by quarter alone.

    The columns that queries use together lie in one block for half of the quantities, so those tuples need no rebuilding.
    """
    days = [dt.datetime(1995 + i // 4, 1 + 3 * (i % 4), 1) for i in range(4 * years)]
    quarters = [Interval(lo, hi, False, hi is not None) for lo, hi in zip([None, *days[1:]], [*days[1:], None], strict=True)]
    cuts = [50.0 * i / quantities for i in range(1, quantities)]
    ranges = [Interval(lo, hi, lo is not None) for lo, hi in zip([None, *cuts], [*cuts, None], strict=True)]
    low, high = [x for x in ranges if x.high is not None and x.high <= 25], [x for x in ranges if x.low is not None and x.low >= 25]
    cells = lambda own: [{"l_shipdate": q, "l_quantity": x} for q in quarters for x in own]
    return [
        group("wide", ("l_quantity", "l_discount", "l_extendedprice", "l_shipdate"), cells(high)),
        group("quantity", ("l_quantity", "l_discount"), cells(low)),
        group("price", ("l_extendedprice", "l_shipdate"), [{"l_shipdate": q, **_LOW} for q in quarters]),
        group("rest", _rest("l_quantity", "l_discount", "l_extendedprice", "l_shipdate"), [{"l_shipdate": q} for q in quarters]),
    ]


_written: dict[tuple[str, str, str], Layout] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], Layout]) -> Layout:
    """A layout written once per shared folder and input."""
    key = shared_dir(spark), sf_dir, name
    if key not in _written:
        _written[key] = make(new_path(spark, f"layout-{name}"))
    return _written[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout_of(spark: SparkSession, sf_dir: str, name: str) -> Layout:
    """lineitem in one of the layouts above."""
    return _once(spark, sf_dir, name, lambda path: write_layout(_table(spark, sf_dir, "lineitem"), grid_layout() if name == "grid" else lineitem_layouts()[name], path))


def _price(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


def _sum(name: str, sql: str) -> Measure:
    return Measure(name, "sum", sql)


REVENUE = Query([_sum("revenue", _price("l_extendedprice"))], [Predicate("l_quantity", ">=", 30.0), Predicate("l_discount", "<=", 0.05)])
PARTIAL = Query([_sum("price", _price("l_extendedprice")), _sum("rates", f"{_price('l_discount')} + {_price('l_tax')}"), Measure("n", "count")], [Predicate("l_quantity", ">=", 20.0), Predicate("l_discount", "<=", 0.05)])
MULTI = Query([_sum("price", _price("l_extendedprice")), _sum("quantity", _price("l_quantity")), _sum("charge", f"{_price('l_extendedprice')} * (1 - {_price('l_discount')})"), _sum("lines", "l_linenumber")], [Predicate("l_quantity", "<", 40.0), Predicate("l_shipdate", ">=", dt.datetime(1997, 6, 1))])
HELPER = Query([_sum("price", _price("l_extendedprice")), _sum("tax", _price("l_tax"))], [Predicate("l_suppkey", "<", 40), Predicate("l_quantity", ">", 25.0)])
COUNTS = Query([Measure("n", "count"), Measure("parts", "count", "l_partkey")], [Predicate("l_discount", "<=", 0.03), Predicate("l_shipdate", "<", _D1998)])
RANGES = Query([Measure("low", "min", "l_extendedprice"), Measure("high", "max", "l_extendedprice"), Measure("first", "min", "l_returnflag"), Measure("last", "max", "l_shipdate")], [Predicate("l_quantity", ">=", 10.0), Predicate("l_tax", "<=", 0.04)])
MEANS = Query([Measure("mean_line", "avg", "l_linenumber")], [Predicate("l_discount", "=", 0.05), Predicate("l_quantity", "<=", 30.0)])
GROUPS = Query([_sum("quantity", _price("l_quantity")), _sum("price", _price("l_extendedprice")), Measure("n", "count")], [Predicate("l_shipdate", "<", dt.datetime(2000, 1, 1))], group_by=("l_returnflag", "l_linestatus"))
RESIDUAL = Query([_sum("price", _price("l_extendedprice")), Measure("n", "count")], [Predicate("l_quantity", ">=", 15.0)], residual="(l_returnflag in ('A', 'R') or l_tax > 0.06) and l_linestatus like 'O%' and l_suppkey <> l_linenumber")
EMPTY = Query([_sum("revenue", _price("l_extendedprice")), Measure("n", "count")], [Predicate("l_quantity", ">", 1000.0)])
CONTRADICTION = Query([_sum("revenue", _price("l_extendedprice"))], [Predicate("l_quantity", ">", 30.0), Predicate("l_quantity", "<", 20.0)])
REPEATED = Query([_sum("revenue", _price("l_extendedprice"))], [Predicate("l_quantity", ">=", 35.0), Predicate("l_quantity", ">=", 10.0), Predicate.flipped(45.0, ">", "l_quantity")])
NARROW = Query([_sum("charge", f"{_price('l_extendedprice')} * (1 - {_price('l_discount')})"), _sum("quantity", _price("l_quantity"))], [Predicate("l_shipdate", ">=", dt.datetime(1997, 4, 1)), Predicate("l_shipdate", "<", dt.datetime(1998, 1, 1)), Predicate("l_quantity", ">", 15.0)])
NO_FILTER = Query([_sum("quantity", _price("l_quantity")), _sum("price", _price("l_extendedprice")), Measure("n", "count")])

#: Query, its money columns, and its SQL over lineitem.
_SQL_PRICE = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
WORKLOAD: dict[str, tuple[Query, str]] = {
    "sum": (REVENUE, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS revenue FROM lineitem WHERE l_quantity >= 30 AND l_discount <= 0.05"),
    "partial_direct": (PARTIAL, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS price, CAST(sum(CAST(l_discount AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS rates, count(*) AS n FROM lineitem WHERE l_quantity >= 20 AND l_discount <= 0.05"),
    "multi_measure": (MULTI, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS price, {_SQL_PRICE.format('l_quantity')} AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS charge, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_quantity < 40 AND l_shipdate >= TIMESTAMP '1997-06-01'"),
    "helper_block": (HELPER, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS price, {_SQL_PRICE.format('l_tax')} AS tax FROM lineitem WHERE l_suppkey < 40 AND l_quantity > 25"),
    "count": (COUNTS, "SELECT count(*) AS n, count(l_partkey) AS parts FROM lineitem WHERE l_discount <= 0.03 AND l_shipdate < TIMESTAMP '1998-01-01'"),
    "minmax": (RANGES, "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, min(l_returnflag) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_quantity >= 10 AND l_tax <= 0.04"),
    "avg": (MEANS, "SELECT round(avg(l_linenumber), 6) AS mean_line FROM lineitem WHERE l_discount = 0.05 AND l_quantity <= 30"),
    "group_by": (GROUPS, f"SELECT l_returnflag, l_linestatus, {_SQL_PRICE.format('l_quantity')} AS quantity, {_SQL_PRICE.format('l_extendedprice')} AS price, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL"),
    "residual": (RESIDUAL, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS price, count(*) AS n FROM lineitem WHERE l_quantity >= 15 AND (l_returnflag IN ('A', 'R') OR l_tax > 0.06) AND l_linestatus LIKE 'O%' AND l_suppkey <> l_linenumber"),
    "empty_range": (EMPTY, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS revenue, count(*) AS n FROM lineitem WHERE l_quantity > 1000"),
    "contradiction": (CONTRADICTION, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS revenue FROM lineitem WHERE l_quantity > 30 AND l_quantity < 20"),
    "repeated_predicate": (REPEATED, f"SELECT {_SQL_PRICE.format('l_extendedprice')} AS revenue FROM lineitem WHERE l_quantity >= 35 AND l_quantity >= 10 AND l_quantity < 45"),
    "narrow": (NARROW, f"SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS charge, {_SQL_PRICE.format('l_quantity')} AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-04-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 15"),
    "no_filter": (NO_FILTER, f"SELECT {_SQL_PRICE.format('l_quantity')} AS quantity, {_SQL_PRICE.format('l_extendedprice')} AS price, count(*) AS n FROM lineitem"),
}
#: Which of them run by which strategies over which layout.
RUNS: list[tuple[str, str, tuple[str, ...]]] = [
    ("sum", "irregular", ("late_agg", "late_join", "early_agg", "early_join")),
    ("partial_direct", "mixed", ("late_agg", "late_join", "early_agg", "early_join")),
    ("multi_measure", "irregular", ("late_agg", "late_join", "early_agg", "early_join")),
    ("helper_block", "vertical", ("late_agg", "late_join", "early_agg", "early_join")),
    ("count", "irregular", ("late_agg", "late_join")),
    ("minmax", "mixed", ("late_agg", "late_join")),
    ("avg", "mixed", ("late_agg", "early_agg")),
    ("group_by", "irregular", ("late_agg", "late_join", "early_agg", "early_join")),
    ("residual", "mixed", ("late_agg", "late_join", "early_agg")),
    ("empty_range", "irregular", ("late_agg", "late_join", "early_agg", "early_join")),
    ("contradiction", "mixed", ("late_agg", "early_join")),
    ("repeated_predicate", "irregular", ("late_agg", "late_join", "early_agg")),
    ("no_filter", "mixed", ("late_agg", "late_join")),
    ("narrow", "grid", ("late_agg", "late_join", "early_agg", "early_join")),
]


def _plain_types(df: DataFrame, rounded: tuple[str, ...] = ("mean_line",)) -> DataFrame:
    """Decimal sums as doubles, means to six places: what the SQL gives."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in df.columns])


def _strategy(query: str, layout: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _plain_types(run(spark, layout_of(spark, sf_dir, layout), WORKLOAD[query][0], strategy))


def scan_direct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block has all columns, so nothing is rebuilt."""
    return _plain_types(run(spark, layout_of(spark, sf_dir, "regular"), REVENUE, "scan"))


def scan_direct_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_types(run(spark, layout_of(spark, sf_dir, "stripes"), GROUPS, "scan"))


def complex_boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of disjoint boxes read through one cover of at most five intervals an attribute."""
    boxes = [{"l_suppkey": Interval(lo, lo + 1), "l_quantity": Interval(5.0, 45.0)} for lo in (1, 2, 5, 7)]
    cover = ComplexBoundary.of_boxes(boxes)
    layout = layout_of(spark, sf_dir, "stripes")
    ids = [b.block_id for b in layout.partitions[0].blocks if cover.relation(b.boundary).value != "disjoint"]
    rows = read_blocks(spark, layout, 0, ids).where(cover.column())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


def block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that a query reads, and how many rows are stored in each."""
    layout = layout_of(spark, sf_dir, "stripes")
    query = Query([_sum("q", "l_quantity")], [Predicate("l_quantity", ">", 20.0), Predicate("l_quantity", "<=", 35.0)]).bound(layout.schema)
    ids = {s.block.block_id for s in plan_skipping(layout, query).direct}
    return read_blocks(spark, layout, 0, ids).groupBy(F.col("block_id").cast("int").alias("block_id")).agg(F.count(F.lit(1)).alias("n"))


def _chosen(spark: SparkSession, sf_dir: str, kind: str) -> Layout:
    table = _table(spark, sf_dir, "lineitem")
    train = [REVENUE, PARTIAL, MULTI, HELPER, COUNTS, GROUPS]
    return _once(spark, sf_dir, kind, lambda path: partition_table(table, train, path, kind=kind, min_rows=max(100, table.count() // 12), seed=7))


def _partitioned(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rows stored of each column under a chosen layout: every column has every row once."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        layout = _chosen(spark, sf_dir, kind)
        counts = [read_blocks(spark, layout, i).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tid").alias("tuples")).withColumn("column", F.explode(F.array(*[F.lit(c) for c in p.columns]))) for i, p in enumerate(layout.partitions)]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out.select("column", "n", "tuples")

    return rows


def _partitioned_query(kind: str, query: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _plain_types(run(spark, _chosen(spark, sf_dir, kind), WORKLOAD[query][0], strategy))


def orders_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a unique key of its own as tuple id, dates and strings as boundaries."""
    day = dt.datetime(1998, 7, 1)
    parts = [group("price", ("o_totalprice",), [{"o_orderdate": Interval(None, day, False, True)}, {"o_orderdate": Interval(day, None)}]), group("status", ("o_orderstatus", "o_orderpriority"), [{"o_orderstatus": Interval(None, "F")}, {"o_orderstatus": Interval("F", None, True)}]), group("keys", ("o_orderkey", "o_custkey", "o_orderdate"))]
    layout = _once(spark, sf_dir, "orders", lambda path: write_layout(_table(spark, sf_dir, "orders"), parts, path, key="o_orderkey"))
    query = Query([_sum("price", _price("o_totalprice")), Measure("n", "count")], [Predicate("o_orderstatus", ">=", "O"), Predicate("o_orderdate", "<", day)], group_by=("o_orderpriority",))
    return _plain_types(run(spark, layout, query, "late_join"))


def events_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = _once(spark, sf_dir, "events", lambda path: write_layout(_table(spark, sf_dir, "events"), [group("v", ("value", "user_id"), [{"user_id": Interval(None, 20)}, {"user_id": Interval(21, None)}]), group("rest", ("event_id", "ts", "event_type", "props"))], path, key="event_id"))
    query = Query([_sum("total", _price("value")), Measure("last", "max", "ts")], [Predicate("user_id", "<=", 30), Predicate("ts", ">=", dt.datetime(2024, 1, 10))], group_by=("event_type",))
    return _plain_types(run(spark, layout, query, "late_agg"))


def mask_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask functions over bits made of each order line."""
    bit = F.expr("shiftleft(1L, l_linenumber - 1)")
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", bit.alias("bit"), F.when(F.col("l_quantity") > 25, bit).alias("large"))
    sets = rows.groupBy("l_suppkey").agg(mask_union("bit").alias("lines"), mask_union("large").alias("large"))
    return sets.select("l_suppkey", mask_count(F.col("lines")).cast("int").alias("n_lines"), mask_or(F.col("lines"), F.col("large")).alias("either"), mask_and(F.col("lines"), F.col("large")).alias("both"), mask_get(F.col("lines"), 3).alias("has_fourth"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"{s}_{q}": _strategy(q, layout, s) for q, layout, strategies in RUNS for s in strategies}
    for f in (scan_direct_sum, scan_direct_group_by, complex_boundary_scan, block_pruning, orders_natural_key, events_group_by, mask_functions):
        out[f.__name__] = f
    for kind in ("horizontal", "hierarchical-late", "hierarchical-early"):
        name = f"partition_{kind.replace('-', '_')}"
        out[f"{name}_rows"] = _partitioned(kind)
        strategy = "scan" if kind == "horizontal" else "early_agg" if kind.endswith("early") else "late_agg"
        out[f"{name}_sum"] = _partitioned_query(kind, "sum", strategy)
        out[f"{name}_multi_measure"] = _partitioned_query(kind, "multi_measure", strategy)
    return out | catalog_queries.queries(layout_of)


def oracle_sql() -> dict[str, str]:
    out = {f"{s}_{q}": WORKLOAD[q][1] for q, _, strategies in RUNS for s in strategies}
    out["scan_direct_sum"] = WORKLOAD["sum"][1]
    out["scan_direct_group_by"] = WORKLOAD["group_by"][1]
    out["complex_boundary_scan"] = "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE (l_suppkey BETWEEN 1 AND 3 OR l_suppkey BETWEEN 5 AND 8) AND l_quantity BETWEEN 5 AND 45"
    out["block_pruning"] = "SELECT CAST(CASE WHEN l_quantity <= 30 THEN 2 ELSE 3 END AS INTEGER) AS block_id, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND l_quantity <= 40 GROUP BY 1"
    out["orders_natural_key"] = f"SELECT o_orderpriority, {_SQL_PRICE.format('o_totalprice')} AS price, count(*) AS n FROM orders WHERE o_orderstatus >= 'O' AND o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1"
    out["events_group_by"] = f"SELECT event_type, {_SQL_PRICE.format('value')} AS total, max(ts) AS last FROM events WHERE user_id <= 30 AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1"
    out["mask_functions"] = (
        "WITH sets AS (SELECT l_suppkey, bit_or(CAST(1 AS BIGINT) << CAST(l_linenumber - 1 AS BIGINT)) AS lines, coalesce(bit_or(CASE WHEN l_quantity > 25 THEN CAST(1 AS BIGINT) << CAST(l_linenumber - 1 AS BIGINT) END), 0) AS large FROM lineitem GROUP BY 1) "
        "SELECT l_suppkey, CAST(bit_count(lines) AS INTEGER) AS n_lines, lines | large AS either, lines & large AS both, (lines >> 3) & 1 = 1 AS has_fourth FROM sets"
    )
    columns = ", ".join(f"'{c}'" for c in LINEITEM)
    for kind in ("horizontal", "hierarchical_late", "hierarchical_early"):
        out[f"partition_{kind}_rows"] = f"SELECT c AS \"column\", n, n AS tuples FROM (SELECT unnest([{columns}]) AS c), (SELECT count(*) AS n FROM lineitem)"
        for q in ("sum", "multi_measure"):
            out[f"partition_{kind}_{q}"] = WORKLOAD[q][1]
    return out | catalog_queries.oracle_sql()
