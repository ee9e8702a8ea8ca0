"""The entry points: run a query over a layout, choose a layout for a workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselith.errors import PlanError
from tesselith.metadata.layout import Layout
from tesselith.operators.evaluate import direct_rows, early_rows, final, late_rows
from tesselith.partition.choose import choose_layout
from tesselith.plans.query import AGGREGATES, Measure, Predicate, Query
from tesselith.plans.scans import ScanPlan, plan_eager, plan_skipping

STRATEGIES = ("late_agg", "late_join", "early_agg", "early_join", "scan")


def plan(layout: Layout, query: Query, strategy: str = "late_agg") -> ScanPlan:
    """What the strategy reads from which block; no job runs."""
    if strategy not in STRATEGIES:
        raise PlanError(f"strategy {strategy}; one of {', '.join(STRATEGIES)}")
    bound = query.bound(layout.schema)
    return plan_skipping(layout, bound) if strategy.startswith("late") else plan_eager(layout, bound)


def run(spark: SparkSession, layout: Layout, query: Query, strategy: str = "late_agg") -> DataFrame:
    """The query's result as a DataFrame.

    late_agg, late_join: evaluate directly wherever a block suffices and rebuild
    the rest by aggregation or joins. early_agg, early_join: rebuild all tuples
    first, if any block lacks a column. scan: only layouts whose blocks suffice.
    """
    bound, scans = query.bound(layout.schema), plan(layout, query, strategy)
    if strategy == "scan" and scans.rebuild:
        raise PlanError("a block lacks a column of the query, so tuples have to be rebuilt")
    how = "join" if strategy.endswith("join") else "agg"
    rows = direct_rows(spark, layout, bound, scans.direct)
    rows += late_rows(spark, layout, bound, scans, how) if strategy.startswith("late") else early_rows(spark, layout, bound, scans, how)
    return final(spark, layout, bound, rows)


__all__ = ["AGGREGATES", "STRATEGIES", "Layout", "Measure", "Predicate", "Query", "choose_layout", "plan", "run"]
