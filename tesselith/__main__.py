"""Command line: `run` queries over a written layout, `partition` a table for a workload."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from tesselith.api import STRATEGIES, run
from tesselith.partition.choose import KINDS, MIN_ROWS, partition_table
from tesselith.partition.cost import CostModel, workload_cost
from tesselith.plans.query import query_from_json
from tesselith.sources.writer import load_layout


def _workload(path: str | None):
    return None if path is None else [query_from_json(q) for q in json.loads(Path(path).read_text())]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tesselith", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("run", help="run each query of a workload")
    a.add_argument("--layout", required=True, help="layout.json of a written layout")
    a.add_argument("--queries", required=True, help="JSON list of queries")
    a.add_argument("--strategy", choices=STRATEGIES, default="late_agg")
    a.add_argument("--plan-dir", help="write each query's plan as text, q0, q1, ...; without --output nothing runs")
    a.add_argument("--output", help="write each result as Parquet below this path")
    b = verbs.add_parser("partition", help="choose a layout and write it")
    b.add_argument("--table", required=True, help="Parquet table")
    b.add_argument("--queries", required=True)
    b.add_argument("--validate-queries")
    b.add_argument("--test-queries", help="print what this workload costs under the layout")
    b.add_argument("--layout-dir", required=True)
    b.add_argument("--type", choices=KINDS, default="hierarchical-late")
    b.add_argument("--min-rows", type=int, default=MIN_ROWS)
    b.add_argument("--key", help="a unique column that serves as tuple id")
    b.add_argument("--seed", type=int, default=0)
    b.add_argument("--drop-unused", action="store_true")
    return out


def main(args: list[str] | None = None) -> None:
    x = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    queries = _workload(x.queries)
    if x.verb == "run":
        layout = load_layout(spark, x.layout)
        for i, q in enumerate(queries):
            df = run(spark, layout, q, x.strategy)
            if x.plan_dir:
                Path(x.plan_dir).mkdir(parents=True, exist_ok=True)
                Path(x.plan_dir, f"q{i}").write_text(df._jdf.queryExecution().toString())
            if x.output:
                df.write.mode("overwrite").parquet(f"{x.output}/q{i}")
            elif not x.plan_dir:
                df.show(truncate=False)
        return
    layout = partition_table(spark.read.parquet(x.table), queries, x.layout_dir, _workload(x.validate_queries), x.key, kind=x.type, min_rows=x.min_rows, seed=x.seed, drop_unused=x.drop_unused)
    print(f"{len(layout.partitions)} partitions, {len(layout.blocks())} blocks: {x.layout_dir}/layout.json")
    if test := _workload(x.test_queries):
        print(f"test workload: {workload_cost(layout, [q.bound(layout.schema) for q in test], CostModel(), not x.type.endswith('early')):.3f} s by the cost model")


if __name__ == "__main__":
    main()
