"""Aggregation queries over one table."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from tesselith.errors import PlanError, UnsupportedError
from tesselith.metadata.boundary import Boundary
from tesselith.metadata.interval import Interval
from tesselith.metadata.schema import BLOCK_ID, TID, Schema

AGGREGATES = ("sum", "count", "min", "max", "avg")
#: Bits of a BIGINT mask that can be used.
MASK_BITS = 63
_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}


def columns_of(sql: str, schema: Schema) -> tuple[str, ...]:
    """The schema's columns that an expression names, outside of string literals."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", " ", sql)
    named = set(re.findall(r"`([^`]+)`|\b([A-Za-z_]\w*)\b", bare))
    words = {a or b for a, b in named}
    return tuple(c for c in schema if c in words)


@dataclass(frozen=True)
class Predicate:
    """attribute op literal, with op one of = < <= > >=."""

    attribute: str
    op: str
    value: Any

    def interval(self) -> Interval:
        if self.value is None:
            raise UnsupportedError("a comparison with null never holds; use residual for is null")
        match self.op:
            case "=":
                return Interval(self.value, self.value)
            case "<" | "<=":
                return Interval(None, self.value, False, self.op == "<")
            case ">" | ">=":
                return Interval(self.value, None, self.op == ">", False)
        raise UnsupportedError(f"operator {self.op}; give other conditions as residual")

    @staticmethod
    def flipped(value: Any, op: str, attribute: str) -> Predicate:
        """literal op attribute."""
        return Predicate(attribute, _FLIPPED[op], value)


@dataclass(frozen=True)
class Measure:
    """name = aggregate(expression). `count` of `*` counts tuples."""

    name: str
    aggregate: str
    expression: str = "*"
    columns: tuple[str, ...] = ()

    @property
    def is_star(self) -> bool:
        return self.expression.strip() == "*"


@dataclass
class Query:
    """SELECT group_by, measures FROM table WHERE all predicates AND residual GROUP BY group_by.

    Predicates prune blocks. `residual` is any further SQL condition; it is
    tested with each measure, whose columns its own are added to.
    """

    measures: list[Measure]
    predicates: list[Predicate] = field(default_factory=list)
    residual: str | None = None
    group_by: tuple[str, ...] = ()

    def bound(self, schema: Schema) -> BoundQuery:
        """Checked against a schema; raises what cannot be planned, ignores nothing."""
        return BoundQuery(self, schema)


class BoundQuery:
    """A query with the columns of each measure and the box of its predicates.

    boundary is None if the predicates contradict each other: no tuple qualifies.
    """

    def __init__(self, query: Query, schema: Schema):
        if not query.measures:
            raise PlanError("a query needs a measure")
        names = [*query.group_by, *(m.name for m in query.measures)]
        if len(set(names)) != len(names):
            raise PlanError("two outputs with one name")
        self.group_by, self.residual = tuple(query.group_by), query.residual
        self.boundary: Boundary | None = Boundary()
        for p in query.predicates:
            schema[p.attribute]
            if self.boundary is not None:
                common = self.boundary.of(p.attribute).intersection(p.interval())
                self.boundary = None if common is None else Boundary(self.boundary | {p.attribute: common})
        self.filters = tuple(dict.fromkeys(p.attribute for p in query.predicates))
        shared = (*self.group_by, *(columns_of(query.residual, schema) if query.residual else ()))
        for c in shared:
            schema[c]
        self.measures = []
        for m in query.measures:
            if m.aggregate not in AGGREGATES:
                raise UnsupportedError(f"aggregate {m.aggregate}")
            if m.is_star and m.aggregate != "count":
                raise PlanError(f"{m.aggregate}(*)")
            own = m.columns or (() if m.is_star else columns_of(m.expression, schema))
            columns = tuple(dict.fromkeys((*own, *shared)))
            if not columns:  # counts or constants: any column says that the tuple is there
                columns = self.filters[:1] or (next(c for c in schema if c not in (TID, BLOCK_ID)),)
            self.measures.append(Measure(m.name, m.aggregate, "1" if m.is_star else m.expression, columns))
        if len(self.measures) > MASK_BITS or len(self.filters) > MASK_BITS or len(self.columns) > MASK_BITS:
            raise UnsupportedError(f"more than {MASK_BITS} measures, filtered attributes or columns")

    @property
    def columns(self) -> tuple[str, ...]:
        """Columns that measures need, in order; a column's place is its bit."""
        return tuple(dict.fromkeys(c for m in self.measures for c in m.columns))

    @property
    def referenced(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.columns, *self.filters)))


def bits(items: Iterable[Any], of: tuple) -> int:
    """A mask with the places of the items set."""
    return sum(1 << of.index(x) for x in set(items))


def query_to_json(query: Query) -> dict:
    """A query as plain data; values as in a layout's catalog."""
    from tesselith.metadata.boundary import _out

    return {
        "measures": [{"name": m.name, "aggregate": m.aggregate, "expression": m.expression, "columns": list(m.columns)} for m in query.measures],
        "predicates": [[p.attribute, p.op, _out(p.value)] for p in query.predicates],
        "residual": query.residual,
        "group_by": list(query.group_by),
    }


def query_from_json(data: dict) -> Query:
    """Reads what query_to_json() gives. A key that it does not know is an error, never ignored."""
    from tesselith.metadata.boundary import _in

    unknown = set(data) - {"measures", "predicates", "residual", "group_by"}
    if unknown:
        raise UnsupportedError(f"parts of a query: {', '.join(sorted(unknown))}")
    measures = []
    for m in data["measures"]:
        if extra := set(m) - {"name", "aggregate", "expression", "columns"}:
            raise UnsupportedError(f"parts of a measure: {', '.join(sorted(extra))}")
        measures.append(Measure(m["name"], m["aggregate"], m.get("expression", "*"), tuple(m.get("columns", ()))))
    return Query(measures, [Predicate(a, op, _in(v)) for a, op, v in data.get("predicates", ())], data.get("residual"), tuple(data.get("group_by", ())))
