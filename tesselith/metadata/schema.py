"""Ordered, typed attributes with byte widths for costing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

from tesselith.errors import PlanError
from tesselith.metadata.interval import Relation

TID, BLOCK_ID = "tid", "block_id"
#: Bytes assumed per value where the type does not say.
DEFAULT_WIDTH = 16
_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


@dataclass(frozen=True)
class Attribute:
    """A column: its name, its Spark type, and the bytes a value costs to read."""

    name: str
    type: T.DataType
    width: int


class Schema:
    """Attributes in order, by name."""

    def __init__(self, attributes: Iterable[Attribute]):
        self.attributes: dict[str, Attribute] = {}
        for a in attributes:
            self.add(a)

    @classmethod
    def of(cls, struct: T.StructType, widths: dict[str, int] | None = None) -> Schema:
        """From a Spark schema; widths come from the argument, the field's metadata, or the type."""
        widths = widths or {}
        return cls(Attribute(f.name, f.dataType, widths.get(f.name) or f.metadata.get("width") or _WIDTHS.get(type(f.dataType), DEFAULT_WIDTH)) for f in struct)

    def add(self, a: Attribute) -> None:
        if a.name in self.attributes:
            raise PlanError(f"attribute {a.name} is there already")
        self.attributes[a.name] = a

    def append(self, other: Schema) -> Schema:
        """With the other's attributes that this one lacks."""
        return Schema([*self.attributes.values(), *(a for a in other.attributes.values() if a.name not in self.attributes)])

    def select(self, names: Iterable[str]) -> Schema:
        return Schema(self[n] for n in names)

    def rename(self, names: dict[str, str]) -> Schema:
        return Schema(Attribute(names.get(a.name, a.name), a.type, a.width) for a in self.attributes.values())

    def offsets(self, names: Iterable[str]) -> list[int]:
        order = list(self.attributes)
        return [order.index(n) for n in names]

    def __getitem__(self, name: str) -> Attribute:
        try:
            return self.attributes[name]
        except KeyError:
            raise PlanError(f"no attribute {name}") from None

    def __iter__(self):
        return iter(self.attributes)

    def __len__(self) -> int:
        return len(self.attributes)

    def __contains__(self, name: str) -> bool:
        return name in self.attributes

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and list(self.attributes.values()) == list(other.attributes.values())

    __hash__ = None

    def relation(self, names: Iterable[str]) -> Relation:
        own, names = set(self), set(names)
        if not own & names:
            return Relation.DISJOINT
        return Relation.EQUAL if own == names else Relation.SUBSET if own < names else Relation.SUPERSET if own > names else Relation.INTERSECT

    def width(self, names: Iterable[str]) -> int:
        return sum(self[n].width for n in names)

    def struct(self, names: Iterable[str] | None = None) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.type, True, {"width": a.width}) for n in (names or self) for a in [self[n]]])
