"""Column functions: masks of bits kept as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_or(a: Column, b: Column) -> Column:
    """The union of two masks; a null is empty."""
    return F.coalesce(a, F.lit(0).cast("long")).bitwiseOR(F.coalesce(b, F.lit(0).cast("long")))


def mask_and(a: Column, b: Column) -> Column:
    """The common bits of two masks; a null is empty."""
    return F.coalesce(a, F.lit(0).cast("long")).bitwiseAND(F.coalesce(b, F.lit(0).cast("long")))


def mask_has(mask: Column, wanted: int) -> Column:
    """Whether all these bits are set."""
    return mask.bitwiseAND(F.lit(wanted).cast("long")) == F.lit(wanted).cast("long")


def mask_get(mask: Column, place: int) -> Column:
    """Whether one bit is set."""
    return F.getbit(mask, F.lit(place)) == 1


def mask_count(mask: Column) -> Column:
    """How many bits are set."""
    return F.bit_count(F.coalesce(mask, F.lit(0).cast("long")))


def mask_union(mask: str) -> Column:
    """Aggregate: the union of a group's masks."""
    return F.bit_or(mask)


def reconstruct(column: str, sortable: bool = True) -> Column:
    """Aggregate: the one value that a group's rows have of a column (others are null)."""
    return F.max(column) if sortable else F.any_value(column, True)
