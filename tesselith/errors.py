"""Error types. Planning errors are raised before any Spark job starts."""


class PlanError(ValueError):
    """A query, layout or schema that cannot be planned."""


class IntervalError(PlanError):
    """An interval or boundary operation without a result."""


class UnsupportedError(NotImplementedError):
    """A feature that is rejected rather than ignored."""
