"""Driver-side metadata: intervals, boundaries, schemas, layouts. Nothing here needs Spark."""
