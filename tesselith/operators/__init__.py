"""Direct evaluation, reconstruction by aggregation or by joins, and the final aggregation."""
