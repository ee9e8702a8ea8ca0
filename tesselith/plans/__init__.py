"""Queries and the planners that decide what is read from which block. No Spark job runs here."""
