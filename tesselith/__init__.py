"""Spark-native engine for irregularly partitioned tables."""
