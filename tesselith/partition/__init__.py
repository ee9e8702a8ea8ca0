"""Choosing a layout from a workload and a cost model."""
