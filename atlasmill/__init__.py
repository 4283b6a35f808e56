"""Spark-first address resolution and footprint analytics."""
