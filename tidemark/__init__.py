"""Bounded-staleness analytics and data processing on PySpark."""
