"""Tidebook: order-book and time-series analytics as declarative Spark plans."""
