"""Interval-trace analytics on PySpark."""
