"""Gridded-array analytics on PySpark."""
