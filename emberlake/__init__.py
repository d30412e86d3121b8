"""Emberlake: retrieval, repair and reporting over large tables, as Spark DataFrame functions."""

__version__ = "0.1.0"
