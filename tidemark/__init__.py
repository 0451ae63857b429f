"""A time-series analytics engine on PySpark: a query language planned onto DataFrames, ingest, rollups."""

from tidemark.engine import Engine

__all__ = ["Engine"]
