"""Aggregate functions of the query language as Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from tidemark.plans.ast import QueryError

ONE_FIELD = ("mean", "median", "count", "sum", "min", "max", "first", "last", "spread", "stddev", "mode")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def aggregate(name: str, column: str, kind: DataType, percent: float | None = None, time: str = "time") -> Column:
    """The aggregate over a named column.

    Nulls never count. first and last take the value at the least and greatest time that has one, percentile is the
    nearest rank, stddev that of a sample (null for one value), mode the smallest of the most frequent values.
    Integer sums beyond 64 bits are null.
    """
    c = F.col(quoted(column))
    if isinstance(kind, StringType) and name in ("mean", "median", "sum", "spread", "stddev", "percentile"):
        raise QueryError(f"{name}() needs numbers; {column} is a string")
    if name == "mean":
        return F.avg(c)
    if name == "median":
        return F.median(c)
    if name == "count":
        return F.count(c)
    if name == "count_distinct":
        return F.count_distinct(c)
    if name == "sum":
        return F.try_sum(c) if isinstance(kind, IntegralType) else F.sum(c)
    if name == "min":
        return F.min(c)
    if name == "max":
        return F.max(c)
    if name in ("first", "last"):
        at = F.when(c.isNotNull(), F.col(quoted(time)))
        return F.min_by(c, at) if name == "first" else F.max_by(c, at)
    if name == "percentile":
        return F.expr(f"percentile_disc({percent / 100!r}) WITHIN GROUP (ORDER BY {quoted(column)})")
    if name == "spread":
        return F.max(c) - F.min(c)
    if name == "stddev":
        return F.stddev_samp(c)
    if name == "mode":
        return F.expr(f"mode() WITHIN GROUP (ORDER BY {quoted(column)})")
    raise QueryError(f"unknown function {name}()")


def mean_of_rollup(sum_column: str, count_column: str) -> Column:
    """Mean over rolled-up rows that keep a sum and a count."""
    return F.try_divide(F.sum(quoted(sum_column)).cast("double"), F.sum(quoted(count_column)))
