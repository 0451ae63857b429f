"""Functions of a series in time order, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quoted
from tidemark.plans.ast import QueryError

SECOND = 1_000_000_000
class InOrder:
    """Rows of each series in the order of a column: one partition of a window for each."""

    def __init__(self, tags: list[str], order: str):
        w = Window.partitionBy(*[F.col(quoted(t)) for t in tags]) if tags else Window.partitionBy()
        self.window = w.orderBy(F.col(quoted(order)))

    def before(self, x: Column, key: str) -> Column:
        """x in the row before."""
        return F.lag(x).over(self.window)

    def so_far(self, x: Column, key: str) -> Column:
        """Sum of x up to this row."""
        return F.sum(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0))


#: Microseconds of a slice of time, and rows of a block at least.
SLICE_US, BLOCK_ROWS = 3_600_000_000, 100_000


class InChunks(InOrder):
    """The same for series that may be very long: rows in windows of an hour of a series, which know where the hours before ended.

    Only one row an hour and series goes through a window of the whole series; the rows themselves are ordered within their hour.
    """

    def __init__(self, tags: list[str], order: str):
        self.by = [*(F.col(quoted(t)) for t in tags), F.col("__slice")]
        self.window = Window.partitionBy(*self.by).orderBy(F.col(quoted(order)))

    @staticmethod
    def prepare(df: DataFrame, tags: list[str], order: str, numbers: dict[str, Column]) -> DataFrame:
        """Adds __slice, the rows of the series before it, and for each number its last value and its sum before it."""
        us = F.unix_micros(F.col(quoted(order)).cast("timestamp"))
        d = df.withColumn("__slice", F.floor(us / SLICE_US)).withColumns({f"__n_{k}": c for k, c in numbers.items()})
        ends = [F.max_by(f"__n_{k}", quoted(order)).alias(f"__end_{k}") for k in numbers]
        sums = [F.sum(f"__n_{k}").alias(f"__of_{k}") for k in numbers]
        by = [*(F.col(quoted(t)) for t in tags), F.col("__slice")]
        w = (Window.partitionBy(*by[:-1]) if tags else Window.partitionBy()).orderBy("__slice")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        parts = d.groupBy(*by).agg(*ends, *sums, F.count(F.lit(1)).alias("__rows"))
        carried = [F.lag(f"__end_{k}").over(w).alias(f"__before_{k}") for k in numbers] + [F.sum(f"__of_{k}").over(earlier).alias(f"__sum_{k}") for k in numbers]
        held = parts.select(*by, *carried, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"))
        return d.join(held, [*tags, "__slice"]).drop(*[f"__n_{k}" for k in numbers])

    def before(self, x: Column, key: str) -> Column:
        return F.when(F.row_number().over(self.window) == 1, F.col(f"__before_{key}")).otherwise(F.lag(x).over(self.window))

    def so_far(self, x: Column, key: str) -> Column:
        own = F.sum(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        carried = F.col(f"__sum_{key}")
        return F.coalesce(own + carried, own, carried)


class InBlocks(InOrder):
    """Rows of series that may be very long in blocks of about equal size, each with the last rows of the block before it, for functions of the last n rows."""

    def __init__(self, tags: list[str]):
        self.window = Window.partitionBy(*[F.col(quoted(t)) for t in tags], F.col("__block")).orderBy("__at")

    @staticmethod
    def prepare(df: DataFrame, chunks: InChunks, n: int) -> DataFrame:
        """From rows that InChunks.prepare() has numbered: adds __block and __at, and the n - 1 rows before each block as rows that are carried into it."""
        size = max(BLOCK_ROWS, 4 * n)
        df = df.withColumn("__at", F.col("__rows_before") + F.row_number().over(chunks.window) - 1).withColumn("__own", F.floor(F.col("__at") / size))
        into = F.when(F.col("__at") % size >= size - (n - 1), F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
        return df.withColumn("__block", F.explode(into))


def transform(name: str, x: Column, us: Column, rows: InOrder, *, key: str = "", unit_ns: int = SECOND, n: int = 1) -> Column:
    """The transform of x over rows in the order of time; us is that time in microseconds, key names x for `rows`."""
    seconds = (us - rows.before(us, "us")) / F.lit(1e6)
    unit = unit_ns / SECOND
    if name.endswith("derivative"):
        d = F.try_divide(x - rows.before(x, key), seconds / F.lit(unit))
        return F.when(d >= 0, d) if name.startswith("non_negative") else d
    if name.endswith("difference"):
        d = x - rows.before(x, key)
        return F.when(d >= 0, d) if name.startswith("non_negative") else d
    if name == "moving_average":
        if n < 1:
            raise QueryError("moving_average() needs a positive number of points")
        w = rows.window.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(w) == n, F.avg(x).over(w))
    if name == "cumulative_sum":
        return rows.so_far(x, key)
    if name == "elapsed":
        return seconds / F.lit(unit)
    raise QueryError(f"unknown function {name}()")
