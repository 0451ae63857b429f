"""LIMIT and OFFSET within series, SLIMIT and SOFFSET over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quoted


def limit_rows(df: DataFrame, tags: list[str], time: str | None, descending: bool, limit: int | None, offset: int | None) -> DataFrame:
    """Per series if there are tags and a limit, else over all rows."""
    if limit is None and not offset:
        return df
    order = [F.col(quoted(time)).desc() if descending else F.col(quoted(time)).asc()] if time else []
    if tags and limit is not None:
        w = Window.partitionBy(*[F.col(quoted(t)) for t in tags]).orderBy(*(order or [F.lit(1)]))
        out = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= (offset or 0) + limit)
        return (out.where(F.col("__n") > offset) if offset else out).drop("__n")
    out = df.orderBy(*order, *[F.col(quoted(t)) for t in tags]) if order else df
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def limit_series(df: DataFrame, tags: list[str], slimit: int | None, soffset: int | None) -> DataFrame:
    """Series in the order of their tags; without tags there is one."""
    if slimit is None and not soffset:
        return df
    if not tags:
        return df if (slimit is None or slimit > 0) and not soffset else df.limit(0)
    names = [F.col(quoted(t)) for t in tags]
    kept = df.select(*names).distinct().orderBy(*names)
    kept = kept.offset(soffset) if soffset else kept
    kept = kept if slimit is None else kept.limit(slimit)
    return df.join(kept, tags, "left_semi").select(df.columns)
