"""One row for each series and instant: the last non-null value of every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quoted

#: How fields of rollups combine: kind to aggregate; the stored times of first and last decide between partials.
COMBINE = ("sum", "count", "min", "max", "first", "last")


def coalesced(df: DataFrame, keys: list[str], fields: list[str], order: list[Column], rollups: dict[str, str] | None = None, also: list[Column] | None = None) -> DataFrame:
    """Groups by keys; each field takes its last non-null value in the order of writing, or combines as its rollup says; `also` has further aggregates."""
    rollups = rollups or {}
    seq = order[0] if len(order) == 1 else F.struct(*order)
    aggs = []
    for f in fields:
        c = F.col(quoted(f))
        how = rollups.get(f)
        if how in ("sum", "count"):
            out = F.sum(c)
        elif how in ("min", "max"):
            out = getattr(F, how)(c)
        elif how in ("first", "last"):
            at = F.when(c.isNotNull(), F.col(quoted(f"__{how}_at_{f}")))
            out = F.min_by(c, at) if how == "first" else F.max_by(c, at)
        else:
            out = F.max_by(c, F.when(c.isNotNull(), seq))
        aggs.append(out.alias(f))
    aggs += also or []
    if not aggs:
        return df.select(*[F.col(quoted(k)) for k in keys]).distinct()
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*aggs)
