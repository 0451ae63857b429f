"""Gap filling: missing buckets of each series, by one window and no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from tidemark.operators.aggregates import quoted
from tidemark.plans.ast import Fill


#: Buckets of a gap that one row unfolds into at once.
STRETCH = 1000


def fill_gaps(df: DataFrame, tags: list[str], key: str, items: list[str], step: int, lo: int | None, hi: int | None, fill: Fill, linear_compat: bool = False) -> DataFrame:
    """Adds the buckets that a series lacks, with its items filled.

    Each row knows its successor's key (one window over the aggregated rows) and turns into itself and the gap
    behind it, the first and last row of a series also into the margins to lo and hi. Where these are None the
    series begins and ends with its own rows. Only new rows are filled: null leaves nulls, a value sets it,
    previous carries on the last non-null value (none before the first), linear lies on the line between
    the non-null neighbours, with nothing outside them; linear_compat makes linear carry on like previous.
    """
    mode = "previous" if fill.mode == "linear" and linear_compat else fill.mode
    w = Window.partitionBy(*[F.col(quoted(t)) for t in tags]) if tags else Window.partitionBy()
    # what follows is found in descending order: a frame that reaches to the end would be gone through anew for each row
    upto, after = w.orderBy(F.col(key)).rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.orderBy(F.col(key))
    k = F.col(key)
    own = {"__next": F.lead(k).over(w), "__prev": F.lag(k).over(w)}
    kinds: dict[str, DataType] = {f.name: f.dataType for f in df.schema.fields}
    for i, name in enumerate(items):
        x = F.col(quoted(name))
        if mode in ("previous", "linear"):
            own[f"__pv{i}"] = F.last(x, True).over(upto)
        if mode == "linear" and isinstance(kinds[name], NumericType):
            at = F.when(x.isNotNull(), k)
            own |= {f"__pk{i}": F.last(at, True).over(upto), f"__nv{i}": F.last(x, True).over(after), f"__nk{i}": F.last(at, True).over(after)}
    out = df.withColumns(own)
    first = k if lo is None else F.least(F.lit(lo), k)
    last = k if hi is None else F.greatest(F.lit(hi), k)
    # in two steps, as a gap of many buckets would be one very long array in a row
    wide = step * STRETCH
    out = out.withColumn("__from", F.when(F.col("__prev").isNull(), first).otherwise(k)).withColumn("__to", F.coalesce(F.col("__next") - F.lit(step), last))
    out = out.withColumn("__from", F.explode(F.sequence("__from", "__to", F.lit(wide).cast("long"))))
    out = out.withColumn("__g", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + F.lit(wide - step), F.col("__to")), F.lit(step).cast("long"))))
    real, behind = F.col("__g") == k, F.col("__g") > k

    def filled(i: int, name: str) -> Column:
        x, kind = F.col(quoted(name)), kinds[name]
        if mode == "value":
            v = F.lit(fill.value)
            return F.when(real, x).otherwise(v if isinstance(kind, NumericType) else v.cast(kind))
        if mode == "previous":
            return F.when(real, x).when(behind, F.col(f"__pv{i}"))
        if mode == "linear" and isinstance(kind, NumericType):
            pv, nv, pk, nk = (F.col(f"__{c}{i}") for c in ("pv", "nv", "pk", "nk"))
            line = pv + (nv - pv) * ((F.col("__g") - pk) / (nk - pk))
            return F.when(real, x).when(behind & nv.isNotNull(), line)
        return F.when(real, x)

    keep = [F.col(quoted(t)) for t in tags]
    return out.select(*keep, F.col("__g").alias(key), *[filled(i, n).alias(n) for i, n in enumerate(items)])
