"""Materialized views: partial aggregates of each batch, combined when read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quoted
from tidemark.operators.buckets import Buckets, micros
from tidemark.plans.ast import Call, Ident, QueryError, Select
from tidemark.plans.planner import default_name

KINDS = ("sum", "count", "min", "max", "first", "last", "mean")


def definition(q: Select) -> dict[str, tuple[str, str]]:
    """Output columns of a view's select: name to (kind, field)."""
    if q.into is None or q.every is None:
        raise QueryError("a materialized view needs SELECT INTO and GROUP BY time()")
    if len(q.sources) != 1 or isinstance(q.sources[0], Select) or q.sources[0].regex is not None:
        raise QueryError("a materialized view reads one named measurement")
    out = {}
    for f in q.fields:
        c = f.expr
        if not isinstance(c, Call) or c.name not in KINDS or len(c.args) != 1 or not isinstance(c.args[0], Ident):
            raise QueryError("a materialized view takes " + ", ".join(KINDS) + " of fields")
        out[f.alias or default_name(c)] = (c.name, c.args[0].name)
    return out


def stored_fields(columns: dict[str, tuple[str, str]], types: dict[str, str]) -> tuple[dict[str, str], dict[str, str], list[str]]:
    """(types, rollup kinds, means) of the destination's fields. A mean is kept as sum_x and count_x."""
    fields, rollups, means = {}, {}, []
    for name, (kind, source) in columns.items():
        if kind == "mean":
            fields |= {f"sum_{name}": "float", f"count_{name}": "integer"}
            rollups |= {f"sum_{name}": "sum", f"count_{name}": "count"}
            means.append(name)
        else:
            fields[name] = "integer" if kind == "count" else types.get(source, "float")
            rollups[name] = kind
    return fields, rollups, means


def partials(df: DataFrame, q: Select, columns: dict[str, tuple[str, str]], tags: list[str]) -> DataFrame:
    """Partial aggregates of rows (time, tags, fields) by bucket and tags: time, tags and the stored fields.

    first and last keep the microsecond at which their value was taken, so that partials of one bucket
    combine rightly in whatever order they come.
    """
    buckets = Buckets(max(1, q.every // 1000), q.shift // 1000, q.zone)
    aggs = []
    for name, (kind, source) in columns.items():
        c, at = F.col(quoted(source)), micros(F.col("time"))
        known = F.when(c.isNotNull(), at)
        if kind == "mean":
            aggs += [F.sum(c.cast("double")).alias(f"sum_{name}"), F.count(c).alias(f"count_{name}")]
        elif kind == "first":
            aggs += [F.min_by(c, known).alias(name), F.min(known).alias(f"__first_at_{name}")]
        elif kind == "last":
            aggs += [F.max_by(c, known).alias(name), F.max(known).alias(f"__last_at_{name}")]
        else:
            aggs.append(getattr(F, kind)(c).alias(name))
    out = df.groupBy(buckets.key(F.col("time")).alias("__b"), *[F.col(quoted(t)) for t in tags]).agg(*aggs)
    return out.withColumn("time", buckets.start(F.col("__b"))).drop("__b")


def run_stream(source: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True, interval: str = "10 seconds"):
    """Starts a stream whose micro-batches go to write_batch(rows, batch number).

    The checkpoint tells which batches are done; a batch that runs again after a failure has the same number, by
    which the writer replaces what it left. With once the stream ends when all present input is read.
    """
    writer = source.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str], field: str) -> DataFrame:
    """Streaming count and sum by tumbling window and keys, for append mode: a window is final once `late` has passed.

    Times without zone are taken as UTC, as watermarks need instants.
    """
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(field).alias("total")).select(F.col("window.start").alias("time"), *keys, "n", "total")
