"""SELECT statements to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.aggregates import ONE_FIELD, aggregate, mean_of_rollup, quoted
from tidemark.operators.buckets import Buckets, instant, micros
from tidemark.operators.fill import fill_gaps
from tidemark.operators.limits import limit_rows, limit_series
from tidemark.operators.transforms import SECOND, InBlocks, InChunks, InOrder, transform
from tidemark.plans.ast import Binary, Call, Dur, Field, Fill, Ident, Lit, Measurement, QueryError, Regex, Select, Star, conjuncts
from tidemark.plans.parser import AGGREGATES, TRANSFORMS
from tidemark.plans.resolve import Bounds, Conditions, Early, Schema, arithmetic, bounds_of, calls, equal_tags, idents, time_comparison


class Table(Protocol):
    """A measurement as rows of time (timestamp without zone), tags and fields, each series and instant once."""

    name: str
    schema: Schema

    def rows(self, fields: list[str], tags: list[str], early: Early, bounds: Bounds) -> DataFrame:
        """These columns; `early` holds of time and of these tags only and may be applied before anything is grouped."""


@dataclass(frozen=True)
class Frame:
    """Result of one source: a flat frame with time (if any), tags and columns in this order."""

    name: str
    df: DataFrame
    tags: tuple[str, ...]
    columns: tuple[str, ...]
    has_time: bool
    descending: bool = False


class DerivedTable:
    """A subquery's result as a measurement."""

    def __init__(self, frame: Frame):
        self.name, self.frame = frame.name, frame
        kinds = {f.name: f.dataType for f in frame.df.schema.fields}
        self.schema = Schema({c: kinds[c] for c in frame.columns}, frame.tags)

    def rows(self, fields: list[str], tags: list[str], early: Early, bounds: Bounds) -> DataFrame:
        df = self.frame.df
        if not self.frame.has_time:
            df = df.withColumn("time", instant(F.lit(0).cast("long")))
        if (condition := early.all()) is not None:
            df = df.where(condition)
        return df.select("time", *[F.col(quoted(c)) for c in [*tags, *fields]])


def default_name(e: object) -> str:
    """mean_value for mean(value); a call without a field is named by the function; arithmetic by its parts."""
    if isinstance(e, Ident):
        return e.name
    if isinstance(e, Call):
        inner = e.args[0] if e.args else None
        if isinstance(inner, Ident):
            return f"{e.name}_{inner.name}".lower()
        if isinstance(inner, Call):
            return f"{e.name}_{default_name(inner)}"
        return e.name
    if isinstance(e, Binary):
        parts = [default_name(x) for x in (e.left, e.right) if not isinstance(x, Lit)]
        return "_".join(p for p in parts if p) or "expr"
    return "expr"


class Planner:
    """Plans selects against tables that `lookup` finds: lookup(measurement, db, rp) gives a list of them."""

    def __init__(self, lookup: Callable[[Measurement, str | None, str | None], list[Table]], now_ns: int, linear_compat: bool = False, ordered: bool = True, whole_series_bytes: int = 64 << 20):
        self.lookup, self.now_ns, self.linear_compat, self.ordered = lookup, now_ns, linear_compat, ordered
        self.whole_series_bytes = whole_series_bytes

    def plan(self, q: Select, db: str | None, rp: str | None, outer: Bounds = Bounds()) -> list[Frame]:  # noqa: B008
        """A frame for each table of each source, in order."""
        out = []
        for source in q.sources:
            if isinstance(source, Select):
                tables: list[Table] = [DerivedTable(f) for f in self.plan(source, db, rp, outer.meet(bounds_of(q.where, self.now_ns)))]
            else:
                tables = self.lookup(source, db, rp)
            out += [self.one(q, t, outer) for t in tables]
        return out

    # One table

    def one(self, q: Select, table: Table, outer: Bounds) -> Frame:
        s = table.schema
        tags = self.dimensions(q, s)
        fields = self.star_expanded(q, s, tags)
        found = [c for f in fields for c in calls(f.expr)]
        for c in found:
            if c.name not in AGGREGATES and c.name not in TRANSFORMS:
                raise QueryError(f"unsupported function {c.name}()")
        transforms = [c for c in found if c.name in TRANSFORMS]
        aggregates = [c for c in found if c.name in AGGREGATES]
        if q.every is not None and not aggregates:
            raise QueryError("GROUP BY time() needs an aggregate function")
        names = self.names(fields, tags)
        rows = self.scan(q, table, fields, tags, outer)
        tag_columns = [s.tag_column(t) for t in tags]
        if aggregates:
            return self.aggregated(q, table, rows, fields, names, tags, tag_columns, outer)
        if transforms:
            return self.transformed(q, table, rows, fields, names, tags, tag_columns)
        conditions = Conditions(s, self.now_ns)
        if not any(s.find(i) for f in fields for i in idents(f.expr)):
            rows = rows.where(F.lit(False))  # none of the columns exists
        picked = [(n, conditions.value(f.expr)) for n, f in zip(names, fields, strict=True) if not (isinstance(f.expr, Ident) and f.expr.name.lower() == "time")]
        df = rows.select("time", *[F.col(quoted(c)).alias(t) for t, c in zip(tags, tag_columns, strict=True)], *[c.alias(n) for n, c in picked])
        return self.finish(q, table.name, df, tags, [n for n, _ in picked], has_time=True)

    def dimensions(self, q: Select, s: Schema) -> list[str]:
        """GROUP BY tags with * and patterns expanded, sorted within each."""
        out: list[str] = []
        for d in q.tags:
            more = sorted(s.tags) if isinstance(d, Star) else sorted(t for t in s.tags if re.search(d.pattern, t)) if isinstance(d, Regex) else [d]
            out += [t for t in more if t not in out]
        return out

    def star_expanded(self, q: Select, s: Schema, tags: list[str]) -> list[Field]:
        if any(isinstance(f.expr, Star) for f in q.fields):
            if len(q.fields) > 1:
                raise QueryError("* can't be mixed with other columns")
            own = [Field(Ident(t, "tag"), t if t not in s.fields else f"{t}_1") for t in s.tags if t not in tags]
            return [*(Field(Ident(f, "field"), f) for f in s.fields), *own]
        return list(q.fields)

    def names(self, fields: list[Field], tags: list[str]) -> list[str]:
        """Column names: aliases or defaults, numbered where they repeat."""
        out: list[str] = []
        used = {"time", *tags}
        for f in fields:
            name = f.alias or default_name(f.expr)
            if isinstance(f.expr, Ident) and f.expr.name.lower() == "time":
                out.append(name)
                continue
            base, k = name, 0
            while name in used:
                k += 1
                name = f"{base}_{k}"
            used.add(name)
            out.append(name)
        return out

    def scan(self, q: Select, table: Table, fields: list[Field], tags: list[str], outer: Bounds) -> DataFrame:
        """The rows that WHERE leaves, with the columns that the query needs."""
        s = table.schema
        used = [i for f in fields for i in idents(f.expr)] + idents(q.where)
        need_fields, need_tags = [], [s.tag_column(t) for t in tags if t in s.tags]
        for i in used:
            for prefer in ("field", "tag"):
                if x := s.find(i, prefer):
                    if x[0] == "field" and x[1] not in need_fields:
                        need_fields.append(x[1])
                    if x[0] == "tag" and x[1] not in need_tags:
                        need_tags.append(x[1])
        if any(isinstance(a, Star) for f in fields for c in calls(f.expr) for a in c.args) and not need_fields:
            need_fields = list(s.fields)[:1]
        for i in used:
            if i.name in s.mean_fields:
                need_fields += [f"{part}_{i.name}" for part in ("sum", "count") if f"{part}_{i.name}" not in need_fields]
        conditions = Conditions(s, self.now_ns)
        on_series, on_time, late = None, None, None
        for c in conjuncts(q.where):
            column = conditions.column(c)
            of_fields = any((x := s.find(i, prefer)) and x[0] == "field" for i in idents(c) for prefer in ("tag", "field"))
            if of_fields:
                late = column if late is None else late & column
            elif any((x := s.find(i)) and x[0] == "time" for i in idents(c)):
                on_time = column if on_time is None else on_time & column
            else:
                on_series = column if on_series is None else on_series & column
        bounds = replace(bounds_of(q.where, self.now_ns), equal=equal_tags(q.where, s))
        df = table.rows(need_fields, need_tags, Early(on_series, on_time), bounds)
        if late is not None:
            df = df.where(late)
        for t in tags:  # a tag that the measurement lacks is empty
            if t not in s.tags:
                df = df.withColumn(t, F.lit(""))
        return df

    # Aggregates

    def aggregated(self, q: Select, table: Table, rows: DataFrame, fields: list[Field], names: list[str], tags: list[str], tag_columns: list[str], outer: Bounds) -> Frame:
        s = table.schema
        buckets = None if q.every is None else Buckets(max(1, q.every // 1000), q.shift // 1000, q.zone)
        keys = [F.col(quoted(c)).alias(t) for t, c in zip(tags, tag_columns, strict=True)]
        if buckets is not None:
            keys.append(buckets.key(F.col("time")).alias("__b"))
        fill = q.fill or Fill("none" if q.into is not None else "null")
        if buckets is None and fill.mode != "value":
            fill = Fill("none")

        # one column for each aggregate, those within transforms without a fill value
        columns: dict[tuple[Call, bool], str] = {}
        distinct: list[Call] = []

        def register(e: object, nested: bool) -> None:
            if isinstance(e, Call):
                if e.name in TRANSFORMS:
                    for a in e.args:
                        register(a, True)
                elif e.name == "distinct":
                    distinct.append(e)
                else:
                    columns.setdefault((e, nested), f"__a{len(columns)}")
            elif isinstance(e, Binary):
                register(e.left, nested)
                register(e.right, nested)

        for f in fields:
            register(f.expr, False)
        value_keys = {}
        for d in dict.fromkeys(distinct):
            value_keys[d] = f"__d{len(value_keys)}"
            keys.append(F.col(quoted(self.field_of(d, s))).alias(value_keys[d]))
        aggs = [self.aggregate(c, s).alias(n) for (c, _), n in columns.items()]
        df = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
        for name in value_keys.values():
            df = df.where(F.col(name).isNotNull())

        kinds = {f.name: f.dataType for f in df.schema.fields}

        def value(e: object) -> Column:
            if isinstance(e, Call):
                if e.name in TRANSFORMS:
                    return self.transform(e, InOrder(tags, "__b") if buckets is not None else None, F.col("__b"), value_nested)
                if e.name == "distinct":
                    return F.col(value_keys[e])
                c = F.col(columns[e, False])
                if fill.mode == "value":
                    v = F.lit(fill.value)
                    c = F.coalesce(c, v.cast("string") if isinstance(kinds[columns[e, False]], StringType) else v)
                return c
            if isinstance(e, Lit):
                return F.lit(e.value)
            if isinstance(e, Binary):
                return arithmetic(e.op, value(e.left), value(e.right))
            if isinstance(e, Ident) and (x := s.find(e)) and x[0] == "tag" and e.name in tags:
                return F.col(quoted(e.name))
            raise QueryError(f"{default_name(e)} is neither aggregated nor grouped by")

        def value_nested(e: object) -> Column:
            if not isinstance(e, Call):
                raise QueryError("functions of a field and of aggregates can't be mixed")
            return F.col(value_keys[e]) if e.name == "distinct" else F.col(columns[e, True])

        picked = [(n, value(f.expr)) for n, f in zip(names, fields, strict=True) if not (isinstance(f.expr, Ident) and f.expr.name.lower() == "time")]
        items = [n for n, _ in picked]
        has_time = buckets is not None
        out = df.select(*[F.col(quoted(t)) for t in tags], *(["__b"] if has_time else []), *[c.alias(n) for n, c in picked])
        if has_time and fill.mode != "none" and not distinct:
            b = outer.meet(bounds_of(q.where, self.now_ns))
            both = b.lo is not None and b.hi is not None
            lo, hi = (buckets.key_of(b.lo), buckets.key_of(b.hi)) if both else (None, None)
            out = fill_gaps(out, tags, "__b", items, buckets.step, lo, hi, fill, self.linear_compat)
        if has_time:
            out = out.select(buckets.start(F.col("__b")).alias("time"), *[F.col(quoted(c)) for c in [*tags, *items]])
        elif any(c.name in TRANSFORMS for f in fields for c in calls(f.expr)):
            out = self.without_empty(out, fields, names)
        return self.finish(q, table.name, out, tags, items, has_time)

    def field_of(self, c: Call, s: Schema) -> str:
        a = c.args[0] if c.args else None
        if isinstance(a, Star):
            return next(iter(s.fields), "time")
        if not isinstance(a, Ident):
            raise QueryError(f"{c.name}() takes a field")
        x = s.find(a)
        if x is None:
            raise QueryError(f"unknown field {a.name}")
        return x[1]

    def aggregate(self, c: Call, s: Schema) -> Column:
        want = {"percentile": 2}.get(c.name, 1)
        if len(c.args) != want:
            raise QueryError(f"{c.name}() takes {want} argument{'s' * (want > 1)}")
        arg = c.args[0]
        if c.name == "count" and isinstance(arg, Star):
            return F.count(F.lit(1))
        if c.name == "count" and isinstance(arg, Call):
            if arg.name != "distinct":
                raise QueryError("count() takes a field or distinct()")
            return aggregate("count_distinct", self.field_of(arg, s), s.fields.get(arg.args[0].name, StringType()))
        if isinstance(arg, Star):
            raise QueryError(f"{c.name}(*) isn't supported")
        if isinstance(arg, Ident) and arg.name in s.mean_fields and c.name == "mean":
            return mean_of_rollup(f"sum_{arg.name}", f"count_{arg.name}")
        column = self.field_of(c, s)
        percent = None
        if c.name == "percentile":
            n = c.args[1]
            if not isinstance(n, Lit) or isinstance(n.value, (bool, str)) or not 0 <= n.value <= 100:
                raise QueryError("percentile() takes a number from 0 to 100")
            percent = n.value
        elif c.name not in ONE_FIELD:
            raise QueryError(f"unsupported function {c.name}()")
        return aggregate(c.name, column, s.fields.get(arg.name, StringType()), percent)

    # Transforms

    def transform(self, c: Call, rows: InOrder | None, us: Column | None, argument: Callable[[object], Column], key: str = "") -> Column:
        takes_n = c.name == "moving_average"
        most = 2 if takes_n or c.name.endswith("derivative") or c.name == "elapsed" else 1
        if not 1 <= len(c.args) <= most or takes_n and len(c.args) != 2:
            raise QueryError(f"{c.name}() takes {'2' if takes_n else '1 or 2' if most == 2 else '1'} arguments")
        unit, n = SECOND, 1
        if len(c.args) == 2:
            second = c.args[1]
            if takes_n:
                if not isinstance(second, Lit) or not isinstance(second.value, int) or isinstance(second.value, bool):
                    raise QueryError("moving_average() takes a whole number")
                n = second.value
            elif isinstance(second, Dur) and second.ns > 0:
                unit = second.ns
            else:
                raise QueryError(f"{c.name}() takes a duration")
        if rows is None:
            raise QueryError(f"{c.name}() of an aggregate needs GROUP BY time()")
        return transform(c.name, argument(c.args[0]), us, rows, key=key, unit_ns=unit, n=n)

    def transformed(self, q: Select, table: Table, rows: DataFrame, fields: list[Field], names: list[str], tags: list[str], tag_columns: list[str]) -> Frame:
        """Transforms of raw fields; rows where all of them are null go."""
        s = table.schema
        conditions = Conditions(s, self.now_ns)
        found = list(dict.fromkeys(c for f in fields for c in calls(f.expr)))
        keys = {name: f"x{i}" for i, name in enumerate(sorted({self.field_of(c, s) for c in found}))}
        columns = {c: f"__c{i}" for i, c in enumerate(found)}
        # no series is larger than all rows, so where these are few a task may well hold one
        in_chunks = estimated_bytes(rows) > self.whole_series_bytes
        order: InOrder = InChunks(tag_columns, "time") if in_chunks else InOrder(tag_columns, "time")
        if in_chunks:
            rows = InChunks.prepare(rows, tag_columns, "time", {"us": micros(F.col("time"))} | {k: F.col(quoted(name)) for name, k in keys.items()})

        def computed(c: Call, how: InOrder) -> Column:
            name = self.field_of(c, s)
            return self.transform(c, how, micros(F.col("time")), lambda _: F.col(quoted(name)), keys[name])

        averages = [c for c in found if in_chunks and c.name == "moving_average"]
        rows = rows.withColumns({columns[c]: computed(c, order) for c in found if c not in averages})
        if averages:
            blocks = InBlocks(tag_columns)
            widths = [c.args[1].value for c in averages if len(c.args) == 2 and isinstance(c.args[1], Lit) and isinstance(c.args[1].value, int)]
            rows = InBlocks.prepare(rows, order, max([1, *widths]))
            rows = rows.withColumns({columns[c]: computed(c, blocks) for c in averages}).where("__block = __own")

        def value(e: object) -> Column:
            if isinstance(e, Call):
                return F.col(columns[e])
            if isinstance(e, Binary) and e.op in "+-*/%":
                return arithmetic(e.op, value(e.left), value(e.right))
            return conditions.value(e)

        picked = [(n, value(f.expr)) for n, f in zip(names, fields, strict=True) if not (isinstance(f.expr, Ident) and f.expr.name.lower() == "time")]
        df = rows.select("time", *[F.col(quoted(c)).alias(t) for t, c in zip(tags, tag_columns, strict=True)], *[c.alias(n) for n, c in picked])
        df = self.without_empty(df, fields, names)
        return self.finish(q, table.name, df, tags, [n for n, _ in picked], has_time=True)

    def without_empty(self, df: DataFrame, fields: list[Field], names: list[str]) -> DataFrame:
        own = [n for n, f in zip(names, fields, strict=True) if any(c.name in TRANSFORMS for c in calls(f.expr))]
        keep = F.lit(False)
        for n in own:
            keep = keep | F.col(quoted(n)).isNotNull()
        return df.where(keep)

    # Order and limits

    def finish(self, q: Select, name: str, df: DataFrame, tags: list[str], items: list[str], has_time: bool) -> Frame:
        time = "time" if has_time else None
        df = limit_rows(df, tags, time, q.descending, q.limit, q.offset)
        df = limit_series(df, tags, q.slimit, q.soffset)
        if self.ordered and (has_time or tags):
            t = [] if not has_time else [F.col("time").desc() if q.descending else F.col("time").asc()]
            df = df.orderBy(*[F.col(quoted(c)) for c in tags], *t)
        return Frame(name, df, tuple(tags), tuple(items), has_time, q.descending)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's size, from that of its files; far too large rather than too small behind joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cq_select(q: Select, start_ns: int, end_ns: int, strip_fill: bool) -> Select:
    """A continuous query's select for one window: literal time bounds give way to [start, end)."""
    from tidemark.plans.ast import all_of

    def literal(e: object) -> bool:
        if not isinstance(e, Binary):
            return False
        for this, other in ((e.left, e.right), (e.right, e.left)):
            if isinstance(this, Ident) and this.name.lower() == "time" and (isinstance(other, Dur) or isinstance(other, Lit) and isinstance(other.value, int)):
                return time_comparison(e, 0) is not None
        return False

    kept = [c for c in conjuncts(q.where) if not literal(c)]
    window = [Binary(">=", Ident("time"), Lit(start_ns)), Binary("<", Ident("time"), Lit(end_ns))]
    return replace(q, where=all_of([*kept, *window]), fill=None if strip_fill else q.fill)
