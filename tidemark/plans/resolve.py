"""Names, time bounds and conditions: from expressions to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from tidemark.functions.durations import parse_instant
from tidemark.operators.aggregates import quoted
from tidemark.plans.ast import Binary, Call, Dur, Ident, Instant, Lit, Not, Now, QueryError, conjuncts, walk

MIN_NS, MAX_NS = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Schema:
    """Fields with their types and tags of a measurement; a tag that shares a field's name has another column."""

    fields: dict[str, DataType]
    tags: tuple[str, ...] = ()
    #: Fields that a rollup keeps as sum and count.
    mean_fields: frozenset[str] = field(default_factory=frozenset)

    def tag_column(self, tag: str) -> str:
        return f"__tag__{tag}" if tag in self.fields else tag

    def find(self, ident: Ident, prefer: str = "field") -> tuple[str, str] | None:
        """(time, tag or field; column) of a name, or None."""
        n = ident.name
        if n.lower() == "time" and ident.cast is None:
            return "time", "time"
        as_field, as_tag = n in self.fields and ident.cast != "tag", n in self.tags and ident.cast != "field"
        if as_field and (prefer == "field" or not as_tag):
            return "field", n
        return ("tag", self.tag_column(n)) if as_tag else None


@dataclass(frozen=True)
class Early:
    """Conditions that hold of a row whatever its fields are: of tags alone, and of time or time and tags."""

    on_series: Column | None = None
    on_time: Column | None = None

    def all(self) -> Column | None:
        both = [c for c in (self.on_series, self.on_time) if c is not None]
        return both[0] & both[1] if len(both) == 2 else both[0] if both else None


def constant_ns(e: object, now_ns: int) -> int | None:
    """Nanoseconds of a constant instant: whole numbers count as epoch nanoseconds, durations as epoch in their unit."""
    if isinstance(e, Lit) and isinstance(e.value, (int, float)) and not isinstance(e.value, bool):
        return int(e.value)
    if isinstance(e, Dur):
        return e.ns
    if isinstance(e, Instant):
        return e.ns
    if isinstance(e, Lit) and isinstance(e.value, str):
        return parse_instant(e.value)
    if isinstance(e, Now):
        return now_ns
    if isinstance(e, Binary) and e.op in "+-*":
        a, b = constant_ns(e.left, now_ns), constant_ns(e.right, now_ns)
        if a is not None and b is not None:
            return a + b if e.op == "+" else a - b if e.op == "-" else a * b
    return None


_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def time_comparison(e: object, now_ns: int) -> tuple[str, int] | None:
    """(operator, ns) of a comparison of time with a constant."""
    if not isinstance(e, Binary) or e.op not in _FLIP:
        return None
    for this, other, op in ((e.left, e.right, e.op), (e.right, e.left, _FLIP[e.op])):
        if isinstance(this, Ident) and this.name.lower() == "time" and this.cast is None:
            ns = constant_ns(other, now_ns)
            if ns is None:
                raise QueryError("time compares with instants only")
            return op, ns
    return None


@dataclass(frozen=True)
class Bounds:
    """First and last microsecond of a time range, inclusive; None is open. `equal` has tags and what they must equal."""

    lo: int | None = None
    hi: int | None = None
    equal: tuple[tuple[str, str], ...] = ()

    def meet(self, other: Bounds) -> Bounds:
        pick = lambda a, b, f: b if a is None else a if b is None else f(a, b)
        return Bounds(pick(self.lo, other.lo, max), pick(self.hi, other.hi, min))


def equal_tags(where: object, schema: Schema) -> tuple[tuple[str, str], ...]:
    """Conditions tag = 'text', text not empty, that all rows must meet."""
    out = []
    for c in conjuncts(where):
        if isinstance(c, Binary) and c.op == "=":
            for a, b in ((c.left, c.right), (c.right, c.left)):
                if isinstance(a, Ident) and isinstance(b, Lit) and isinstance(b.value, str) and b.value and (x := schema.find(a, "tag")) and x[0] == "tag":
                    out.append((a.name, b.value))
    return tuple(out)


def bounds_of(where: object, now_ns: int) -> Bounds:
    """What the conditions that all must hold say about time."""
    out = Bounds()
    for c in conjuncts(where):
        if (found := time_comparison(c, now_ns)) is not None:
            op, ns = found
            up, down = -(-ns // 1000), ns // 1000
            out = out.meet({">=": Bounds(lo=up), ">": Bounds(lo=down + 1), "<": Bounds(hi=up - 1), "<=": Bounds(hi=down), "=": Bounds(up, down), "!=": Bounds()}[op])
    return out


def timestamp_literal(us: int) -> Column:
    days, rest = divmod(us, 86_400_000_000)
    if not -719_162 <= days <= 2_932_896:  # years 1 to 9999
        return F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")
    from datetime import datetime, timedelta

    return F.expr(f"TIMESTAMP_NTZ '{(datetime(1970, 1, 1) + timedelta(days=days, microseconds=rest)).isoformat(sep=' ')}'")


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def time_column(op: str, ns: int) -> Column:
    """A comparison of the time column, which has microseconds, with nanoseconds."""
    t, up, down = F.col("time"), -(-ns // 1000), ns // 1000
    if op in ("=", "!=") and up != down:
        return F.lit(op == "!=")
    return _compare(op, t, timestamp_literal(up if op in (">=", "<", "=", "!=") else down))


def spark_regex(pattern: str) -> str:
    """Named groups are spelled otherwise in Java."""
    return pattern.replace("(?P<", "(?<")


class Conditions:
    """WHERE clauses over a schema's columns. A name that the schema lacks is null, so its comparisons never hold."""

    def __init__(self, schema: Schema, now_ns: int):
        self.schema, self.now_ns = schema, now_ns

    def column(self, e: object) -> Column:
        if isinstance(e, Binary) and e.op in ("AND", "OR"):
            a, b = self.column(e.left), self.column(e.right)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Not):
            return ~self.column(e.expr)
        if (found := time_comparison(e, self.now_ns)) is not None:
            return time_column(*found)
        if isinstance(e, Binary) and e.op in ("=~", "!~"):
            x = self.schema.find(e.left, prefer="tag")
            c = F.lit("") if x is None else F.col(quoted(x[1])).cast("string")
            hit = c.rlike(spark_regex(e.right.pattern))
            return hit if e.op == "=~" else ~hit
        if isinstance(e, Binary) and e.op in _FLIP:
            return self._comparison(e)
        if isinstance(e, Lit) and isinstance(e.value, bool):
            return F.lit(e.value)
        if isinstance(e, Ident) and (x := self.schema.find(e)) and isinstance(self.schema.fields.get(e.name), BooleanType):
            return F.col(quoted(x[1]))
        raise QueryError(f"not a condition: {e}")

    def _comparison(self, e: Binary) -> Column:
        sides = []
        literal = next((x for x in (e.left, e.right) if isinstance(x, (Lit, Instant))), None)
        text = isinstance(literal, Instant) or literal is not None and isinstance(literal.value, str)
        for side in (e.left, e.right):
            if isinstance(side, Ident):
                x = self.schema.find(side, prefer="tag" if text else "field")
                if x is None:
                    # a missing tag is the empty string
                    sides.append((F.lit("") if text else F.lit(None), "none"))
                    continue
                if x[0] == "tag" and literal is not None and not text:
                    return F.lit(False)  # a tag never equals a number
                if x[0] == "field" and text and not isinstance(self.schema.fields[side.name], StringType):
                    return F.lit(False)
                sides.append((F.col(quoted(x[1])), x[0]))
            elif isinstance(side, Instant):
                sides.append((F.lit(side.text), "text"))
            else:
                sides.append((self.value(side), "value"))
        return _compare(e.op, sides[0][0], sides[1][0])

    def value(self, e: object) -> Column:
        """A number or text within a row."""
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Instant):
            return F.lit(e.text)
        if isinstance(e, Ident):
            x = self.schema.find(e)
            if x is None:
                return F.lit(None)
            return F.col(quoted(x[1]))
        if isinstance(e, Binary) and e.op in "+-*/%":
            return arithmetic(e.op, self.value(e.left), self.value(e.right))
        raise QueryError(f"can't be computed in a row: {e}")


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Division is that of floats; what divides by zero or overflows is null."""
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double"))
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](a, b)


def idents(e: object) -> list[Ident]:
    return [x for x in walk(e) if isinstance(x, Ident)] if e is not None else []


def full_or_prefix_match(pattern: str, name: str) -> bool:
    """Measurement patterns match whole names, or with ^ anywhere from the start; one that isn't valid is a name."""
    try:
        return bool(re.search(pattern, name) if pattern.startswith("^") else re.fullmatch(pattern, name))
    except re.error:
        return pattern == name


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def calls(e: object) -> list[Call]:
    return [x for x in walk(e) if isinstance(x, Call)]
