"""Statements and expressions of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """The text can't be parsed or planned."""


# Expressions


@dataclass(frozen=True)
class Ident:
    name: str
    cast: str | None = None  # tag or field


@dataclass(frozen=True)
class Lit:
    """A string, integer, float or boolean."""

    value: object


@dataclass(frozen=True)
class Dur:
    ns: int


@dataclass(frozen=True)
class Instant:
    """An RFC 3339 string; `text` is its spelling."""

    ns: int
    text: str


@dataclass(frozen=True)
class Now:
    pass


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    expr: object


# Statements


@dataclass(frozen=True)
class Field:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Measurement:
    name: str | None = None
    rp: str | None = None
    db: str | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Fill:
    mode: str  # null, none, previous, linear, value
    value: float | int | None = None


@dataclass(frozen=True)
class Select:
    fields: tuple[Field, ...]
    sources: tuple = ()
    into: Measurement | None = None
    where: object = None
    tags: tuple = ()  # names, Regex or Star
    every: int | None = None  # ns
    shift: int = 0  # ns
    fill: Fill | None = None
    descending: bool = False
    limit: int | None = None
    offset: int | None = None
    slimit: int | None = None
    soffset: int | None = None
    zone: str | None = None


@dataclass(frozen=True)
class Statement:
    """Any statement but SELECT: its kind, such as "show tag values", and its clauses."""

    kind: str
    args: dict = field(default_factory=dict)

    def get(self, name: str, default: object = None) -> object:
        return self.args.get(name, default)


def walk(e: object):
    """The expression and all in it."""
    yield e
    for part in (e.args if isinstance(e, Call) else (e.left, e.right) if isinstance(e, Binary) else (e.expr,) if isinstance(e, Not) else ()):
        yield from walk(part)


def conjuncts(e: object) -> list:
    """Parts of a condition that all must hold."""
    if e is None:
        return []
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def all_of(parts: list) -> object:
    out = None
    for p in parts:
        out = p if out is None else Binary("AND", out, p)
    return out
