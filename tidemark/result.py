"""Results as nested series: JSON, CSV, and one object a statement."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from datetime import datetime
from decimal import Decimal

from tidemark.functions.durations import PRECISIONS, format_instant
from tidemark.plans.planner import Frame

_EPOCH = datetime(1970, 1, 1)


def _time(t: datetime, epoch: str | None) -> object:
    d = t - _EPOCH
    ns = ((d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds) * 1000
    return format_instant(ns) if epoch is None else ns // PRECISIONS.get(epoch, 1)


def _value(v: object, epoch: str | None) -> object:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, Decimal):
        return int(v)
    return _time(v, epoch) if isinstance(v, datetime) else v


def series_of(frame: Frame, epoch: str | None = None, size: int | None = None) -> Iterator[dict]:
    """Series of a frame whose rows come in the order of tags; rows stream through the driver, one series is held at a time.

    With a size a series comes in pieces of at most so many rows; all but its last say partial.
    """
    columns = (["time"] if frame.has_time else []) + list(frame.columns)
    now, rows = None, []

    def made(tags: tuple, values: list) -> dict:
        out: dict = {"name": frame.name}
        if frame.tags:
            out["tags"] = dict(zip(frame.tags, tags, strict=True))
        return out | {"columns": columns, "values": values}

    for r in frame.df.toLocalIterator():
        tags = tuple(r[t] for t in frame.tags)
        if rows and (tags != now or len(rows) == size):
            yield made(now, rows) | ({"partial": True} if tags == now else {})
            rows = []
        now = tags
        rows.append([_value(r[c], epoch) for c in columns])
    if rows:
        yield made(now, rows)


def table(name: str, columns: list[str], rows: list[list]) -> dict:
    return {"name": name, "columns": columns, "values": [list(r) for r in rows]}


def to_json(results: list[dict], pretty: bool = False) -> str:
    return json.dumps({"results": results}, indent=4 if pretty else None, ensure_ascii=False)


def to_csv(results: list[dict]) -> str:
    """A line with the series' name, one with its columns, and one for each row; nothing is quoted, null is empty."""
    out = []
    for r in results:
        for s in r.get("series", []):
            tags = s.get("tags") or {}
            out.append(f"name: {s['name']}")
            out.append(",".join([*s["columns"], *tags]))
            for row in s["values"]:
                cells = ["" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in [*row, *tags.values()]]
                out.append(",".join(cells))
    return "\n".join(out) + ("\n" if out else "")


def to_chunks(results: Iterable[dict]) -> Iterator[str]:
    """A line of JSON for each result: a statement's, or a piece of one as Engine.chunks() gives them."""
    for r in results:
        yield json.dumps({"results": [r]}, ensure_ascii=False) + "\n"
