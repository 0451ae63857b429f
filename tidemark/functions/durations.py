"""Durations and instants: text forms and integers of nanoseconds or microseconds."""

from __future__ import annotations

import re
from datetime import datetime, timezone

#: Nanoseconds of each unit of a duration.
UNITS = {"ns": 1, "u": 1_000, "us": 1_000, "µ": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
_TERM = re.compile(r"(\d+)(ns|us|µs|ms|u|µ|s|m|h|d|w)")
_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?\s*(Z|[+-]\d\d:\d\d)?$")


def parse_duration(text: str, compound: bool = True) -> int | None:
    """Nanoseconds; None for INF. Compound forms such as 1h30m only where allowed."""
    if text.upper() == "INF":
        return None
    terms = _TERM.findall(text)
    if not terms or "".join(a + b for a, b in terms) != text or (len(terms) > 1 and not compound):
        raise ValueError(f"invalid duration: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in terms)


def format_duration(ns: int | None) -> str:
    """Like 168h0m0s, for SHOW RETENTION POLICIES; 0s for infinite."""
    if not ns:
        return "0s"
    s = ns // 10**9
    h, rest = divmod(s, 3600)
    m, s = divmod(rest, 60)
    return (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + f"{s}s"


def duration_text(ns: int) -> str:
    """The shortest single term, as in queries: 1h, 90s."""
    for unit in ("w", "d", "h", "m", "s", "ms", "u"):
        if ns and ns % UNITS[unit] == 0:
            return f"{ns // UNITS[unit]}{unit}"
    return f"{ns}ns"


def parse_instant(text: str) -> int | None:
    """Nanoseconds since 1970 of an RFC 3339 text (a date alone counts; without a zone, UTC); None if it isn't one."""
    m = _RFC3339.match(text.strip())
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        at = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc)
    except ValueError:
        return None
    ns = int(at.timestamp()) * 10**9 + int((frac or "0").ljust(9, "0"))
    if zone and zone != "Z":
        sign = -1 if zone[0] == "+" else 1
        ns += sign * (int(zone[1:3]) * 3600 + int(zone[4:6]) * 60) * 10**9
    return ns


def format_instant(ns: int) -> str:
    """RFC 3339 in UTC, with as many digits of the fraction as needed."""
    s, frac = divmod(ns, 10**9)
    text = datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return text + (f".{frac:09d}".rstrip("0") if frac else "") + "Z"


#: Nanoseconds of each precision of a write or an epoch parameter; unknown ones count as ns.
PRECISIONS = {"ns": 1, "n": 1, "us": 1_000, "u": 1_000, "µ": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def scaled(value: int, precision: str | None) -> int:
    """Nanoseconds of an integer timestamp, held within 64 bits."""
    return max(-(1 << 63), min((1 << 63) - 1, value * PRECISIONS.get(precision or "ns", 1)))
