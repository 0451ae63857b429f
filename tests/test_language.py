"""Text to statements and back to meaning, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions.durations import duration_text, format_duration, parse_duration, parse_instant
from tidemark.plans.ast import Binary, Call, Dur, Fill, Ident, Instant, Lit, QueryError, Regex, Select, Star
from tidemark.plans.digest import StatementLog, digest, shape
from tidemark.plans.parser import bind, parse, parse_one
from tidemark.plans.resolve import Bounds, bounds_of, full_or_prefix_match
from tidemark.sources.catalog import FieldTypeConflict, widen
from tidemark.sources.line_protocol import LineError, parse_line
from tidemark.streaming.schedule import Schedule

S = 10**9


def test_select_clauses():
    q = parse_one("SELECT mean(v) AS m, max(\"w x\") FROM db.rp.cpu, /mem.*/ WHERE host = 'a' GROUP BY time(1m, 30s), host, /^re/ fill(previous) ORDER BY time DESC LIMIT 3 OFFSET 1 SLIMIT 2 SOFFSET 4 tz('Europe/Berlin')")
    assert q.fields[0].alias == "m" and q.fields[1].expr == Call("max", (Ident("w x"),))
    assert (q.sources[0].db, q.sources[0].rp, q.sources[0].name) == ("db", "rp", "cpu") and q.sources[1].regex == "mem.*"
    assert (q.every, q.shift, q.tags) == (60 * S, 30 * S, ("host", Regex("^re")))
    assert q.fill == Fill("previous") and q.descending and (q.limit, q.offset, q.slimit, q.soffset, q.zone) == (3, 1, 2, 4, "Europe/Berlin")


def test_precedence():
    q = parse_one("SELECT a + b * 2 FROM m WHERE x = 1 OR y = 2 AND z = 3")
    assert q.fields[0].expr == Binary("+", Ident("a"), Binary("*", Ident("b"), Lit(2)))
    assert q.where.op == "OR" and q.where.right.op == "AND"


def test_literals():
    q = parse_one(r"SELECT v FROM m WHERE a = 'it\'s' AND b = 'it''s' AND c = -1.5 AND d = true AND time > '2024-01-01T00:00:00Z' AND time < 5m")
    parts = []
    e = q.where
    while isinstance(e, Binary) and e.op == "AND":
        parts.insert(0, e.right)
        e = e.left
    assert [e.right, *(p.right for p in parts)] == [Lit("it's"), Lit("it's"), Lit(-1.5), Lit(True), Instant(1704067200 * S, "2024-01-01T00:00:00Z"), Dur(300 * S)]


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "SELECT v", "SELECT v FROM m WHERE", "SELECT v & 1 FROM m", "SELECT v FROM m WHERE 5 =~ /x/", "SELECT v FROM m WHERE host =~ 'x'", "SELECT v INTO d FROM m",
     "SELECT v FROM m GROUP BY time(1h30m)", "SELECT v FROM m GROUP BY time(0)", "SELECT v FROM m WHERE time > -1h", "SELECT v FROM m fill(some)", "SELECT v::string FROM m", "DROP MEASUREMENT /x/",
     "DELETE FROM m WHERE \"host\" = 'a' AND time < 5", "SHOW DATABASES now", "CREATE RETENTION POLICY p ON d DURATION 1h", "ALTER RETENTION POLICY p ON d", "SELECT v FROM 'm", "EXPLAIN SELECT v FROM m"],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_several_statements_and_comments():
    found = parse("SHOW DATABASES; -- a comment\nSELECT v FROM \"a;b\" WHERE x =~ /;/;; CREATE CONTINUOUS QUERY c ON d RESAMPLE EVERY 1h FOR 2h BEGIN SELECT mean(v) INTO e FROM m GROUP BY time(1h) END")
    assert [getattr(s, "kind", "select") for s in found] == ["show databases", "select", "create continuous query"]
    assert found[2].get("resample_for") == 7200 * S and found[2].get("text").startswith("SELECT mean")


def test_bind():
    assert bind("WHERE a = $x AND b = $xy AND c = '$x'", {"x": "o'k", "xy": 2}) == "WHERE a = 'o\\'k' AND b = 2 AND c = '$x'"


def test_division_is_not_a_pattern():
    q = parse_one("SELECT a / b / c FROM m WHERE d / 2 > 1")
    assert q.fields[0].expr == Binary("/", Binary("/", Ident("a"), Ident("b")), Ident("c"))
    assert isinstance(parse_one("SELECT * FROM m").fields[0].expr, Star)


def test_bounds():
    b = bounds_of(parse_one("SELECT v FROM m WHERE time >= 1500ns AND '1970-01-01T00:00:10Z' > time AND host = 'a'").where, 0)
    assert b == Bounds(2, 10_000_000 - 1)
    assert bounds_of(parse_one("SELECT v FROM m WHERE time > now() - 1s OR time < 5").where, 0) == Bounds()
    assert bounds_of(parse_one("SELECT v FROM m WHERE time > now() - 1s").where, 3 * S) == Bounds(2_000_001, None)


def test_patterns_of_measurements():
    assert full_or_prefix_match("cpu", "cpu") and not full_or_prefix_match("cpu", "cpu_a") and full_or_prefix_match("^cpu", "cpu_a") and full_or_prefix_match("(", "(")


def test_durations():
    assert parse_duration("1h30m") == 5400 * S and parse_duration("INF") is None and parse_duration("2w") == 14 * 86400 * S
    assert format_duration(7 * 86400 * S) == "168h0m0s" and format_duration(None) == "0s" and duration_text(90 * S) == "90s"
    assert parse_instant("2024-01-01T00:00:00.5+01:00") == (1704067200 - 3600) * S + S // 2 and parse_instant("2024-13-01") is None
    with pytest.raises(ValueError):
        parse_duration("1h30m", compound=False)


@given(st.integers(1, 10**15))
def test_duration_text_round_trip(ns):
    assert parse_duration(duration_text(ns)) == ns


def test_widening():
    assert widen(None, "string") == "string" and widen("integer", "float") == "float" and widen("unsigned", "integer") == "unsigned"
    for a, b in (("float", "string"), ("boolean", "integer"), ("unsigned", "float")):
        with pytest.raises(FieldTypeConflict):
            widen(a, b)


def test_lines():
    got = parse_line(r'cpu\ usage,region=us\,east,a\=b=c\ d v=1.5,n=2i,u=3u,s="x \"y\", z=1",ok=T 1465839830100400200')
    assert got == ("cpu usage", {"region": "us,east", "a=b": "c d"}, {"v": "1.5", "n": "2", "u": "3", "s": 'x "y", z=1', "ok": "true"}, {"v": "float", "n": "integer", "u": "unsigned", "s": "string", "ok": "boolean"}, 1465839830100400200)
    assert parse_line("# comment") is None and parse_line("  ") is None
    assert parse_line("m v=1 5", "s")[4] == 5 * S and parse_line("m v=1", now_ns=7)[4] == 7
    assert parse_line("m v=1 9223372036854775807", "s")[4] == 2**63 - 1
    for bad in ("m", "m v", "m v=", "m,t= v=1", "m v=1 x", 'm v="a', "m v=abc", "m v=1i 2 3", "m v=9223372036854775808i", ",t=a v=1"):
        with pytest.raises(LineError):
            parse_line(bad)


def test_schedules():
    h, m = 3600 * S, 60 * S
    day = 1472371200 * S  # 2016-08-28
    basic = Schedule(h)
    assert basic.window(day + 8 * h + 5) == (day + 7 * h, day + 8 * h)
    assert not basic.due(day + 8 * h + 5, day + 8 * h + 1, 0) and basic.due(day + 9 * h, day + 8 * h + 1, 0)
    assert Schedule(h, every=30 * m).window(day + 8 * h + 30 * m) == (day + 8 * h, day + 9 * h)
    assert Schedule(h, span=3 * h).window(day + 8 * h) == (day + 5 * h, day + 8 * h)
    assert Schedule(h, every=2 * h).window(day + 8 * h) == (day + 6 * h, day + 8 * h)
    assert Schedule(h, offset=15 * m).window(day + 8 * h + 20 * m) == (day + 7 * h + 15 * m, day + 8 * h + 15 * m)
    with pytest.raises(QueryError):
        Schedule(h, every=2 * h, span=h)


def test_digest():
    a, b = (parse_one(f"SELECT mean(v) FROM m WHERE host = '{x}' LIMIT {n}") for x, n in (("a", 1), ("b", 2)))
    assert digest(a) == digest(b) != digest(parse_one("SELECT max(v) FROM m WHERE host = 'a'"))
    assert "secret" not in shape(parse_one("CREATE USER u WITH PASSWORD 'secret'"))
    log = StatementLog(most=1)
    for s in (a, b, parse_one("SHOW DATABASES")):
        log.add(s, 0.5)
    assert [s.count for s in log.held.values()] == [1]
    assert isinstance(a, Select)
