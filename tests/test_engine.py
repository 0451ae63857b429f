"""Values through the engine, on small frames and on written points."""

import json

import pytest

from tidemark import Engine
from tidemark.engine import Limits, WriteError
from tidemark.plans.ast import QueryError
from tidemark.result import to_chunks, to_csv, to_json

S = 10**9


@pytest.fixture
def make(spark):
    """An engine with measurement m: (seconds, {tags}, {fields}) rows."""

    def build(rows, name="m", tags=("host",), **how):
        e = Engine(spark, **how)
        fields = sorted({k for _, _, f in rows for k in f})
        kinds = {k: next(("string" if isinstance(f[k], str) else "bigint" if isinstance(f[k], int) else "double") for _, _, f in rows if f.get(k) is not None) for k in fields}
        data = [(float(t), *(g.get(x) for x in tags), *(f.get(k) for k in fields)) for t, g, f in rows]
        df = spark.createDataFrame(data, ", ".join(["s double", *[f"{t} string" for t in tags], *[f"{k} {kinds[k]}" for k in fields]]))
        df = df.selectExpr("cast(timestamp_micros(cast(s * 1e6 as bigint)) as timestamp_ntz) as t", *tags, *fields)
        e.register(name, df, "t", tags, fields)
        return e

    return build


def v(*pairs, host=None):
    return [(t, {"host": host} if host else {}, {"v": float(x)}) for x, t in pairs]


def out(e, text, **how):
    """Values of a query, by tags if there are any."""
    series = e.query(text, epoch="s", **how)[0].get("series", [])
    if series and series[0].get("tags"):
        return {tuple(s["tags"].values()): s["values"] for s in series}
    return [r for s in series for r in s["values"]]


def test_aggregates_by_bucket(make):
    e = make(v((10, 1), (20, 1.5), (30, 2)))
    assert out(e, "SELECT mean(v), max(v), min(v), count(v), sum(v) FROM m GROUP BY time(1s)") == [[1, 15, 20, 10, 2, 30], [2, 30, 30, 30, 1, 30]]
    assert out(e, "SELECT mean(v) * 10 + 1 FROM m GROUP BY time(10s)") == [[0, 201]]
    assert out(e, "SELECT first(v), last(v) FROM m GROUP BY time(1s)")[0] == [1, 10, 20]


def test_percentile_median_stddev_mode_distinct(make):
    e = make(v((10, 1), (20, 1.2), (30, 1.4), (40, 1.6)))
    assert out(e, "SELECT percentile(v, 50), spread(v), median(v) FROM m") == [[20, 30, 25]]
    assert out(make(v((1, 1), (2, 2), (3, 3), (4, 4))), "SELECT stddev(v) FROM m")[0][0] == pytest.approx((5 / 3) ** 0.5)
    e = make(v((7, 1), (7, 2), (9, 3)))
    assert out(e, "SELECT mode(v) FROM m") == [[7]]
    assert sorted(out(e, "SELECT distinct(v) FROM m")) == [[7], [9]] and out(e, "SELECT count(distinct(v)) FROM m") == [[2]]


def test_group_by_tag_and_regex(make):
    e = make([*v((10, 1), (30, 2), host="a"), *v((100, 1), host="b")])
    assert out(e, "SELECT mean(v) FROM m GROUP BY host") == {("a",): [[20]], ("b",): [[100]]}
    e = make([*v((1, 10), (4, 40), host="a"), *v((10, 10), (40, 40), host="b"), *v((5, 10), host="drop")])
    got = out(e, "SELECT mean(v) FROM m WHERE host =~ /^(a|b)$/ AND time >= 10s AND time < 50s GROUP BY time(10s), host fill(null)")
    assert got == {("a",): [[10, 1], [20, None], [30, None], [40, 4]], ("b",): [[10, 10], [20, None], [30, None], [40, 40]]}
    assert set(out(e, "SELECT mean(v) FROM m WHERE host !~ /drop/ GROUP BY host")) == {("a",), ("b",)}


@pytest.mark.parametrize(
    "fill, want",
    [("fill(0)", [7, 0, 9]), ("fill(null)", [7, None, 9]), ("", [7, None, 9]), ("fill(none)", [7, 9]), ("fill(previous)", [7, 7, 9]), ("fill(linear)", [7, 8, 9])],
)
def test_fill(make, fill, want):
    e = make(v((7, 1), (9, 3)))
    assert [r[1] for r in out(e, f"SELECT mean(v) FROM m WHERE time >= 1s AND time <= 3s GROUP BY time(1s) {fill}")] == want


def test_fill_margins_descending_offset_and_compat(make):
    e = make(v((5, 3)))
    assert [r[1] for r in out(e, "SELECT mean(v) FROM m WHERE time >= 1s AND time <= 5s GROUP BY time(1s) fill(100)")] == [100, 100, 5, 100, 100]
    assert [r[1] for r in out(e, "SELECT mean(v) FROM m WHERE time >= 1s AND time <= 5s GROUP BY time(1s) fill(previous)")] == [None, None, 5, 5, 5]
    e = make(v((7, 1), (9, 3)))
    assert out(e, "SELECT mean(v) FROM m WHERE time >= 1s AND time <= 4s GROUP BY time(1s) ORDER BY time DESC") == [[4, None], [3, 9], [2, None], [1, 7]]
    assert [r[0] for r in out(make(v((1, 90))), "SELECT mean(v) FROM m WHERE time >= 30s AND time <= 150s GROUP BY time(1m, 30s)")] == [30, 90, 150]
    assert [r[1] for r in out(make(v((10, 1), (30, 3)), linear_compat=True), "SELECT mean(v) FROM m GROUP BY time(1s) fill(linear)")] == [10, 10, 30]
    assert out(make(v((1, 1))), "SELECT mean(v) FROM m WHERE time > 10s AND time < 20s GROUP BY time(1s)") == []


def test_transforms(make):
    e = make(v((10, 1), (25, 2), (45, 3)))
    assert [r[1] for r in out(e, "SELECT difference(mean(v)) FROM m GROUP BY time(1s)")] == [None, 15, 20]
    assert [r[1] for r in out(e, "SELECT cumulative_sum(sum(v)) FROM m GROUP BY time(1s)")] == [10, 35, 80]
    e = make(v((1, 1), (3, 2), (6, 3)))
    assert out(e, "SELECT difference(v) FROM m") == [[2, 2], [3, 3]]
    assert out(e, "SELECT moving_average(v, 2) FROM m") == [[2, 2], [3, 4.5]]
    assert out(e, "SELECT elapsed(v, 1m) FROM m") == [[2, pytest.approx(1 / 60)], [3, pytest.approx(1 / 60)]]
    assert out(e, "SELECT derivative(v, 2s) FROM m") == [[2, 4], [3, 6]]
    assert [r[1] for r in out(make(v((2, 1), (1, 2), (3, 3))), "SELECT cumulative_sum(v) FROM m")] == [2, 3, 6]
    assert [r[1] for r in out(make(v((5, 1), (3, 2), (6, 3))), "SELECT non_negative_difference(v) FROM m")] == [3]


@pytest.mark.parametrize("sliced", [True, False])
def test_transforms_of_long_series_over_hours_and_blocks(make, monkeypatch, sliced):
    from tidemark.operators import transforms

    monkeypatch.setattr(transforms, "BLOCK_ROWS", 5)
    monkeypatch.setattr(transforms, "SLICE_US", 7_000_000)
    rows = [(t, {"host": h}, {"v": float((t * 7 + len(h)) % 13) if t % 11 else None}) for h in ("a", "bb") for t in (*range(1, 60), 200, 201, 500)]
    e = make(rows)
    if sliced:
        e.whole_series_bytes = 0
    got = out(e, "SELECT moving_average(v, 4), difference(v), cumulative_sum(v), elapsed(v, 1s), moving_average(v, 1) FROM m GROUP BY host")
    for h in ("a", "bb"):
        mine = sorted((t, f["v"]) for t, g, f in rows if g["host"] == h)
        want, total = [], 0
        for i, (t, x) in enumerate(mine):
            total += x or 0
            last = [y for _, y in mine[max(0, i - 3) : i + 1]]
            before = mine[i - 1] if i else (None, None)
            r = [sum(last) / 4 if len(last) == 4 and None not in last else None, x - before[1] if x is not None and before[1] is not None else None, total, t - before[0] if i else None, x]
            want.append([t, *r])
        assert got[h,] == [pytest.approx(w) if None not in w else [w[0], *[None if y is None else pytest.approx(y) for y in w[1:]]] for w in want]
    assert [r[1] for r in out(make(v((1, 1), (2, 5000), (6, 9000))), "SELECT moving_average(v, 2) FROM m")] == [1.5, 4]


def test_a_very_long_gap(make, monkeypatch):
    from tidemark.operators import fill

    e = make(v((7, 1), (9, 100_001)))
    assert len(out(e, "SELECT mean(v) FROM m GROUP BY time(1s) fill(0)")) == 100_001
    monkeypatch.setattr(fill, "STRETCH", 3)
    assert [r[1] for r in out(make(v((7, 1), (9, 9))), "SELECT mean(v) FROM m WHERE time >= 0s AND time < 14s GROUP BY time(1s) fill(previous)")] == [None, *[7] * 8, *[9] * 5]


def test_limits(make):
    e = make([*v((1, 1), (2, 2), (3, 3), host="a"), *v((4, 1), (5, 2), (6, 3), host="b")])
    assert out(e, "SELECT mean(v) FROM m GROUP BY time(1s), host fill(none) LIMIT 2") == {("a",): [[1, 1], [2, 2]], ("b",): [[1, 4], [2, 5]]}
    assert out(e, "SELECT v FROM m GROUP BY host LIMIT 1 OFFSET 1") == {("a",): [[2, 2]], ("b",): [[2, 5]]}
    assert out(e, "SELECT v FROM m GROUP BY host SLIMIT 1 SOFFSET 1") == {("b",): [[1, 4], [2, 5], [3, 6]]}
    assert out(e, "SELECT v FROM m ORDER BY time DESC LIMIT 1 OFFSET 2") in ([[2, 2]], [[2, 5]])


def test_tag_comparisons_and_zero_division(make):
    e = make([(1, {"host": "3"}, {"v": 1.0, "n": 0})])
    assert out(e, "SELECT v FROM m WHERE host = 3") == [] and out(e, "SELECT v FROM m WHERE host = '3'") == [[1, 1]]
    assert out(e, "SELECT v / n FROM m") == [[1, None]] and out(e, "SELECT mean(v) / sum(n) FROM m") == [[None]]
    assert out(e, "SELECT mean(v) * -1 + 100 FROM m") == [[99]]
    assert out(e, "SELECT v FROM m WHERE nosuch = ''") == [[1, 1]] and out(e, "SELECT v FROM m WHERE nosuch = 'x'") == []


def test_days_of_a_zone(make):
    ny = [1772949600, 1773021600, 1773032400]  # 2026-03-08 01:00 EST and 21:00 EDT, 03-09 01:00 EDT
    e = make(v(*[(1, t) for t in ny]))
    got = out(e, "SELECT count(v) FROM m WHERE time >= 1772946000s AND time < 1773115200s GROUP BY time(1d) fill(null) tz('America/New_York')")
    assert got == [[1772946000, 2], [1773028800, 1]]


def test_hours_when_clocks_go_back(make):
    e = make(v((1, 1793509200 + 600), (2, 1793509200 + 4200)))  # 2026-11-01 01:10 EDT and 01:10 EST
    assert out(e, "SELECT sum(v) FROM m GROUP BY time(1h) fill(none) tz('America/New_York')") == [[1793509200, 1], [1793512800, 2]]


def test_sparse_series_on_a_long_grid(make):
    e = make([(t, {"host": "h"}, {"a": 1.0, "b": 2.0, "c": 3.0}) for t in (5, 700, 1500, 2400, 3500)])
    got = out(e, "SELECT mean(a), mean(b), mean(c) FROM m WHERE time >= 0s AND time < 3600s GROUP BY time(10s), host fill(null)")
    assert set(got) == {("h",)} and len(got["h",]) == 360 and sum(r[1] is not None for r in got["h",]) == 5


def test_names_of_measurements(make):
    e = make(v((1, 1)), name="a.b")
    assert out(e, 'SELECT v FROM "a.b"') == out(e, 'SELECT v FROM main.autogen."a.b"') == out(e, 'SELECT v FROM main.."a.b"') == out(e, 'SELECT v FROM autogen."a.b"') == [[1, 1]]


def test_subqueries_sources_and_missing(make):
    e = make(v((1, 1), (2, 2)))
    assert out(e, "SELECT mean(v) FROM (SELECT * FROM m)") == [[1.5]]
    assert out(e, "SELECT v FROM nothing") == []
    assert len(e.query("SELECT v FROM m, m")[0]["series"]) == 2
    assert e.sql("SELECT v FROM /.*/").columns == ["time", "v"]


@pytest.mark.parametrize(
    "text",
    ["SELECT top(v) FROM m", "SELECT v FROM m GROUP BY time(1s)", "SELECT mean(v), v FROM m", "SELECT mean(*) FROM m", "SELECT mean(v + 1) FROM m", "SELECT percentile(v, 101) FROM m", "SELECT percentile(v) FROM m",
     "SELECT moving_average(v) FROM m", "SELECT derivative(mean(v)) FROM m", "SELECT mean(nosuch) FROM m", "SELECT *, v FROM m"],
)
def test_plan_errors(make, text):
    with pytest.raises(QueryError):
        make(v((1, 1))).sql(text)


def test_pushdown(spark, sf_dir):
    e = Engine(spark)
    e.register("events", spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], ["value"])
    df = e.sql("SELECT mean(value) FROM events WHERE time >= '2024-01-05T00:00:00Z' AND event_type = 'click' GROUP BY time(1h) fill(none)", ordered=False)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "BatchEvalPython" not in plan and "Pandas" not in plan


# Written points


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/root", now=lambda: 100 * S)


def test_partial_rows_merge_and_the_last_value_counts(engine):
    engine.write("cpu,host=a idle=95 1000000000\ncpu,host=a user=4 1000000000\ncpu,host=a system=1 1000000000")
    assert out(engine, "SELECT mean(idle), mean(user), mean(system) FROM cpu") == [[95, 4, 1]]
    engine.write("cpu,host=a idle=90 1000000000")
    assert out(engine, "SELECT idle, user FROM cpu") == [[1, 90, 4]]


def test_widening_over_writes(engine):
    engine.write("s uptime=99i,x=1i 1")
    engine.write("s uptime=16697u 2\ns x=2.5 3")
    assert engine.query("SHOW FIELD KEYS FROM s")[0]["series"][0]["values"] == [["uptime", "unsigned"], ["x", "float"]]
    assert out(engine, "SELECT sum(uptime), sum(x), max(uptime) FROM s") == [[16796, 3.5, 16697]]
    with pytest.raises(QueryError, match="field type conflict"):
        engine.write('s x="text" 4\nother v=1 4')
    assert engine.query("SHOW MEASUREMENTS")[0]["series"][0]["values"] == [["s"]]


def test_bad_writes_change_nothing(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root", limits=Limits(points=3, tag_values=2, measurements=1))
    for lines in ("m v=1 1\nm v", "m v=1 1\nm v=1 2\nm v=1 3\nm v=1 4", "m,t=a v=1 1\nm,t=b v=1 1\nm,t=c v=1 1", "m v=1 1\nn v=1 1"):
        with pytest.raises(WriteError):
            e.write(lines)
    assert e.query("SHOW MEASUREMENTS") == [{"statement_id": 0}]
    e.write("m v=1 1")
    assert out(e, "SELECT v FROM m") == [[0, 1]]


def test_tag_and_field_of_one_name(engine):
    engine.write("m,x=tagged x=5,y=1 1000000000")
    assert out(engine, "SELECT x FROM m WHERE x = 'tagged'") == [[1, 5]] and out(engine, "SELECT x::tag FROM m WHERE x = 5") == [[1, "tagged"]]
    assert out(engine, "SELECT y FROM m GROUP BY x") == {("tagged",): [[1, 1]]}


def test_tombstones_and_drops(engine):
    engine.write("m,host=a v=1 1000000000\nm,host=b v=2 2000000000\nm,host=b v=3 3000000000")
    engine.query("DELETE FROM m WHERE time < '1970-01-01T00:00:02Z'")
    assert out(engine, "SELECT v FROM m") == [[2, 2], [3, 3]]
    engine.query("DROP SERIES FROM m WHERE host = 'b' AND time >= 3s")
    assert out(engine, "SELECT v FROM m") == [[2, 2]]
    engine.query("DROP SERIES FROM m WHERE host = 'a'")
    assert engine.query("SHOW SERIES")[0]["series"][0]["values"] == [["m,host=b"]]
    engine.query("DELETE FROM m")
    assert out(engine, "SELECT v FROM m") == [] and engine.query("SHOW SERIES") == [{"statement_id": 0}]
    engine.query("DROP MEASUREMENT m")
    assert engine.query("SHOW MEASUREMENTS") == [{"statement_id": 0}]


def test_policies_and_databases(engine):
    engine.query("CREATE DATABASE d WITH DURATION 30d REPLICATION 1 NAME month; CREATE RETENTION POLICY long ON d DURATION INF REPLICATION 2 SHARD DURATION 1w")
    assert engine.query("SHOW RETENTION POLICIES ON d")[0]["series"][0]["values"] == [["long", "0s", "168h0m0s", 2, False], ["month", "720h0m0s", "24h0m0s", 1, True]]
    engine.write("m v=1 1000000000", db="d", rp="long")
    assert out(engine, "SELECT v FROM d.long.m") == [[1, 1]] and out(engine, "SELECT v FROM m", db="d") == [] and out(engine, "SELECT v FROM long.m", db="d") == [[1, 1]]
    engine.query("ALTER RETENTION POLICY long ON d DURATION 1h DEFAULT; DROP RETENTION POLICY month ON d")
    assert engine.query("SHOW RETENTION POLICIES ON d")[0]["series"][0]["values"] == [["long", "1h0m0s", "1h0m0s", 2, True]]
    with pytest.raises(QueryError):
        engine.query("CREATE RETENTION POLICY short ON d DURATION 1m REPLICATION 1")
    engine.query("DROP DATABASE d")
    assert engine.query("SHOW DATABASES")[0]["series"][0]["values"] == [["main"]]
    with pytest.raises(QueryError):
        engine.query("SELECT v FROM m", db="d")


def test_catalog_outlives_the_engine(spark, engine):
    engine.write("m,host=a v=1 1000000000")
    again = Engine(spark, engine.root)
    assert out(again, "SELECT v FROM m WHERE host = 'a'") == [[1, 1]]


def test_show(engine):
    engine.write("cpu,host=a,zone=x v=1 1\ncpu,host=b v=1 1\nmem,host=c used=1i 1")
    q = lambda text: [s["values"] for s in engine.query(text)[0].get("series", [])]
    assert q("SHOW MEASUREMENTS WITH MEASUREMENT =~ /^c/") == [[["cpu"]]] and q("SHOW MEASUREMENTS LIMIT 1 OFFSET 1") == [[["mem"]]]
    assert q("SHOW TAG KEYS") == [[["host"], ["zone"]], [["host"]]]
    assert q("SHOW TAG VALUES WITH KEY IN (host)") == [[["host", "a"], ["host", "b"]], [["host", "c"]]]
    assert q("SHOW TAG VALUES FROM cpu WITH KEY != host") == [[["zone", "x"]]] and q("SHOW TAG VALUES FROM cpu WITH KEY = host WHERE zone = 'x'") == [[["host", "a"]]]
    assert q("SHOW SERIES") == [[["cpu,host=a,zone=x"], ["cpu,host=b"], ["mem,host=c"]]] and q("SHOW SERIES FROM cpu WHERE host = 'b'") == [[["cpu,host=b"]]]
    assert q("SHOW FIELD KEYS FROM mem") == [[["used", "integer"]]]


BUS = "\n".join(f"bus passengers={n}i {(1472367600 + 900 * i) * S}" for i, n in enumerate([5, 8, 8, 7, 8, 15, 15, 17]))  # from 2016-08-28 07:00


def test_continuous_queries(engine):
    engine.write(BUS)
    eight = 1472371200 * S
    engine.now = lambda: eight - 3600 * S
    engine.query("CREATE CONTINUOUS QUERY basic ON main BEGIN SELECT mean(passengers) INTO avg_bus FROM bus GROUP BY time(1h) END")
    engine.query("CREATE CONTINUOUS QUERY often ON main RESAMPLE EVERY 30m BEGIN SELECT mean(passengers) INTO half FROM bus GROUP BY time(1h) END")
    assert [(n, a // S, b // S, k) for n, a, b, k in engine.run_continuous_queries(eight)] == [("basic", 1472367600, 1472371200, 1), ("often", 1472371200, 1472374800, 1)]
    assert out(engine, "SELECT mean FROM avg_bus") == [] and out(engine, "SELECT mean_passengers FROM avg_bus") == [[1472367600, 7]]
    assert engine.run_continuous_queries(eight + 60 * S) == []
    assert [r[0] for r in engine.run_continuous_queries(eight + 1800 * S)] == ["often"]
    assert [v[0] for v in engine.query("SHOW CONTINUOUS QUERIES")[0]["series"][0]["values"]] == ["basic", "often"]
    engine.query("DROP CONTINUOUS QUERY often ON main")
    assert [r[0] for r in engine.run_continuous_queries(eight + 7200 * S)] == ["basic"]


def test_schedule(engine):
    import threading

    eight = 1472371200 * S
    engine.write(BUS)
    engine.now = lambda: eight - 3600 * S
    engine.query("CREATE CONTINUOUS QUERY basic ON main BEGIN SELECT mean(passengers) INTO avg_bus FROM bus GROUP BY time(1h) END")
    for hour, want in ((0, [[1472367600, 7]]), (1, [[1472367600, 7], [1472371200, 13.75]])):
        engine.now = lambda hour=hour: eight + hour * 3600 * S
        engine.run_schedule(interval=0, rounds=2)
        assert out(engine, "SELECT mean_passengers FROM avg_bus") == want
    stopped = threading.Event()
    stopped.set()
    engine.run_schedule(stop=stopped)


def test_materialized_views(engine):
    engine.write("m,host=h1 v=10 1700000000000000000\nm,host=h2 v=20 1700000000000000000")
    engine.write("m,host=h1 v=10 1700000000000000000")
    engine.query("CREATE MATERIALIZED VIEW mv ON main WITH BACKFILL AS SELECT sum(v) AS v, mean(v) AS a, first(v) AS f, last(v) AS l INTO roll FROM m GROUP BY time(1m)")
    assert out(engine, "SELECT sum(v), mean(a) FROM roll") == [[30, 15]]
    engine.write("m,host=h1 v=5 1700000001000000000\nm,host=h3 v=1 1699999999000000000")
    assert out(engine, "SELECT sum(v), mean(a), first(f), last(l) FROM roll") == [[36, 9, 1, 5]]
    with pytest.raises(WriteError):
        engine.write("roll v=1 1")
    for bad in ("SELECT median(v) INTO r FROM m GROUP BY time(1m)", "SELECT sum(v) INTO r FROM /m/ GROUP BY time(1m)"):
        with pytest.raises(QueryError):
            engine.query(f"CREATE MATERIALIZED VIEW x ON main AS {bad}")
    engine.query("DROP MATERIALIZED VIEW mv ON main")
    assert out(engine, "SELECT v FROM roll") == []


def test_results_as_text(make):
    e = make([*v((1.5, 1), host="a"), *v((2, 2), host="b,c")])
    r = e.query("SELECT v FROM m GROUP BY host; SHOW DATABASES")
    assert to_csv(r[:1]) == "name: m\ntime,v,host\n1970-01-01T00:00:01Z,1.5,a\nname: m\ntime,v,host\n1970-01-01T00:00:02Z,2.0,b,c\n"
    assert json.loads(to_json(r, pretty=True))["results"][0]["series"][0]["tags"] == {"host": "a"}
    assert [len(json.loads(x)["results"]) for x in to_chunks(r)] == [1, 1]
    for epoch, want in (("s", 1), ("ms", 1000), ("ns", S), (None, "1970-01-01T00:00:01Z")):
        assert e.query("SELECT v FROM m LIMIT 1", epoch=epoch)[0]["series"][0]["values"][0][0] == want
    assert sum(s.count for s in e.log.held.values()) == 6


def test_backup_and_retention(spark, engine, tmp_path):
    engine.write("m v=1 1700000000000000000\nm v=2 1700090000000000000\nm v=3 1700100000000000000")
    engine.backup(f"file://{tmp_path}/copy")
    engine.query("ALTER RETENTION POLICY autogen ON main DURATION 12h")
    engine.enforce_retention(1700133300 * S)  # up to 1700090100 goes
    assert out(engine, "SELECT v FROM m") == [[1700100000, 3]]
    assert len(out(Engine(spark, f"file://{tmp_path}/copy"), "SELECT v FROM m")) == 3
