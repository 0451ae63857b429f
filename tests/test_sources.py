"""MessagePack, files, compaction and streams."""

import gzip
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark import Engine
from tidemark.engine import WriteError
from tidemark.sources.line_protocol import LineError
from tidemark.sources.msgpack import decode

S = 10**9


def encode(v):
    """A MessagePack encoder for the tests."""
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            return struct.pack(">b", v) if v < 0 else bytes([v])
        return b"\xcf" + struct.pack(">Q", v) if v >= 0 else b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(v, bytes):
        return b"\xc5" + struct.pack(">H", len(v)) + v
    if isinstance(v, list):
        return (bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdc" + struct.pack(">H", len(v))) + b"".join(map(encode, v))
    return (bytes([0x80 | len(v)]) if len(v) < 16 else b"\xdf" + struct.pack(">I", len(v))) + b"".join(encode(k) + encode(x) for k, x in v.items())


plain = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**64 - 1), st.floats(allow_nan=False), st.text(max_size=40), st.binary(max_size=40))


@given(st.recursive(plain, lambda x: st.one_of(st.lists(x, max_size=20), st.dictionaries(st.text(max_size=5), x, max_size=20)), max_leaves=30))
def test_decode(v):
    assert decode(encode(v)) == v


@pytest.mark.parametrize("raw", [b"", b"\x92\x01", b"\xc1", b"\x01\x02", b"\xa5abc"])
def test_decode_errors(raw):
    with pytest.raises(LineError):
        decode(raw)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/root", now=lambda: 100 * S)


def values(e, text):
    return [r for s in e.query(text, epoch="s")[0].get("series", []) for r in s["values"]]


def test_bodies(engine):
    engine.write_msgpack(encode([{"measurement": "m", "tags": {"h": "a"}, "fields": {"v": 1.5, "n": 2, "u": 2**63, "s": "x", "b": True}, "timestamp": S}, {"measurement": "m", "fields": {"v": 2.5}}]))
    assert values(engine, "SELECT v, n, u, s, b FROM m") == [[1, 1.5, 2, 2**63, "x", True], [100, 2.5, None, None, None, None]]
    for bad in (b"\x91", encode([{"measurement": "m"}]), encode([1])):
        with pytest.raises(WriteError):
            engine.write_msgpack(bad)


def test_columnar_bodies(engine):
    engine.write_msgpack(encode({"measurement": "c", "tags": {"h": "a"}, "field": "v", "values": [1.0, 2.0], "timestamps": [S, 2 * S]}), columnar=True)
    assert values(engine, "SELECT v FROM c WHERE h = 'a'") == [[1, 1], [2, 2]]
    with pytest.raises(WriteError, match="differ in length"):
        engine.write_msgpack(encode({"measurement": "c", "tags": {}, "field": "v", "values": [1.0], "timestamps": [1, 2]}), columnar=True)


def test_gzipped_files(engine, tmp_path):
    with gzip.open(tmp_path / "lines.gz", "wt") as f:
        f.write("m,h=a v=1 1\n\n# comment\nm,h=b v=2 2\n")
    assert engine.write_files(f"file://{tmp_path}/lines.gz", precision="s") == 2
    assert values(engine, "SELECT v FROM m") == [[1, 1], [2, 2]]


def test_compaction_changes_no_answer(spark, engine):
    engine.write("m,h=a v=1i 1000000000\nm,h=a v=2i 1000000000\nm,h=b v=3i 90000000000000")
    engine.write("m,h=a v=2.5 1000000000\nm,h=a w=7 1000000000")
    engine.query("CREATE MATERIALIZED VIEW mv ON main WITH BACKFILL AS SELECT first(v) AS f, last(v) AS l, sum(v) AS s, mean(v) AS a INTO roll FROM m GROUP BY time(1d)")
    engine.write("m,h=a v=9 500000000\nm,h=a v=4 2000000000")
    texts = ("SELECT * FROM m", "SELECT first(f), last(l), sum(s), mean(a) FROM roll GROUP BY time(1d) fill(none)")
    before = [values(engine, t) for t in texts]
    assert before[1][0] == [0, 9, 4, 15.5, pytest.approx(15.5 / 3)]
    for name in ("m", "roll"):
        engine.compact(name)
        engine.compact(name)
    assert [values(Engine(spark, engine.root), t) for t in texts] == before
    engine.write("m,h=a v=5 3000000000")
    assert values(engine, texts[1])[0][2:4] == [5, 20.5]


def test_a_batch_of_a_stream_counts_once(spark, engine):
    engine.write("m,h=a v=1 1000000000")
    engine.query("CREATE MATERIALIZED VIEW mv ON main AS SELECT sum(v) AS s INTO roll FROM m GROUP BY time(1m), h")
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS time, 'a' AS h, 5.0D AS s")
    for batch in (-7, -7, -8):
        engine._append_partials("main", "autogen", "roll", rows, ["h"], batch, again=True)
    assert values(engine, "SELECT sum(s) FROM roll") == [[10]]


def test_stream_feeds_a_view_once(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root")
    source = f"file://{tmp_path}/in"
    schema = "ts timestamp_ntz, host string, v double"
    batch = lambda k: spark.sql(f"SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id + {k}) AS ts, if(id % 2 = 0, 'a', null) AS host, double(id + {k}) AS v FROM range(10)")
    batch(0).write.parquet(source)
    e.register("m", spark.read.schema(schema).parquet(source), "ts", ["host"], ["v"])
    e.query("CREATE MATERIALIZED VIEW mv ON main AS SELECT sum(v) AS s, count(v) AS n, last(v) AS l INTO roll FROM m WHERE v > 0 GROUP BY time(1m), host")
    run = lambda: e.view_stream("main", "mv", spark.readStream.schema(schema).parquet(source), f"file://{tmp_path}/state", time="ts").awaitTermination()
    want = lambda n: [[sum(x for x in range(1, n) if x % 2 == k), sum(1 for x in range(1, n) if x % 2 == k), n - 2 + k if (n - 2) % 2 == 0 else None] for k in (1, 0)]
    for k in (0, 10):
        if k:
            batch(k).write.mode("append").parquet(source)
        run()
        run()  # nothing new: nothing counted twice
        got = {s["tags"]["host"]: s["values"][0] for s in e.query("SELECT sum(s), sum(n), last(l) FROM roll GROUP BY host")[0]["series"]}
        odd, even = want(k + 10)
        assert got["a"][:2] == even[:2] and got[""][:2] == odd[:2] and got[""][2] == k + 9 and got["a"][2] == k + 8


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_dates_of_one_write_are_not_coalesced(spark, engine):
    day = 86400 * S
    engine.write("\n".join(f"m,h={'ab'[i % 2]},z=x v={i} {i * day // 4}" for i in range(12)))
    total = "SELECT sum(v) AS s FROM m"
    plan = plan_of(engine.sql(total, ordered=False))
    assert "series_id" not in plan.split("Subqueries")[0] and plan.count("Exchange") <= 2 and "Join" not in plan
    by_tag = plan_of(engine.sql("SELECT sum(v) AS s FROM m WHERE h = 'a' GROUP BY h", ordered=False))
    assert by_tag.count("BroadcastHashJoin") <= 4 and "SortMergeJoin" not in by_tag and "max_by" not in by_tag
    engine.write(f"m,h=a,z=x v=100 {day}")  # replaces 4 on the second day, which two writes share now
    assert engine.catalog.measurement("main", "autogen", "m")["shared"] == ["1970-01-02"]
    assert "max_by" in plan_of(engine.sql(total, ordered=False))
    assert "max_by" not in plan_of(engine.sql(f"{total} WHERE time >= {2 * day}", ordered=False))
    assert values(engine, total) == [[66 + 96]] and values(engine, f"{total} WHERE time >= {day} AND time < {2 * day} AND h = 'a'") == [[106]]
    engine.compact("m")
    assert "max_by" not in plan_of(engine.sql(total, ordered=False)) and values(engine, total) == [[66 + 96]]
    assert values(engine, "SELECT sum(v) FROM m WHERE z = 'x' AND nosuch = '' GROUP BY h") == [[126], [36]]


def test_a_micro_batch_that_runs_again_counts_once(spark, tmp_path):
    """The batch function runs twice with one number, as after a driver that was lost before the checkpoint knew."""
    from tidemark.streaming import rollup

    clock = iter(range(100 * S, 200 * S, S))
    e = Engine(spark, f"file://{tmp_path}/root", now=lambda: next(clock))
    e.write("m,h=a v=0 1000000000")
    e.query("CREATE MATERIALIZED VIEW mv ON main AS SELECT sum(v) AS s, count(v) AS n INTO roll FROM m GROUP BY time(1h), h")
    run, ran = rollup.run_stream, []
    twice = lambda source, batch, checkpoint, **how: run(source, lambda df, k: (batch(df, k), batch(df, k), ran.append(k)), checkpoint, **how)
    for k, lines in enumerate(("m,h=a v=2 2000000000\nm,h=a v=3", "broken\nm,h=b v=5 3000000000\nm v", "m,h=b v=7 4000000000")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text(lines)
        rollup.run_stream = twice
        try:
            e.ingest_stream(spark.readStream.text(f"file://{tmp_path}/in"), f"file://{tmp_path}/state").awaitTermination()
        finally:
            rollup.run_stream = run
    assert ran == [0, 1, 2]
    assert values(e, "SELECT sum(s), sum(n) FROM roll GROUP BY h") == [[5, 2], [12, 2]]
    assert values(e, "SELECT sum(v), count(v) FROM m") == [[17, 5]]
    assert sorted(r["error"].rsplit(": ", 1)[1] for r in e.rejected().collect()) == ["broken", "m v"]


def test_streams_have_numbers_of_their_own(engine):
    e = engine
    numbers = {e.catalog.stream(f"stream-{i}")["no"] for i in range(2000)}
    assert len(numbers) == 2000
    first = e.catalog.stream_batch("a", 0, 5)
    assert e.catalog.stream_batch("a", 0, 9) == (first[0], 5, True) and e.catalog.stream_batch("a", 1, 9)[1:] == (9, False)
    with pytest.raises(Exception, match="comes after"):
        e.catalog.stream_batch("a", 0, 9)


def test_two_engines_on_one_root(spark, engine):
    from tidemark.sources.catalog import CatalogConflict

    engine.write("m v=1 1")
    other = Engine(spark, engine.root)
    engine.write("m v=2 2")
    with pytest.raises(CatalogConflict):
        other.write("m v=3 3")
    other.catalog.reload()
    other.write("m v=3 3")
    assert values(other, "SELECT sum(v) FROM m") == [[6]]


def test_broken_off_work_leaves_the_old_state(spark, engine, tmp_path):
    files = engine.files
    path = f"file://{tmp_path}/c.json"
    files.write(path, "one")
    files.write(path, "two")
    assert files.read(path) == "two" and not files.exists(path + ".old")
    (tmp_path / "c.json").rename(tmp_path / "c.json.old")  # lost between the two moves
    (tmp_path / "c.json.new").write_text("three")
    files.recover(path)
    assert files.read(path) == "three"
    engine.write("m,h=a v=1 1000000000")
    engine.write("m,h=a v=2 1000000000")
    # a compaction that wrote its files but was lost before the catalog named them
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{engine._folder('main', 'autogen', 'm')}/facts/v1")
    again = Engine(spark, engine.root)
    assert values(again, "SELECT v FROM m") == [[1, 2]]
    again.compact("m")
    assert values(again, "SELECT v FROM m") == [[1, 2]] and again.files.list(f"{again._folder('main', 'autogen', 'm')}/facts") == ["v1"]
    again.write("m,h=a w=1i 2000000000")
    again.write("m,h=a w=1.5 2000000000")  # widens: another version
    assert values(again, "SELECT v, w FROM m") == [[1, 2, None], [2, None, 1.5]]


def test_types_of_one_batch_are_widened_together(engine):
    engine.write("m v=1i 1000000000\nm v=2u 2000000000\nn x=1i 1000000000\nn x=2.5 2000000000")
    assert values(engine, "SELECT sum(v) FROM m") == [[3]] and values(engine, "SELECT sum(x) FROM n") == [[3.5]]


def test_no_guard_on_what_executors_read(spark, tmp_path):
    from tidemark.engine import Limits

    e = Engine(spark, f"file://{tmp_path}/root", now=lambda: 100 * S, limits=Limits(points=3))
    (tmp_path / "lines").write_text("\n".join(f"m v={i} {i}" for i in range(10)))
    assert e.write_files(f"file://{tmp_path}/lines", precision="s") == 10
    assert e.write(spark.createDataFrame([(f"m v={i} {i}",) for i in range(20, 30)], "value string"), precision="s") == 10
    with pytest.raises(WriteError, match="too many points"):
        e.write("\n".join(f"m v={i} {i}" for i in range(10)))


def test_results_in_pieces(engine):
    import json

    from tidemark.result import to_chunks

    engine.write("\n".join(f"m,h={'ab'[i // 7]} v={i} {i}000000000" for i in range(10)))
    pieces = list(engine.chunks("SELECT v FROM m GROUP BY h; SHOW SERIES; SELECT v FROM nosuch", size=3))
    assert [(p["statement_id"], len(p["series"][0]["values"]) if "series" in p else 0, bool(p.get("partial"))) for p in pieces] == [(0, 3, True), (0, 3, True), (0, 1, True), (0, 3, False), (1, 2, False), (2, 0, False)]
    assert [p["series"][0].get("partial", False) for p in pieces[:4]] == [True, True, False, False]
    assert len([json.loads(x) for x in to_chunks(iter(pieces))]) == 6
    series = [s["values"] for s in engine.query("SHOW SERIES LIMIT 1 OFFSET 1")[0]["series"]]
    assert series == [[["m,h=b"]]]


def test_simple_lines_are_parsed_as_python_does(spark):
    import random

    from tidemark.sources import line_protocol

    r = random.Random(3)
    names = ["m", "cpu", "a-b", "é", "#x", "m\\ x", "a=b", "t\tx", ""]
    parts = ["h", "host", "h", "k\\=x", "#", "ü"]
    vals = ["1i", "+007i", "-0i", "-12i", "999999999999999999i", "9999999999999999999i", "1u", "1", "1.", ".5", "-2.5e-3", "+1E5", "1e400", "t", "TRUE", "False", "f", "tRUE", "x", "", '"s t"', '"a\\"b"', "nan", "1_0", "٣"]
    stamps = ["", " 5", " -5", " +7", " 999999999999999999", " 9999999999999999999", " x", "  12", " 5 ", " 1 2"]
    pick = r.choice
    lines = ["", "  ", "# c", "m", "m v", "m v=1 1\r", " m v=1", "m,h v=1", "m,h= v=1", "m,=x v=1", "m, v=1", "m v=1,", "m v=1,v=2 3", "m,a=1,a=2 v=1i 3"]
    lines += [pick(names) + "".join(f",{pick(parts)}={pick(['a', 'b c', 'x', '1'])}" for _ in range(r.randrange(3))) + " " + ",".join(f"{pick(parts)}={pick(vals)}" for _ in range(r.randint(1, 3))) + pick(stamps) for _ in range(1500)]
    lines += [f"cpu,host=h{i} v={i}i,w={i}.5 {i}" for i in range(300)]
    for precision in (None, "s"):
        want = []
        for i, line in enumerate(lines):
            try:
                p = line_protocol.parse_line(line, precision, 77)
            except LineError as e:
                want.append((i, "error"))
                continue
            if p is not None:
                m, tags, fields, types, ns = p
                want.append((i, m, tags, {k: float(v) if types[k] == "float" else v for k, v in fields.items()}, types, ns))
        df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
        got = []
        for x in line_protocol.parse_lines(df, precision, 77).collect():
            got.append((x["place"], "error") if x["error"] else (x["place"], x["measurement"], x["tags"], {k: float(v) if x["types"][k] == "float" else v for k, v in x["fields"].items()}, x["types"], x["time_ns"]))
        assert sorted(got, key=lambda g: g[0]) == want
    simple, others = line_protocol._simple_points(df.selectExpr("value line", "monotonically_increasing_id() place"), None, 0)
    assert simple.count() > 300 and simple.count() + others.count() == len(lines)


def test_later_lines_win_whichever_way_they_are_parsed(engine):
    engine.write('m v=1,s="a b" 1000000000\nm v=2 1000000000\nn v=2 1000000000\nn v=1,s="x" 1000000000')
    assert values(engine, "SELECT v, s FROM m") == [[1, 2, "a b"]] and values(engine, "SELECT v, s FROM n") == [[1, 1, "x"]]
