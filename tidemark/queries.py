"""The driver's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.engine import Engine
from tidemark.plans.ast import QueryError
from tidemark.sources.fsio import scratch_folder
from tidemark.sources.line_protocol import columnar_points, encode, parse_lines
from tidemark.streaming.rollup import windowed_counts

#: Decimals to which both sides round floats: sums differ in their last digits by the order of addition.
DECIMALS = 6
#: A fixed now, for queries that use it.
NOW_NS = 1_706_745_600_000_000_000  # 2024-02-01


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    """An engine whose measurements are the test tables."""
    e = Engine(spark, root, now=lambda: NOW_NS)
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    e.register("events", table("events"), "ts", ["event_type", "user_id"], ["value", "event_id", "props"])
    # a line number is one of several rows of a series and day; the last by this order counts
    items = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    e.register("lineitem", table("lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"], items, order=["l_orderkey", "l_linenumber", *items])
    e.register("orders", table("orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"])
    return e


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), DECIMALS).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


@dataclass(frozen=True)
class Query:
    """A select in the query language, or a function; `floats` are the columns that the SQL's side rounds."""

    how: str | Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    floats: tuple[str, ...] = field(default=())

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if callable(self.how):
            return rounded(self.how(spark, sf_dir))
        return rounded(engine(spark, sf_dir).sql(self.how, ordered=False))

    def oracle(self) -> str | None:
        if self.sql is None or not self.floats:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(f'round({c}, {DECIMALS}) AS {c}' for c in self.floats)}) FROM ({self.sql})"


def bucket(width: str, column: str = "ts", origin: str = "1970-01-01") -> str:
    return f"time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '{origin}')"


RANGE = "time >= '2024-01-05T00:00:00Z' AND time < '2024-01-07T00:00:00Z'"
SQL_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'"
#: What a query reads back by default; what it loads before is always the whole table.
BOUND = f"WHERE {RANGE}"
# all days of events, where a fill needs the ends of its grid
WHOLE = "time >= '2024-01-01T00:00:00Z' AND time < '2024-01-31T00:00:00Z'"
# sub-hour buckets of two kinds of events leave gaps
GAPPY = "event_type =~ /^(click|error)$/ AND time >= '2024-01-05T00:00:00Z' AND time < '2024-01-05T12:00:00Z'"
SQL_GAPPY = "event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 12:00:00'"
GRID = f"""b AS (SELECT {bucket('10 minutes')} AS time, event_type, avg(value) AS m FROM events WHERE {SQL_GAPPY} GROUP BY ALL),
g AS (SELECT s.event_type, t.time FROM (SELECT DISTINCT event_type FROM b) s
      CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 11:50:00', INTERVAL '10 minutes')) AS time) t),
j AS (SELECT g.time, g.event_type, b.m, b.time IS NOT NULL AS own FROM g LEFT JOIN b USING (time, event_type))"""
DAILY = f"WITH d AS (SELECT {bucket('1 day')} AS time, event_type, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL)"
BY_TAG = "OVER (PARTITION BY event_type ORDER BY time)"
SECONDS = "((epoch_us(time) - lag(epoch_us(time)) " + BY_TAG + ") / 1e6)"


def _aggregate(call: str, sql: str, floats: bool = True) -> Query:
    return Query(f"SELECT {call} AS x FROM events GROUP BY event_type", f"SELECT event_type, {sql} AS x FROM events GROUP BY event_type", ("x",) if floats else ())


def _filled(fill: str, sql: str) -> Query:
    return Query(f"SELECT mean(value) AS m FROM events WHERE {GAPPY} GROUP BY time(10m), event_type {fill}", f"WITH {GRID} {sql}", ("m",))


def _transformed(call: str, sql: str) -> Query:
    return Query(f"SELECT {call} AS x FROM events GROUP BY time(1d), event_type fill(none)", f"{DAILY} SELECT time, event_type, {sql} AS x FROM d", ("x",))


def _metadata(statement: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = engine(spark, sf_dir).query(statement)[0].get("series", [])
        return spark.createDataFrame([tuple(r) for s in series for r in s["values"]], columns)

    return run


def _stored(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that holds all events, written as line protocol in two overlapping batches."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    e.query("CREATE DATABASE stored")
    rows = e.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
    lines = encode_rows(rows, "ev")
    e.write_points(parse_lines(lines), db="stored")
    e.write_points(parse_lines(encode_rows(rows.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1), "ev")), db="stored")
    return e


def encode_rows(rows: DataFrame, name: str) -> DataFrame:
    return encode(rows, name, {"event_type": "event_type", "user_id": "user_id"}, {"value": ("value", "float"), "event_id": ("event_id", "integer")})


def _compacted(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    e = _stored(spark, sf_dir)
    e.compact("ev", db="stored")
    return e.sql(f"SELECT sum(value) AS s, count(event_id) AS n FROM ev {where} GROUP BY event_type", db="stored", ordered=False)


def _stored_select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _stored(spark, sf_dir).sql(text, db="stored", ordered=False)


NEW_VALUE = "CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END"


def _tombstones(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    e = _stored(spark, sf_dir)
    e.query("DELETE FROM ev WHERE time >= '2024-01-05T06:00:00Z' AND time < '2024-01-05T18:00:00Z'; DROP SERIES FROM ev WHERE event_type = 'click'", db="stored")
    return e.sql(f"SELECT sum(value) AS s, count(value) AS n FROM ev {where} GROUP BY event_type", db="stored", ordered=False)


def _into(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    e = _stored(spark, sf_dir)
    e.query("SELECT mean(value) AS m, count(value) AS n INTO hourly FROM ev GROUP BY time(1h), event_type", db="stored")
    return e.sql(f"SELECT m, n FROM hourly {where} GROUP BY event_type", db="stored", ordered=False)


def _view(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    """A view with a backfill, fed by two later writes of which one repeats an instant's bucket."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    e.query("CREATE DATABASE stored")
    rows = e.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
    part = lambda k: parse_lines(encode_rows(rows.where(f"event_id % 3 = {k}"), "ev"))
    e.write_points(part(0), db="stored")
    e.query("CREATE MATERIALIZED VIEW v ON stored WITH BACKFILL AS SELECT sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, first(value) AS f, last(value) AS l, mean(value) AS m INTO roll FROM ev GROUP BY time(6h), event_type", db="stored")
    e.write_points(part(1), db="stored")
    e.write_points(part(2), db="stored")
    return e.sql(f"SELECT sum(s) AS s, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, first(f) AS f, last(l) AS l, mean(m) AS m FROM roll {where} GROUP BY time(6h), event_type fill(none)", db="stored", ordered=False)


def _continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous query over a registered measurement, run at noon of a day for the hour before."""
    hour = 3600 * 10**9
    noon = 1_704_456_000_000_000_000  # 2024-01-05 12:00
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    e.now = lambda: noon - hour
    e.query("CREATE CONTINUOUS QUERY cq ON main RESAMPLE FOR 3h BEGIN SELECT mean(value) AS m INTO cq_out FROM events WHERE time > 0 GROUP BY time(1h), event_type END")
    e.run_continuous_queries(noon)
    return e.sql("SELECT m FROM cq_out GROUP BY event_type", ordered=False)


def _export_import(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    e = _stored(spark, sf_dir)
    folder = scratch_folder(spark, "export")
    e.export("stored", folder)
    other = Engine(spark, scratch_folder(spark, "engine"), now=lambda: NOW_NS)
    other.import_(folder)
    return other.sql(f"SELECT value, event_id FROM ev {where} GROUP BY event_type", db="stored", ordered=False)


def _columnar(spark: SparkSession, sf_dir: str, where: str = "WHERE time >= '2024-01-05T00:00:00Z' AND time < '2024-01-06T00:00:00Z'") -> DataFrame:
    """Hours of events as columnar batches of one field, flattened, written and read.

    A series holds an instant once, so events of one type and instant go to batches that a tag (nth) tells apart.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    instants = Window.partitionBy("event_type", "h").orderBy("t")
    ev = ev.select("event_type", F.date_trunc("hour", "ts").alias("h"), ns.alias("t"), "value").withColumn("nth", F.row_number().over(instants) - F.rank().over(instants))
    batches = ev.groupBy("event_type", "h", "nth").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("z"))
    tags = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("nth"), F.col("nth").cast("string"))
    batches = batches.select(F.lit("ev").alias("measurement"), tags.alias("tags"), F.lit("value").alias("field"), F.col("z.value").alias("values"), F.col("z.t").alias("timestamps"))
    e = Engine(spark, scratch_folder(spark, "engine"), now=lambda: NOW_NS)
    e.write_points(columnar_points(batches, NOW_NS))
    return e.sql(f"SELECT sum(value) AS s, count(value) AS n FROM ev {where} GROUP BY event_type", ordered=False)


# A MessagePack body of two points, {measurement m, tags {host a}, fields {v 1.5, ok true, name a}, timestamp 1 s} and the same of host b with 2.5 at 2 s.
BODY = bytes.fromhex(
    "92"
    "84ab6d6561737572656d656e74a16d a474616773 81a4686f7374a161 a66669656c6473 83a176cb3ff8000000000000a26f6bc3a46e616d65a161 a974696d657374616d70 ce3b9aca00"
    "84ab6d6561737572656d656e74a16d a474616773 81a4686f7374a162 a66669656c6473 83a176cb4004000000000000a26f6bc3a46e616d65a162 a974696d657374616d70 ce77359400"
)


def _msgpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch_folder(spark, "engine"), now=lambda: NOW_NS)
    e.write_msgpack(BODY)
    return e.sql('SELECT v, ok, "name" FROM m GROUP BY host', ordered=False)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view fed by Structured Streaming over the events file, read back."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    e.query("CREATE MATERIALIZED VIEW v ON main AS SELECT sum(value) AS s, count(value) AS n INTO roll FROM events GROUP BY time(1d), event_type")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e.view_stream("main", "v", stream, scratch_folder(spark, "stream"), time="ts").awaitTermination()
    return e.sql("SELECT sum(s) AS s, sum(n) AS n FROM roll GROUP BY time(1d), event_type fill(none)", ordered=False)


def _stream_ingest(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    """Line protocol files of all events, read as a stream and written into an engine."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    folder = scratch_folder(spark, "lines")
    rows = e.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
    encode_rows(rows, "streamed").write.option("compression", "gzip").text(folder)
    e.ingest_stream(spark.readStream.text(folder), folder + "-state").awaitTermination()
    return e.sql(f"SELECT sum(value) AS s, count(event_id) AS n FROM streamed {where} GROUP BY event_type", ordered=False)


def _retention(spark: SparkSession, sf_dir: str, where: str = "WHERE time < '2024-01-07T00:00:00Z'") -> DataFrame:
    e = _stored(spark, sf_dir)
    e.query("ALTER RETENTION POLICY autogen ON stored DURATION 36h", db="stored")
    e.enforce_retention(1_704_585_600_000_000_000)  # 2024-01-07: what is older than 2024-01-05 12:00 goes
    return e.sql(f"SELECT count(value) AS n FROM ev {where} GROUP BY event_type", db="stored", ordered=False)


def _csv(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    from tidemark.result import to_csv

    text = to_csv(engine(spark, sf_dir).query(f"SELECT count(value) AS n FROM events {where} GROUP BY time(12h), event_type", epoch="s"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "line int, text string")


def _after(statements: str, show: str, columns: str, **how: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rows that a SHOW gives after some statements, on an engine with the test tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
        e.query(statements, **how)
        return spark.createDataFrame([tuple(r) for s in e.query(show, **how)[0].get("series", []) for r in s["values"]], columns)

    return run


def _json(spark: SparkSession, sf_dir: str, where: str = BOUND) -> DataFrame:
    """The JSON result, read back by Spark."""
    from tidemark.result import to_json

    text = to_json(engine(spark, sf_dir).query(f"SELECT count(value) AS n FROM events {where} GROUP BY time(1d), event_type", epoch="s"))
    schema = "results array<struct<statement_id: int, series: array<struct<name: string, tags: map<string, string>, columns: array<string>, values: array<array<bigint>>>>>>"
    parsed = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("j")).select(F.explode("j.results").alias("r")).select(F.explode("r.series").alias("s"))
    return parsed.select(F.col("s.tags")["event_type"].alias("event_type"), F.explode("s.values").alias("v")).select("event_type", F.col("v")[0].alias("epoch"), F.col("v")[1].alias("n"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by shape: two that differ in literals only are one."""
    e = engine(spark, sf_dir)
    e.query("SHOW DATABASES; SELECT max(value) FROM events WHERE event_type = 'click'; SELECT max(value) FROM events WHERE event_type = 'error'")
    return spark.createDataFrame([(x.count, x.failed) for x in e.log.held.values()], "n long, failed long")


def _watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming tumbling windows, all of them final once the input has ended."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch_folder(spark, "windows")
    out = windowed_counts(stream, "ts", "1 day", "1 hour", ["event_type"], "value")
    out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", folder + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).withColumn("time", F.col("time").cast("timestamp_ntz"))


def _qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement in two retention policies, read by its qualified name."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    e.query("CREATE DATABASE stored; CREATE RETENTION POLICY long ON stored DURATION INF REPLICATION 1")
    rows = e.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
    e.write_points(parse_lines(encode_rows(rows, "ev")), db="stored", rp="long")
    e.write("ev,event_type=click,user_id=1 value=1 1704412800000000000", db="stored")
    texts = ("SELECT sum(value) AS s, count(value) AS n FROM stored.long.ev GROUP BY event_type", "SELECT sum(value) AS s, count(value) AS n FROM stored..ev GROUP BY event_type")
    long, default = (e.sql(t, ordered=False) for t in texts)
    return long.select(F.lit("long").alias("rp"), "*").union(default.select(F.lit("autogen").alias("rp"), "*"))


def _precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose timestamps are whole seconds, each event a series of its own."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = ev.select(F.concat(F.lit("ev,id="), F.col("event_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(" "), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).alias("value"))
    e = Engine(spark, scratch_folder(spark, "engine"), now=lambda: NOW_NS)
    e.write(lines, precision="s")
    return e.sql("SELECT value FROM ev GROUP BY id", ordered=False)


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result in pieces of seven rows, put together again."""
    pieces = list(engine(spark, sf_dir).chunks("SELECT count(value) AS n FROM events GROUP BY time(1d), event_type", epoch="s", size=7))
    if any(len(p["series"][0]["values"]) > 7 for p in pieces):
        raise AssertionError("a piece is too large")
    return spark.createDataFrame([(x["tags"]["event_type"], *r) for p in pieces for x in p["series"] for r in x["values"]], "event_type string, epoch long, n long")


def _raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events_as_they_are")
    return engine(spark, sf_dir).raw_sql("SELECT event_type, count(*) AS n FROM events_as_they_are GROUP BY event_type")


#: Statements that are refused, each for another reason.
REFUSED = (
    "SELECT value FROM events GROUP BY time(1h)", "SELECT value & 1 FROM events", "SELECT value | 1 FROM events", "SELECT mean(value) FROM events nonsense", "SELECT mean(*) FROM events",
    "SELECT top(value, 3) FROM events", "SELECT derivative(mean(value)) FROM events", "SELECT mean(value), value FROM events", "SELECT value FROM nowhere.events", "CREATE RETENTION POLICY p ON main DURATION 1m REPLICATION 1",
)


def _in_slices(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A select over raw series whose rows run in slices of time and blocks, however few they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.whole_series_bytes = 0
        return e.sql(text, ordered=False)

    return run


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether statements are refused, and a write into a view's destination with them."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))

    def tried(what: Callable[[], object]) -> bool:
        try:
            what()
        except QueryError:
            return True
        return False

    e.query("CREATE MATERIALIZED VIEW v ON main AS SELECT sum(value) AS s INTO roll FROM events GROUP BY time(1h)")
    out = [(x, tried(lambda x=x: e.query(x))) for x in REFUSED]
    return spark.createDataFrame([*out, ("write roll", tried(lambda: e.write("roll s=1 1"))), ("write other", tried(lambda: e.write("other s=1 1")))], "statement string, refused boolean")


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database with written measurements, dropped and made anew: nothing of it is left."""
    e = _stored(spark, sf_dir)
    before = len(e.query("SHOW MEASUREMENTS", db="stored")[0]["series"][0]["values"])
    e.query("DROP DATABASE stored; CREATE DATABASE stored")
    left = len(e.files.list(f"{e.root}/stored"))
    return spark.createDataFrame([(before, len(e.query("SHOW MEASUREMENTS", db="stored")[0].get("series", [])), left, e.sql("SELECT value FROM ev", db="stored").count())], "before int, after int, files int, rows long")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch of all events that runs twice, as after a failure: facts and the view that it feeds count once; so do lines without a time."""
    e = engine(spark, sf_dir, scratch_folder(spark, "engine"))
    rows = e.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
    e.write("ev,event_type=none,user_id=0 value=0 0")
    e.query("CREATE MATERIALIZED VIEW v ON main AS SELECT sum(value) AS s, count(value) AS n INTO roll FROM ev GROUP BY time(1d), event_type")
    lines = encode_rows(rows, "ev").withColumn("value", F.when(F.col("value").contains("event_id=3i"), F.regexp_replace("value", r" \d+$", "")).otherwise(F.col("value")))
    for _ in range(2):
        e.write_micro_batch(lines, "a stream", 0)
    e.now = lambda: NOW_NS + 1
    e.write_micro_batch(spark.createDataFrame([("ev,event_type=late,user_id=0 value=5 86400000000000",), ("not a line",)], "value string"), "a stream", 1)
    facts = e.sql("SELECT sum(value) AS s, count(value) AS n FROM ev WHERE time > 0 GROUP BY event_type", ordered=False)
    view = e.sql("SELECT sum(s) AS s, sum(n) AS n FROM roll GROUP BY event_type", ordered=False)
    return facts.select(F.lit("facts").alias("of"), "*").union(view.select(F.lit("view").alias("of"), "*")).union(e.rejected().select(F.lit("rejected"), F.regexp_extract("error", "not a line", 0), F.lit(0.0), F.lit(1).cast("long")))


QUERIES: dict[str, Query] = {
    # the flagship: hourly means on a full grid, every series for itself
    "flagship": Query(
        f'SELECT mean("value") AS "mean_value", count("value") AS "n" FROM "events" WHERE {RANGE} GROUP BY time(1h), "event_type" fill(null)',
        f"""WITH b AS (SELECT {bucket('1 hour')} AS time, event_type, avg(value) AS mean_value, count(value) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL)
        SELECT t.time, s.event_type, b.mean_value, b.n FROM (SELECT DISTINCT event_type FROM b) s
        CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06 23:00:00', INTERVAL '1 hour')) AS time) t LEFT JOIN b USING (time, event_type)""",
        ("mean_value",),
    ),
    # aggregates
    "mean": _aggregate("mean(value)", "avg(value)"),
    "median": _aggregate("median(value)", "median(value)"),
    "count": _aggregate("count(value)", "count(value)", False),
    "count_star": _aggregate("count(*)", "count(*)", False),
    "count_distinct": _aggregate("count(distinct(value))", "count(DISTINCT value)", False),
    "sum": _aggregate("sum(value)", "sum(value)"),
    "sum_integer": _aggregate("sum(event_id)", "CAST(sum(event_id) AS BIGINT)", False),
    "min": _aggregate("min(value)", "min(value)"),
    "max": _aggregate("max(value)", "max(value)"),
    "first": _aggregate("first(value)", "arg_min(value, ts)"),
    "last": _aggregate("last(value)", "arg_max(value, ts)"),
    "first_string": _aggregate("first(props)", "arg_min(props, ts)", False),
    "percentile": _aggregate("percentile(value, 95)", "quantile_disc(value, 0.95)"),
    "spread": _aggregate("spread(value)", "max(value) - min(value)"),
    "stddev": _aggregate("stddev(value)", "stddev_samp(value)"),
    "mode": Query("SELECT mode(value) AS x FROM events GROUP BY event_type", "SELECT event_type, value AS x FROM (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value) = 1", ("x",)),
    "distinct": Query("SELECT distinct(value) AS x FROM events WHERE value < 20 GROUP BY event_type", "SELECT DISTINCT event_type, value AS x FROM events WHERE value < 20", ("x",)),
    "distinct_keyword": Query("SELECT DISTINCT event_id FROM events WHERE event_id < 50", "SELECT DISTINCT event_id AS distinct_event_id FROM events WHERE event_id < 50"),
    "aggregate_whole_table": Query("SELECT mean(value), count(value) AS n FROM events", "SELECT avg(value) AS mean_value, count(value) AS n FROM events", ("mean_value",)),
    # grouping
    "group_by_star": Query("SELECT count(value) AS n FROM events GROUP BY *", "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(value) AS n FROM events GROUP BY ALL"),
    "group_by_regex": Query("SELECT count(value) AS n FROM events GROUP BY /^event/", "SELECT event_type, count(value) AS n FROM events GROUP BY ALL"),
    "group_by_missing_tag": Query("SELECT count(value) AS n FROM events GROUP BY nosuch", "SELECT '' AS nosuch, count(value) AS n FROM events"),
    "bucket_week": Query("SELECT count(value) AS n FROM events GROUP BY time(1w) fill(none)", f"SELECT {bucket('7 days')} AS time, count(value) AS n FROM events GROUP BY ALL"),
    "bucket_offset": Query(f"SELECT count(value) AS n FROM events WHERE {RANGE} GROUP BY time(1m, 30s) fill(none)", f"SELECT {bucket('1 minute', 'ts', '1970-01-01 00:00:30')} AS time, count(value) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL"),
    "bucket_zone_day": Query(
        "SELECT count(value) AS n FROM events GROUP BY time(1d), event_type fill(none) tz('America/New_York')",
        "SELECT (date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS time, event_type, count(value) AS n FROM events GROUP BY ALL",
    ),
    "bucket_zone_hours": Query(
        "SELECT sum(value) AS s FROM events GROUP BY time(6h) fill(none) tz('Asia/Kolkata')",
        f"SELECT {bucket('6 hours', '(ts + INTERVAL 330 MINUTE)')} - INTERVAL 330 MINUTE AS time, sum(value) AS s FROM events GROUP BY ALL", ("s",),
    ),
    # transforms
    "derivative": _transformed("derivative(mean(value), 1h)", f"(m - lag(m) {BY_TAG}) / ({SECONDS} / 3600)"),
    "non_negative_derivative": _transformed("non_negative_derivative(mean(value))", f"CASE WHEN m >= lag(m) {BY_TAG} THEN (m - lag(m) {BY_TAG}) / {SECONDS} END"),
    "difference": _transformed("difference(mean(value))", f"m - lag(m) {BY_TAG}"),
    "non_negative_difference": _transformed("non_negative_difference(mean(value))", f"CASE WHEN m >= lag(m) {BY_TAG} THEN m - lag(m) {BY_TAG} END"),
    "moving_average": _transformed("moving_average(mean(value), 4)", "CASE WHEN count(m) OVER w = 4 THEN avg(m) OVER w END".replace("OVER w", "OVER (PARTITION BY event_type ORDER BY time ROWS 3 PRECEDING)")),
    "cumulative_sum": _transformed("cumulative_sum(sum(value))", f"sum(s) {BY_TAG}"),
    "elapsed": _transformed("elapsed(count(value), 1h)", f"{SECONDS} / 3600"),
    "difference_raw": Query(
        "SELECT difference(value) AS x FROM events GROUP BY event_type",
        "SELECT time, event_type, x FROM (SELECT ts AS time, event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS x FROM events) WHERE x IS NOT NULL", ("x",),
    ),
    "cumulative_sum_raw": Query(f"SELECT cumulative_sum(value) AS x FROM events WHERE {RANGE} GROUP BY event_type", f"SELECT ts AS time, event_type, sum(value) OVER (PARTITION BY event_type ORDER BY ts) AS x FROM events WHERE {SQL_RANGE}", ("x",)),
    "moving_average_raw": Query(
        "SELECT moving_average(value, 10) AS x, cumulative_sum(event_id) AS c FROM events GROUP BY event_type",
        "SELECT time, event_type, x, c FROM (SELECT ts AS time, event_type, CASE WHEN count(value) OVER w = 10 THEN avg(value) OVER w END AS x, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 9 PRECEDING))", ("x",),
    ),
    "untagged_raw": Query(
        "SELECT difference(value) AS d, cumulative_sum(value) AS c, elapsed(value, 1s) AS e, derivative(value, 1h) AS r, non_negative_difference(event_id) AS i FROM events WHERE event_type = 'click'",
        """SELECT time, d, c, e, r, i FROM (SELECT ts AS time, value - lag(value) OVER w AS d, sum(value) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS e,
        (value - lag(value) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9, 0) AS r, CASE WHEN event_id >= lag(event_id) OVER w THEN event_id - lag(event_id) OVER w END AS i FROM events WHERE event_type = 'click' WINDOW w AS (ORDER BY ts))""", ("d", "c", "e", "r"),
    ),
    # fill
    "fill_default": _filled("", "SELECT time, event_type, m FROM j"),
    "fill_null": _filled("fill(null)", "SELECT time, event_type, m FROM j"),
    "fill_none": _filled("fill(none)", "SELECT time, event_type, m FROM b"),
    "fill_value": _filled("fill(-1)", "SELECT time, event_type, coalesce(m, -1) AS m FROM j"),
    "fill_previous": _filled("fill(previous)", "SELECT time, event_type, last_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY time) AS m FROM j"),
    "fill_linear": _filled(
        "fill(linear)",
        """SELECT time, event_type, CASE WHEN own THEN m WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * ((epoch_us(time) - pi) / (ni - pi)) END AS m FROM (SELECT *,
        last_value(m IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN m IS NOT NULL THEN epoch_us(time) END IGNORE NULLS) OVER p AS pi,
        first_value(m IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN m IS NOT NULL THEN epoch_us(time) END IGNORE NULLS) OVER n AS ni FROM j
        WINDOW p AS (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    ),
    "fill_between_own_buckets": Query(
        "SELECT count(value) AS n FROM events WHERE user_id = '3' GROUP BY time(6h) fill(0)",
        f"""WITH b AS (SELECT {bucket('6 hours')} AS time, count(value) AS n FROM events WHERE user_id = 3 GROUP BY ALL)
        SELECT t.time, coalesce(b.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(time) FROM b), (SELECT max(time) FROM b), INTERVAL '6 hours')) AS time) t LEFT JOIN b USING (time)""",
    ),
    "fill_without_group": Query("SELECT mean(value) AS m, count(value) AS n FROM events WHERE event_type = 'click' fill(0)", "SELECT avg(value) AS m, count(value) AS n FROM events WHERE event_type = 'click'", ("m",)),
    "fill_descending_limit": Query(
        f"SELECT mean(value) AS m FROM events WHERE {GAPPY} GROUP BY time(10m), event_type fill(null) ORDER BY time DESC LIMIT 7",
        f"WITH {GRID} SELECT time, event_type, m FROM j QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY time DESC) <= 7", ("m",),
    ),
    # projection, predicates, expressions
    "select_star": Query(f"SELECT * FROM events WHERE {RANGE}", f"SELECT ts AS time, value, event_id, props, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE {SQL_RANGE}", ("value",)),
    "select_fields": Query("SELECT value, event_id AS id FROM events WHERE value > 200", "SELECT ts AS time, value, event_id AS id FROM events WHERE value > 200", ("value",)),
    "select_tag_and_field": Query("SELECT value, user_id::tag FROM events WHERE value > 200", "SELECT ts AS time, value, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE value > 200", ("value",)),
    "arithmetic_raw": Query("SELECT value * 2 + 1 AS a, value / event_id AS b, -value AS c, event_id % 7 AS d FROM events", "SELECT ts AS time, value * 2 + 1 AS a, value / nullif(event_id, 0) AS b, -value AS c, event_id % 7 AS d FROM events", ("a", "b", "c")),
    "arithmetic_of_aggregates": Query("SELECT mean(value) * 100 - max(value) / min(event_id) AS x FROM events GROUP BY event_type", "SELECT event_type, avg(value) * 100 - max(value) / nullif(min(event_id), 0) AS x FROM events GROUP BY event_type", ("x",)),
    "where_and_or": Query("SELECT value FROM events WHERE (event_type = 'click' OR event_type = 'error') AND value >= 50 AND value <> 60", "SELECT ts AS time, value FROM events WHERE event_type IN ('click', 'error') AND value >= 50 AND value <> 60", ("value",)),
    "where_regex": Query("SELECT count(value) AS n FROM events WHERE event_type =~ /c/ AND event_type !~ /^click/ GROUP BY event_type", "SELECT event_type, count(value) AS n FROM events WHERE event_type LIKE '%c%' AND event_type NOT LIKE 'click%' GROUP BY ALL"),
    "where_tag_is_number": Query("SELECT count(value) AS n FROM events WHERE user_id = 3", "SELECT count(value) AS n FROM events WHERE false"),
    "where_time_integer": Query("SELECT value FROM events WHERE time >= 1704412800000000000 AND time < 1704499200s", "SELECT ts AS time, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'", ("value",)),
    "where_now": Query("SELECT count(value) AS n FROM events WHERE time > now() - 10d", "SELECT count(value) AS n FROM events WHERE ts > TIMESTAMP '2024-01-22'"),
    "bind_parameters": Query(lambda spark, d: engine(spark, d).sql("SELECT sum(value) AS s FROM events WHERE event_type = $kind AND value > $least", {"kind": "click", "least": 10}), "SELECT sum(value) AS s FROM events WHERE event_type = 'click' AND value > 10", ("s",)),
    # order, limits
    "limit_all": Query("SELECT value FROM events ORDER BY time DESC LIMIT 10 OFFSET 5", "SELECT ts AS time, value FROM events ORDER BY ts DESC LIMIT 10 OFFSET 5", ("value",)),
    "limit_by_series": Query("SELECT value FROM events GROUP BY event_type LIMIT 3 OFFSET 2", "SELECT ts AS time, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) BETWEEN 3 AND 5", ("value",)),
    "limit_series": Query("SELECT mean(value) AS m FROM events GROUP BY user_id SLIMIT 4 SOFFSET 3", "SELECT CAST(user_id AS VARCHAR) AS user_id, avg(value) AS m FROM events GROUP BY ALL ORDER BY 1 LIMIT 4 OFFSET 3", ("m",)),
    # sources
    "source_regex": Query("SELECT count(*) AS n FROM /(events|orders)/", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders"),
    "source_list": Query("SELECT max(value) AS a FROM events, events", "SELECT 'events' AS name, max(value) AS a FROM events UNION ALL SELECT 'events', max(value) FROM events", ("a",)),
    "source_pair": Query("SELECT count(*) AS n FROM events, orders", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders"),
    "source_qualified": Query(_qualified, f"SELECT 'long' AS rp, event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL UNION ALL SELECT 'autogen', 'click', 1.0::DOUBLE, 1", ("s",)),
    "source_raw_sql": Query(_raw_sql, "SELECT event_type, count(*) AS n FROM events GROUP BY ALL"),
    "source_missing": Query("SELECT value FROM nosuch", "SELECT TIMESTAMP '2000-01-01' AS time WHERE false"),
    "subquery": Query("SELECT max(m) AS x FROM (SELECT mean(value) AS m FROM events GROUP BY time(1d), event_type fill(none)) GROUP BY event_type", f"{DAILY} SELECT event_type, max(m) AS x FROM d GROUP BY event_type", ("x",)),
    "subquery_nested": Query("SELECT sum(x) AS t FROM (SELECT max(m) AS x FROM (SELECT mean(value) AS m FROM events GROUP BY time(1h), event_type fill(none)) GROUP BY time(1d) fill(none))", f"SELECT sum(x) AS t FROM (SELECT {bucket('1 day', 'time')} AS d, max(m) AS x FROM (SELECT {bucket('1 hour')} AS time, event_type, avg(value) AS m FROM events GROUP BY ALL) GROUP BY ALL)", ("t",)),
    "coalesced_duplicates": Query(
        "SELECT l_quantity, l_extendedprice FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_shipdate AS time, l_returnflag, l_linestatus, arg_max(l_quantity, o) AS l_quantity, arg_max(l_extendedprice, o) AS l_extendedprice FROM (SELECT *, (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS o FROM lineitem) GROUP BY ALL", ("l_quantity", "l_extendedprice"),
    ),
    "coalesced_aggregate": Query(
        "SELECT sum(l_quantity) AS s FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag",
        """SELECT l_returnflag, sum(q) AS s FROM (SELECT l_shipdate, l_returnflag, l_linestatus, arg_max(l_quantity, o) AS q, arg_max(l_discount, o) AS d FROM (SELECT *, (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS o FROM lineitem) GROUP BY ALL) WHERE d > 0.02 GROUP BY ALL""", ("s",),
    ),
    # storage
    "stored_last_write_wins": Query(_stored_select(f"SELECT sum(value) AS s, count(event_id) AS n FROM ev {BOUND} GROUP BY event_type"), f"SELECT event_type, sum({NEW_VALUE}) AS s, count(event_id) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL", ("s",)),
    "stored_tag_filter": Query(_stored_select("SELECT value FROM ev WHERE event_type = 'click' AND time >= '2024-01-05T00:00:00Z' AND time < '2024-01-06T00:00:00Z'"), f"SELECT ts AS time, {NEW_VALUE} AS value FROM events WHERE {SQL_RANGE} AND event_type = 'click' AND ts < TIMESTAMP '2024-01-06'", ("value",)),
    "stored_tombstones": Query(_tombstones, f"SELECT event_type, sum({NEW_VALUE}) AS s, count(*) AS n FROM events WHERE {SQL_RANGE} AND event_type <> 'click' AND NOT (ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-05 18:00:00') GROUP BY ALL", ("s",)),
    "select_into": Query(_into, f"SELECT {bucket('1 hour')} AS time, event_type, avg({NEW_VALUE}) AS m, CAST(count(*) AS DOUBLE) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL", ("m", "n")),
    "materialized_view": Query(
        _view,
        f"SELECT {bucket('6 hours')} AS time, event_type, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, arg_min(value, ts) AS f, arg_max(value, ts) AS l, avg(value) AS m FROM events WHERE {SQL_RANGE} GROUP BY ALL", ("s", "lo", "hi", "f", "l", "m"),
    ),
    "materialized_view_stream": Query(_streamed, f"SELECT {bucket('1 day')} AS time, event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL", ("s",)),
    "continuous_query": Query(_continuous, f"SELECT {bucket('1 hour')} AS time, event_type, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-05 09:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00' GROUP BY ALL", ("m",)),
    "stream_ingest": Query(_stream_ingest, f"SELECT event_type, sum(value) AS s, count(event_id) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL", ("s",)),
    # a window is final once the watermark, an hour behind the last event, has passed it
    "stream_windows": Query(_watermarked, f"SELECT {bucket('1 day')} AS time, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2 HAVING {bucket('1 day')} + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", ("total",)),
    "stream_replay": Query(
        _replayed,
        "WITH x AS (SELECT event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL UNION ALL SELECT 'late', 5.0, 1) SELECT 'facts' AS of, * FROM x UNION ALL SELECT 'view', * FROM x UNION ALL SELECT 'rejected', 'not a line', 0.0, 1", ("s",),
    ),
    "precision_seconds": Query(_precise, "SELECT date_trunc('second', ts) AS time, CAST(event_id AS VARCHAR) AS id, value FROM events", ("value",)),
    "drop_database_written": Query(_dropped, "SELECT 1 AS before, 0 AS after, 0 AS files, 0::BIGINT AS rows"),
    "refused": Query(_refused, "SELECT unnest([" + ", ".join("'" + x + "'" for x in (*REFUSED, "write roll")) + "]) AS statement, true AS refused UNION ALL SELECT 'write other', false"),
    "export_import": Query(_export_import, f"SELECT ts AS time, event_type, {NEW_VALUE} AS value, event_id FROM events WHERE {SQL_RANGE}", ("value",)),
    "columnar_source": Query(_columnar, "SELECT event_type, sum(value) AS s, count(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL", ("s",)),
    "msgpack_source": Query(_msgpack, "SELECT TIMESTAMP '1970-01-01 00:00:01' AS time, 'a' AS host, 1.5::DOUBLE AS v, true AS ok, 'a' AS \"name\" UNION ALL SELECT TIMESTAMP '1970-01-01 00:00:02', 'b', 2.5, true, 'b'"),
    "compacted": Query(_compacted, f"SELECT event_type, sum({NEW_VALUE}) AS s, count(event_id) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL", ("s",)),
    "retention": Query(_retention, "SELECT event_type, count(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-07' GROUP BY ALL"),
    # metadata and results
    "show_measurements": Query(_metadata("SHOW MEASUREMENTS", "name string"), "SELECT unnest(['events', 'lineitem', 'orders']) AS name"),
    "show_tag_keys": Query(_metadata("SHOW TAG KEYS FROM events", "tagKey string"), "SELECT unnest(['event_type', 'user_id']) AS tagKey"),
    "show_field_keys": Query(_metadata("SHOW FIELD KEYS FROM events", "fieldKey string, fieldType string"), "SELECT unnest(['event_id', 'props', 'value']) AS fieldKey, unnest(['integer', 'string', 'float']) AS fieldType"),
    "show_tag_values": Query(_metadata("SHOW TAG VALUES FROM events WITH KEY = event_type", "key string, value string"), "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events"),
    "show_series": Query(_metadata("SHOW SERIES FROM orders", "key string"), "SELECT DISTINCT 'orders,o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus AS key FROM orders"),
    "show_retention_policies": Query(_metadata("SHOW RETENTION POLICIES", "name string, duration string, shardGroupDuration string, replicaN long, `default` boolean"), "SELECT 'autogen' AS name, '0s' AS duration, '168h0m0s' AS shardGroupDuration, 1::BIGINT AS replicaN, true AS \"default\""),
    "show_databases": Query(_after("CREATE DATABASE extra; DROP DATABASE nosuch", "SHOW DATABASES", "name string"), "SELECT unnest(['extra', 'main']) AS name"),
    "retention_policies": Query(
        _after("CREATE DATABASE d WITH DURATION 30d NAME month; CREATE RETENTION POLICY p ON d DURATION 2h REPLICATION 1; ALTER RETENTION POLICY p ON d DURATION INF DEFAULT; CREATE RETENTION POLICY q ON d DURATION 1w REPLICATION 2; DROP RETENTION POLICY month ON d", "SHOW RETENTION POLICIES ON d", "name string, duration string, shardGroupDuration string, replicaN long, `default` boolean"),
        "SELECT * FROM (VALUES ('p', '0s', '168h0m0s', 1::BIGINT, true), ('q', '168h0m0s', '24h0m0s', 2::BIGINT, false)) AS t(name, duration, shardGroupDuration, replicaN, \"default\")",
    ),
    "drop_measurement": Query(_after("DROP MEASUREMENT orders", "SHOW MEASUREMENTS WITH MEASUREMENT =~ /e/", "name string"), "SELECT unnest(['events', 'lineitem']) AS name"),
    "show_continuous_queries": Query(
        _after("CREATE CONTINUOUS QUERY a ON main RESAMPLE EVERY 1h FOR 2h BEGIN SELECT mean(value) INTO x FROM events GROUP BY time(1h) END; CREATE CONTINUOUS QUERY b ON main BEGIN SELECT max(value) INTO y FROM events GROUP BY time(1h) END; DROP CONTINUOUS QUERY b ON main", "SHOW CONTINUOUS QUERIES", "name string, query string"),
        "SELECT 'a' AS name, 'CREATE CONTINUOUS QUERY a ON main RESAMPLE EVERY 1h FOR 2h BEGIN SELECT mean(value) INTO x FROM events GROUP BY time(1h) END' AS query",
    ),
    "show_materialized_views": Query(
        _after("CREATE MATERIALIZED VIEW v ON main AS SELECT sum(value) INTO r FROM events GROUP BY time(1h); CREATE MATERIALIZED VIEW w ON main AS SELECT sum(value) INTO s FROM events GROUP BY time(1h); DROP MATERIALIZED VIEW w ON main", "SHOW MATERIALIZED VIEWS", "name string, database string, query string, source string, dest string"),
        "SELECT 'v' AS name, 'main' AS database, 'SELECT sum(value) INTO r FROM events GROUP BY time(1h)' AS query, 'events' AS source, 'r' AS dest",
    ),
    "json_result": Query(_json, f"SELECT event_type, epoch_us({bucket('1 day')}) // 1000000 AS epoch, count(value) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL"),
    "statement_summary": Query(_summary, "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT), (2::BIGINT, 0::BIGINT)) AS t(n, failed)"),
    "chunked_result": Query(_chunked, f"SELECT event_type, epoch_us({bucket('1 day')}) // 1000000 AS epoch, count(value) AS n FROM events GROUP BY ALL"),
    "csv_result": Query(
        _csv,
        f"""WITH b AS (SELECT {bucket('12 hours')} AS time, event_type, count(value) AS n FROM events WHERE {SQL_RANGE} GROUP BY ALL), s AS (SELECT DISTINCT event_type FROM b),
        g AS (SELECT event_type, time, n FROM s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06 12:00:00', INTERVAL '12 hours')) AS time) LEFT JOIN b USING (event_type, time)),
        l AS (SELECT event_type, 0 AS k, NULL AS time, 'name: events' AS text FROM s UNION ALL SELECT event_type, 1, NULL, 'time,n,event_type' FROM s
              UNION ALL SELECT event_type, 2, time, epoch_us(time) // 1000000 || ',' || coalesce(CAST(n AS VARCHAR), '') || ',' || event_type FROM g)
        SELECT CAST(row_number() OVER (ORDER BY event_type, k, time) - 1 AS INTEGER) AS line, text FROM l""",
    ),
}

QUERIES |= {f"{name}_in_slices": Query(_in_slices(QUERIES[name].how), QUERIES[name].sql, QUERIES[name].floats) for name in ("difference_raw", "moving_average_raw", "untagged_raw")}

# the same over all events: what is read back, filled and shown isn't bounded either
_ALL = {
    "flagship": f'SELECT mean("value") AS "mean_value", count("value") AS "n" FROM "events" WHERE {WHOLE} GROUP BY time(1h), "event_type" fill(null)',
    "distinct": "SELECT distinct(value) AS x FROM events GROUP BY event_type",
    "distinct_keyword": "SELECT DISTINCT event_id FROM events",
    "bucket_offset": "SELECT count(value) AS n FROM events GROUP BY time(1m, 30s) fill(none)",
    "cumulative_sum_raw": "SELECT cumulative_sum(value) AS x FROM events GROUP BY event_type",
    "select_star": "SELECT * FROM events",
    **{name: QUERIES[name].how.replace(GAPPY, WHOLE) for name in ("fill_default", "fill_null", "fill_none", "fill_value", "fill_previous", "fill_linear", "fill_descending_limit")},
    "stored_last_write_wins": _stored_select("SELECT sum(value) AS s, count(event_id) AS n FROM ev GROUP BY event_type"),
    "stored_tag_filter": _stored_select("SELECT value FROM ev WHERE event_type = 'click'"),
    **{name: partial(QUERIES[name].how, where="") for name in ("stored_tombstones", "select_into", "materialized_view", "stream_ingest", "export_import", "columnar_source", "compacted", "retention")},
    **{name: partial(QUERIES[name].how, where=f"WHERE {WHOLE}") for name in ("json_result", "csv_result")},
}


def _unbounded(sql: str | None) -> str | None:
    """The SQL of a bounded query, over all events."""
    if sql is None:
        return None
    days = ("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'", " AND ts < TIMESTAMP '2024-01-06'", " AND ts < TIMESTAMP '2024-01-07'", "value < 20", "event_id < 50")
    for bound in (SQL_GAPPY, SQL_RANGE, *days):
        sql = sql.replace(bound, "" if bound.startswith(" AND") else "true")
    for ends, every in (("'2024-01-05', TIMESTAMP '2024-01-05 11:50:00'", "'2024-01-01', TIMESTAMP '2024-01-30 23:50:00'"), ("'2024-01-05', TIMESTAMP '2024-01-06 23:00:00'", "'2024-01-01', TIMESTAMP '2024-01-30 23:00:00'"), ("'2024-01-05', TIMESTAMP '2024-01-06 12:00:00'", "'2024-01-01', TIMESTAMP '2024-01-30 12:00:00'")):
        sql = sql.replace(f"TIMESTAMP {ends}", f"TIMESTAMP {every}")
    return sql


# without SQL where a tie in the last rounded decimal makes rows differ; the tests compare those rows within that decimal
QUERIES |= {f"{name}_whole": Query(how, None if name == "fill_linear" else _unbounded(QUERIES[name].sql), QUERIES[name].floats) for name, how in _ALL.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle()) is not None}
