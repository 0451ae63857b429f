"""The engine: databases of measurements over DataFrames, statements, ingest and rollups."""

from __future__ import annotations

import functools
import json
import logging
import re
import threading
import time as clock
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, FloatType, IntegralType

from tidemark import result
from tidemark.functions.durations import duration_text
from tidemark.operators.aggregates import quoted
from tidemark.plans.ast import Measurement, QueryError, Select, Statement
from tidemark.plans.digest import StatementLog
from tidemark.plans.parser import parse, parse_one
from tidemark.plans.planner import Frame, Planner, cq_select
from tidemark.plans.resolve import Bounds, Conditions, Early, Schema, full_or_prefix_match
from tidemark.sources import line_protocol, msgpack
from tidemark.sources.catalog import SPARK_TYPES, Catalog, add_version, merged, new_measurement, policy, widen
from tidemark.sources.fsio import Files
from tidemark.sources.tables import FrameTable, StoredTable
from tidemark.streaming import rollup
from tidemark.streaming.schedule import Schedule


class WriteError(QueryError):
    """A write is rejected as a whole."""


class Limits:
    """Guards of a write: points, distinct values of a tag in a measurement, measurements in a database; None is no guard."""

    def __init__(self, points: int | None = 500_000, tag_values: int | None = None, measurements: int | None = None):
        self.points, self.tag_values, self.measurements = points, tag_values, measurements


class Engine:
    """Databases, each with retention policies and measurements.

    Measurements are DataFrames registered for reading, or are written through write() into Parquet under root,
    a folder in any file system that Spark reaches. The session's time zone is set to UTC. Functions of raw series
    run within one task a series where all rows are estimated at whole_series_bytes at most, beyond that in slices.
    """

    whole_series_bytes = 64 << 20

    def __init__(self, spark: SparkSession, root: str | None = None, *, db: str = "main", now: Callable[[], int] = clock.time_ns, linear_compat: bool = False, limits: Limits | None = None):
        self.spark, self.root, self.default_db, self.now, self.linear_compat = spark, root and root.rstrip("/"), db, now, linear_compat
        self.limits = limits or Limits()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.files = Files(spark)
        self.catalog = Catalog(self.files, f"{self.root}/catalog.json" if root else None)
        self.frames: dict[tuple[str, str, str], FrameTable] = {}
        self.log = StatementLog()
        if db not in self.catalog.databases:
            self.catalog.create_database(db)

    # Registration

    def register(self, name: str, df: DataFrame, time: str, tags: Iterable[str] = (), fields: Iterable[str] | None = None, *, order: list[str] | None = None, db: str | None = None, rp: str | None = None) -> None:
        """Makes a DataFrame a measurement; fields are by default all other columns. See FrameTable for order."""
        db = db or self.default_db
        rp = self.catalog.rp(db, rp)
        tags = list(tags)
        fields = [c for c in df.columns if c != time and c not in tags] if fields is None else list(fields)
        self.frames[db, rp, name] = FrameTable(name, df, time, tags, fields, order, lambda s: self._tombstones(db, rp, name, s))

    def _tombstones(self, db: str, rp: str, name: str, schema: Schema) -> Column | None:
        meta = self.catalog.measurement(db, rp, name) or {}
        out = None
        for text in meta.get("tombstones", []):
            c = F.lit(True) if text == "*" else Conditions(schema, self.now()).column(parse_one(f"SELECT x FROM m WHERE {text}").where)
            out = c if out is None else out | c
        return out

    # Reading

    def _lookup(self, m: Measurement, db: str | None, rp: str | None) -> list:
        db = m.db or db or self.default_db
        rp = self.catalog.rp(db, m.rp or rp)
        names = self._names(db, rp)
        if m.regex is not None:
            names = [n for n in names if full_or_prefix_match(m.regex, n)]
        else:
            names = [m.name] if m.name in names else []
        return [t for n in names if (t := self._table(db, rp, n)) is not None]

    def _names(self, db: str, rp: str) -> list[str]:
        return sorted({n for d, r, n in self.frames if (d, r) == (db, rp)} | set(self.catalog.measurements(db, rp)))

    def _table(self, db: str, rp: str, name: str):
        if (db, rp, name) in self.frames:
            return self.frames[db, rp, name]
        meta = self.catalog.measurement(db, rp, name)
        if meta is None or not meta["fields"]:
            return None
        return StoredTable(self.spark, self.files, name, self._folder(db, rp, name), meta, lambda s: self._tombstones(db, rp, name, s))

    def _folder(self, db: str, rp: str, name: str) -> str:
        safe = lambda s: re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):04x}", s)
        if self.root is None:
            raise WriteError("an engine without a root holds no data of its own")
        return f"{self.root}/{safe(db)}/{safe(rp)}/{safe(name)}"

    def planner(self, ordered: bool = True) -> Planner:
        return Planner(self._lookup, self.now(), self.linear_compat, ordered, self.whole_series_bytes)

    def sql(self, text: str, params: Mapping[str, object] | None = None, *, db: str | None = None, rp: str | None = None, ordered: bool = True) -> DataFrame:
        """One SELECT as a flat DataFrame: time, tags, columns. Several measurements are appended, with their name in front."""
        q = parse_one(text, params)
        if not isinstance(q, Select):
            raise QueryError("sql() takes a SELECT; see query()")
        frames = self.planner(ordered).plan(q, db, rp)
        if not frames:
            return self.spark.createDataFrame([], "time timestamp_ntz")
        flat = [f.df.select(*(["time"] if f.has_time else []), *[F.col(quoted(c)) for c in [*f.tags, *f.columns]]) for f in frames]
        if len(frames) == 1:
            return flat[0]
        named = [d.select(F.lit(f.name).alias("name"), *[F.col(quoted(c)) for c in d.columns]) for f, d in zip(frames, flat, strict=True)]
        out = named[0]
        for d in named[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return out

    def raw_sql(self, text: str) -> DataFrame:
        """Spark SQL as it stands."""
        return self.spark.sql(text)

    def query(self, text: str, params: Mapping[str, object] | None = None, *, db: str | None = None, rp: str | None = None, epoch: str | None = None) -> list[dict]:
        """All statements of a text, one after the other; a result for each, with its series."""
        out = []
        for i, s in enumerate(parse(text, params)):
            began = clock.perf_counter()
            try:
                series = self._select(s, db, rp, epoch) if isinstance(s, Select) else self._statement(s, db, rp)
            except Exception:
                self.log.add(s, clock.perf_counter() - began, failed=True)
                raise
            self.log.add(s, clock.perf_counter() - began)
            out.append({"statement_id": i, "series": series} if series else {"statement_id": i})
        return out

    def chunks(self, text: str, params: Mapping[str, object] | None = None, *, db: str | None = None, rp: str | None = None, epoch: str | None = None, size: int = 10_000) -> Iterator[dict]:
        """The results of query() in pieces of at most `size` rows of one series, as Spark hands them over: the driver holds one piece at a time.

        A piece whose series (or statement) goes on in the next one says partial.
        """
        for i, s in enumerate(parse(text, params)):
            if not isinstance(s, Select) or s.into is not None or s.slimit is not None or s.soffset:
                series: Iterable[dict] = (self._select(s, db, rp, epoch) if isinstance(s, Select) else self._statement(s, db, rp)) or [{}]
            else:
                series = (x for f in self.planner().plan(s, db, rp) for x in result.series_of(f, epoch, size))
            held = None
            for x in series:
                if held is not None:
                    yield {"statement_id": i, "series": [held], "partial": True}
                held = x
            yield {"statement_id": i, "series": [held]} if held else {"statement_id": i}

    def _select(self, q: Select, db: str | None, rp: str | None, epoch: str | None) -> list[dict]:
        if q.into is not None:
            n = self.select_into(q, db, rp)
            return [result.table("result", ["time", "written"], [["1970-01-01T00:00:00Z" if epoch is None else 0, n]])]
        # SLIMIT and SOFFSET count series over all measurements
        frames = self.planner().plan(replace(q, slimit=None, soffset=None) if len(q.sources) > 1 or any(getattr(m, "regex", None) for m in q.sources) else q, db, rp)
        series = [s for f in frames for s in result.series_of(f, epoch)]
        if len(frames) > 1 and (q.slimit is not None or q.soffset):
            first = q.soffset or 0
            series = series[first:] if q.slimit is None else series[first : first + q.slimit]
        return series

    # Writing

    def write(self, lines: str | Iterable[str] | DataFrame, *, db: str | None = None, rp: str | None = None, precision: str | None = None) -> int:
        """Line protocol, as text or as a frame with a column value. The write takes place as a whole or not at all."""
        bulk = isinstance(lines, DataFrame)
        if not bulk:
            held = lines.split("\n") if isinstance(lines, str) else list(lines)
            lines = self.spark.createDataFrame([(x,) for x in held], "value string")
        return self.write_points(line_protocol.parse_lines(lines, precision, self.now()), db=db, rp=rp, bulk=bulk)

    def write_files(self, path: str, *, db: str | None = None, rp: str | None = None, precision: str | None = None) -> int:
        """Line protocol files, plain or gzipped, read by the executors, of any number of lines."""
        return self.write_points(line_protocol.parse_lines(self.spark.read.text(path), precision, self.now()), db=db, rp=rp, bulk=True)

    def write_msgpack(self, body: bytes | DataFrame, *, columnar: bool = False, db: str | None = None, rp: str | None = None) -> int:
        """A MessagePack body, or a frame with a binary column content, a body each (as the binaryFile source gives)."""
        bulk = isinstance(body, DataFrame)
        bodies = body if bulk else self.spark.createDataFrame([(bytearray(body),)], "content binary")
        parse_bodies = msgpack.parse_columnar if columnar else msgpack.parse_bodies
        return self.write_points(parse_bodies(bodies, self.now()), db=db, rp=rp, bulk=bulk)

    def write_points(self, points: DataFrame, *, db: str | None = None, rp: str | None = None, guard: bool = True, bulk: bool = True) -> int:
        """Points as line_protocol.POINTS has them; returns their number. bulk: a frame, which executors read, isn't held against the largest number of points; the body of one request is (False)."""
        return self._write(points, db, rp, guard=guard, bulk=bulk)

    def _write(self, points: DataFrame, db: str | None, rp: str | None, *, guard: bool = True, bulk: bool = False, batch: int | None = None, now: int | None = None, again: bool = False, rejects: str | None = None) -> int:
        """Writes points as batch number `batch` (by default the next).

        The points are parsed once, into a staging folder parted by measurement. What the driver learns of them is their schema: types by measurement
        and field, tag keys, dates, counts. The catalog says what a write will do before any file of it is there, so a write that
        is broken off leaves nothing that reading would take for more than it is. Points that can't be parsed raise
        an error, or go to the folder `rejects`; again: the batch may have been written before.
        """
        if self.root is None:
            raise WriteError("an engine without a root holds no data of its own")
        db = db or self.default_db
        rp = self.catalog.rp(db, rp)
        batch = self.catalog.next_batch() if batch is None else batch
        now = self.now() if now is None else now
        stage = f"{self.root}/staging/{batch}"
        # later writes have larger numbers; within one, lines in the order of their partitions and places
        at = F.col("place") if "place" in points.columns else F.monotonically_increasing_id()
        seq = F.lit(batch << 44) + F.shiftright(at, 33) * (1 << 27) + at.bitwiseAND(F.lit((1 << 27) - 1))
        names = ["tags", "fields", "types", "time_ns", "error"]
        points.withColumn("time_ns", F.coalesce("time_ns", F.lit(now))).select("measurement", *names, seq.alias("seq")).write.mode("overwrite").partitionBy("measurement").parquet(stage)
        try:
            staged = self.spark.read.schema("tags map<string,string>, fields map<string,string>, types map<string,string>, time_ns bigint, error string, seq bigint, measurement string").parquet(stage)
            bad = staged.where("measurement is null and error is not null").select("error")
            if rejects is not None:
                if bad.head(1):
                    bad.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{rejects}/{batch}")
                staged = staged.where("error is null")
            elif first := bad.first():
                raise WriteError(f"unable to parse: {first[0][:500]}")
            counts = {r["measurement"]: r["count"] for r in staged.groupBy("measurement").count().collect()}
            total = sum(counts.values())
            if guard and not bulk and self.limits.points is not None and total > self.limits.points:
                raise WriteError(f"too many points: {total}")
            by_name: dict[str, tuple[dict, set, set]] = {m: ({}, set(), set()) for m in sorted(counts)}
            for r in staged.select("measurement", F.explode("types").alias("field", "kind")).distinct().collect():
                by_name[r["measurement"]][0].setdefault(r["field"], []).append(r["kind"])
            for r in staged.select("measurement", F.explode(F.map_keys("tags")).alias("tag")).distinct().collect():
                by_name[r["measurement"]][1].add(r["tag"])
            for r in staged.select("measurement", _time_of("time_ns").cast("date").cast("string").alias("date")).distinct().collect():
                by_name[r["measurement"]][2].add(r["date"])
            metas = self._checked(db, rp, by_name, staged if guard else None)
            for name, meta in metas.items():
                self._announce(db, rp, name, meta, by_name[name][2])
            self.catalog.save()
            for name, meta in metas.items():
                rows = staged.where(F.col("measurement") == name)
                self._append(db, rp, name, meta, rows)
                self._refresh_views(db, rp, name, meta, rows, batch, again)
            self.catalog.save()
        finally:
            self.files.delete(stage)
        return total

    def ingest_stream(self, lines: DataFrame, checkpoint: str, *, db: str | None = None, rp: str | None = None, precision: str | None = None, once: bool = True):
        """Writes a stream of line protocol (column value), a micro-batch at a time.

        A micro-batch that runs again after a failure has the same number and time of writing: its points are written
        again, which reading takes as one, and views that it has fed are left alone. Lines that can't be parsed
        don't stop the stream; see rejected().
        """

        return rollup.run_stream(lines, lambda df, number: self.write_micro_batch(df, self._stream_id(checkpoint), number, db=db, rp=rp, precision=precision), checkpoint, once=once)

    def write_micro_batch(self, lines: DataFrame, stream: str, number: int, *, db: str | None = None, rp: str | None = None, precision: str | None = None) -> int:
        """Writes one micro-batch of a stream that is known by a name of its own; the same number again is the same batch."""
        n, now, again = self.catalog.stream_batch(stream, number, self.now())
        return self._write(line_protocol.parse_lines(lines, precision, now), db, rp, guard=False, batch=n, now=now, again=again, rejects=f"{self.root}/rejected")

    def rejected(self) -> DataFrame:
        """Lines that streams could not parse: error (what is wrong, and the line) and batch."""
        folder = f"{self.root}/rejected"
        found = [f"{folder}/{x}" for x in self.files.list(folder)]
        schema = "error string, batch bigint"
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _stream_id(self, checkpoint: str) -> str:
        """The id that Spark gave a stream when its checkpoint was made."""
        return json.loads(self.files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"]

    def _checked(self, db: str, rp: str, by_name: dict, staged: DataFrame | None) -> dict[str, dict]:
        """The measurements' schemas after the write; raises before anything is written."""
        out = {}
        views = {(v["rp"], v["dest"]) for v in self.catalog.database(db)["mvs"].values()}
        fresh = [n for n in by_name if self.catalog.measurement(db, rp, n) is None]
        if self.limits.measurements is not None and len(self._names(db, rp)) + len(fresh) > self.limits.measurements:
            raise WriteError("too many measurements")
        for name, (fields, tags, _) in by_name.items():
            if staged is not None and (rp, name) in views:
                raise WriteError(f"{name} is the destination of a materialized view")
            meta = self.catalog.measurement(db, rp, name) or new_measurement()
            out[name] = merged(meta, {f: functools.reduce(widen, sorted(found), None) for f, found in sorted(fields.items())}, sorted(tags))
            if self.limits.tag_values is not None and staged is not None:
                seen = staged.where(F.col("measurement") == name).select(F.explode("tags").alias("k", "v")).groupBy("k").agg(F.count_distinct("v").alias("n")).where(F.col("n") > self.limits.tag_values).first()
                if seen:
                    raise WriteError(f"too many values of tag {seen['k']}")
        return out

    def _announce(self, db: str, rp: str, name: str, meta: dict, dates: set[str] | None) -> None:
        """Puts into the catalog what a write to these dates (None: any) makes of a measurement: dates that have facts are shared from now on."""
        folder = f"{self._folder(db, rp, name)}/facts"
        old = self.catalog.measurement(db, rp, name)
        known = {v["folder"] for v in old["versions"]} if old else {"v0"}
        for v in meta["versions"]:
            if v["folder"] not in known:  # what a broken-off compaction may have left
                self.files.delete(f"{folder}/{v['folder']}")
        if dates is None:
            meta["shared"] = "*"
        elif meta["shared"] != "*":
            held = {d[5:] for v in meta["versions"] for d in self.files.list(f"{folder}/{v['folder']}") if d.startswith("date=")}
            meta["shared"] = sorted({*meta["shared"], *(held & dates)})
        self.catalog.put_measurement(db, rp, name, meta)

    def _append(self, db: str, rp: str, name: str, meta: dict, points: DataFrame) -> None:
        """Writes one measurement's points: new series first, then facts, coalesced within the batch and parted by date."""
        folder = self._folder(db, rp, name)
        self._append_series(folder, points.select(_series_id(name), "tags"))
        version = meta["versions"][-1]
        merged_rows = self._facts_of(name, version["types"], points).drop("tags").withColumn("date", F.col("time").cast("date"))
        merged_rows.hint("rebalance", "date").sortWithinPartitions("date", "series_id", "time").write.mode("append").partitionBy("date").parquet(f"{folder}/facts/{version['folder']}")

    def _append_series(self, folder: str, series: DataFrame) -> None:
        """Adds the series (series_id, tags) that the measurement lacks."""
        series = series.dropDuplicates(["series_id"])
        if self.files.exists(f"{folder}/series"):
            series = series.join(self.spark.read.schema("series_id bigint").parquet(f"{folder}/series"), "series_id", "left_anti")
        series.write.mode("append").parquet(f"{folder}/series")

    @staticmethod
    def _facts_of(name: str, types: Mapping[str, str], points: DataFrame) -> DataFrame:
        """Rows of series_id, time, __ns, tags, ingest_seq and typed fields; points of one series and instant become one row."""
        facts = points.select(_series_id(name), _time_of("time_ns").alias("time"), F.pmod("time_ns", F.lit(1000)).cast("smallint").alias("__ns"), "tags", "seq", *[_typed(F.col("fields")[f], k).alias(f) for f, k in types.items()])
        newest = [F.max_by(F.col(quoted(f)), F.when(F.col(quoted(f)).isNotNull(), F.col("seq"))).alias(f) for f in types]
        return facts.groupBy("series_id", "time", "__ns").agg(F.first("tags").alias("tags"), F.max("seq").alias("ingest_seq"), *newest)

    def select_into(self, q: Select, db: str | None = None, rp: str | None = None) -> int:
        """Runs a SELECT INTO: numbers are written as floats, null fields and rows without any are left out; returns the points written."""
        src = q.sources[0]
        if isinstance(src, Select) or src.regex is not None:
            raise QueryError("INTO reads one named measurement")
        dest = q.into
        frames = self.planner(ordered=False).plan(replace(q, sources=q.sources[:1]), db, rp)
        total = 0
        for f in frames:
            total += self.write_points(_as_points(f, dest.name), db=dest.db or db, rp=dest.rp or rp, guard=False)
        return total

    # Export and import

    def export(self, db: str, folder: str, rp: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> None:
        """Line protocol of every measurement, gzipped, in a folder for each policy and measurement, with the DDL beside it."""
        d = self.catalog.database(db)
        ddl = [f'CREATE DATABASE "{db}"']
        bounds = Bounds(None if start_ns is None else -(-start_ns // 1000), None if end_ns is None else end_ns // 1000)
        for policy_name, p in sorted(d["policies"].items()):
            if rp is not None and policy_name != rp:
                continue
            ddl.append(f'CREATE RETENTION POLICY "{policy_name}" ON "{db}" DURATION {duration_text(p["duration"]) if p["duration"] else "INF"} REPLICATION {p["replication"]}' + (" DEFAULT" if policy_name == d["default"] else ""))
            for i, name in enumerate(self._names(db, policy_name)):
                t = self._table(db, policy_name, name)
                if t is None:
                    continue
                columns = [t.schema.tag_column(x) for x in t.schema.tags]
                rows = t.rows(list(t.schema.fields), columns, Early(), bounds)
                if bounds.lo is not None or bounds.hi is not None:
                    us = F.unix_micros(F.col("time").cast("timestamp"))
                    rows = rows.where((us >= (bounds.lo if bounds.lo is not None else -(1 << 62))) & (us <= (bounds.hi if bounds.hi is not None else 1 << 62)))
                kinds = {f: _kind(k) for f, k in t.schema.fields.items()}
                renamed = rows.select("time", *[F.col(quoted(c)).alias(f"t:{x}") for c, x in zip(columns, t.schema.tags, strict=True)], *[F.col(quoted(f)).alias(f"f:{f}") for f in kinds])
                _encoded(renamed, name, list(t.schema.tags), kinds).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/data/{policy_name}/{i:06d}")
        self.files.write(f"{folder}/ddl.txt", "\n".join(["# DDL", *ddl, "# DML", f"# CONTEXT-DATABASE: {db}"]) + "\n")

    def import_(self, folder: str) -> int:
        """Replays an export; points of unlimited number, read by the executors."""
        text = self.files.read(f"{folder}/ddl.txt")
        db = re.search(r"# CONTEXT-DATABASE: (.*)", text)[1].strip()
        for line in text.split("\n"):
            if line and not line.startswith("#"):
                s = parse_one(line)
                if s.kind == "create retention policy" and s.get("name") in self.catalog.database(s.get("db"))["policies"]:
                    continue
                self._statement(s, db, None)
        total = 0
        for rp in self.files.list(f"{folder}/data"):
            for part in self.files.list(f"{folder}/data/{rp}"):
                points = line_protocol.parse_lines(self.spark.read.text(f"{folder}/data/{rp}/{part}"), "ns", self.now())
                total += self.write_points(points, db=db, rp=rp, guard=False)
        return total

    def backup(self, folder: str) -> None:
        """Copies the root; restore by pointing an engine at the copy."""
        self.catalog.save()
        self.files.copy(self.root, folder)

    # Continuous queries

    def run_continuous_queries(self, now: int | None = None) -> list[tuple[str, int, int, int]]:
        """Runs what is due: (name, window start, window end, points written)."""
        now = self.now() if now is None else now
        out = []
        for db, d in self.catalog.databases.items():
            for name, cq in d["cqs"].items():
                q = parse_one(cq["text"])
                plan = Schedule.of(q, cq["every"], cq["span"])
                if plan.due(now, cq["last_run"], cq["created"]):
                    start, end = plan.window(now)
                    n = self.select_into(cq_select(q, start, end, strip_fill=plan.basic), db)
                    cq["last_run"] = now
                    self.catalog.save()
                    out.append((name, start, end, n))
        return out

    def run_schedule(self, interval: float = 10.0, stop: threading.Event | None = None, rounds: int | None = None) -> None:
        """Runs due continuous queries and retention every `interval` seconds, until `stop` is set or after so many rounds.

        What fails is logged and tried again in the next round.
        """
        stop = stop or threading.Event()
        done = 0
        while not stop.is_set() and (rounds is None or done < rounds):
            for work in (self.run_continuous_queries, self.enforce_retention):
                try:
                    work()
                except Exception:
                    logging.getLogger(__name__).exception("a round of the schedule failed")
            done += 1
            if rounds is None or done < rounds:
                stop.wait(interval)

    # Materialized views

    def create_view(self, db: str, name: str, text: str, backfill: bool) -> None:
        q = parse_one(text)
        columns = rollup.definition(q)
        src = q.sources[0]
        rp, dest_rp = self.catalog.rp(src.db or db, src.rp), self.catalog.rp(db, q.into.rp)
        if name in self.catalog.database(db)["mvs"]:
            raise QueryError(f"materialized view exists: {name}")
        table = self._table(src.db or db, rp, src.name)
        if table is None:
            raise QueryError(f"measurement not found: {src.name}")
        tags = self.planner().dimensions(q, table.schema)
        fields, rollups, means = rollup.stored_fields(columns, {f: _kind(k) for f, k in table.schema.fields.items()})
        meta = new_measurement() | {"fields": fields, "tags": sorted(tags), "rollups": rollups, "mean_fields": means, "versions": [{"folder": "v0", "types": dict(fields)}], "shared": "*"}
        self.catalog.put_measurement(db, dest_rp, q.into.name, meta)
        self.catalog.database(db)["mvs"][name] = {"text": text, "source": src.name, "source_db": src.db or db, "source_rp": rp, "dest": q.into.name, "rp": dest_rp}
        if backfill:
            rows = self.planner().scan(replace(q, into=None), table, list(q.fields), tags, Bounds())
            self._append_partials(db, dest_rp, q.into.name, rollup.partials(self._renamed(rows, table.schema, tags), q, columns, tags), tags, self.catalog.next_batch())
        self.catalog.save()

    @staticmethod
    def _renamed(rows: DataFrame, schema: Schema, tags: list[str]) -> DataFrame:
        return rows.withColumnsRenamed({schema.tag_column(t): t for t in tags if schema.tag_column(t) != t})

    def _append_partials(self, db: str, rp: str, name: str, partial: DataFrame, tags: list[str], batch: int, again: bool = False) -> None:
        """Appends a batch of partial rows; with again, one that is there already is left alone, so a retry doesn't count twice."""
        meta = self.catalog.measurement(db, rp, name)
        folder = self._folder(db, rp, name)
        tag_map = F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.col(quoted(t)) for t in tags])) if tags else F.create_map().cast("map<string,string>")
        filled = F.map_filter(tag_map, lambda _, v: v != "")
        extra = [c for c in partial.columns if c.startswith(("__first_at_", "__last_at_"))]
        rows = partial.select(filled.alias("tags"), "time", *[F.col(quoted(f)).cast(SPARK_TYPES[k]).alias(f) for f, k in meta["fields"].items()], *[F.col(quoted(e)) for e in extra])
        rows = rows.withColumn("series_id", _series_id(name))
        self._append_series(folder, rows.select("series_id", "tags"))
        facts = rows.drop("tags").withColumn("__ns", F.lit(0).cast("smallint")).withColumn("ingest_seq", F.lit(batch).cast("long")).withColumn("date", F.col("time").cast("date"))
        path = f"{folder}/facts/{meta['versions'][-1]['folder']}"
        if again and self._has_batch(path, facts, batch):
            return
        if meta["shared"] != "*":  # partials of a bucket come with every batch
            self._announce(db, rp, name, meta, None)
            self.catalog.save()
        facts.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)

    def _has_batch(self, folder: str, facts: DataFrame, batch: int) -> bool:
        """Whether rows of a batch are in the dates that it has rows for."""
        if not self.files.exists(folder):
            return False
        days = facts.agg(F.min("date"), F.max("date")).first()
        if days[0] is None:
            return True
        held = self.spark.read.schema("ingest_seq bigint, date date").parquet(folder)
        return bool(held.where(F.col("date").between(*days) & (F.col("ingest_seq") == batch)).head(1))

    def view_stream(self, db: str, name: str, source: DataFrame, checkpoint: str, *, time: str, once: bool = True):
        """Feeds a materialized view from a stream of rows (time, tags, fields): partials of every micro-batch are appended, once however often it runs."""
        mv = self.catalog.database(db)["mvs"][name]
        q = parse_one(mv["text"])
        columns = rollup.definition(q)
        tags = self.catalog.measurement(db, mv["rp"], mv["dest"])["tags"]

        def batch(df: DataFrame, number: int) -> None:
            # micro-batches are numbered anew in each stream, and the catalog gives each stream a number of its own
            stream = self.catalog.stream(self._stream_id(checkpoint))["no"]
            self.catalog.save()
            rows = df.withColumnRenamed(time, "time").withColumn("time", F.col("time").cast("timestamp_ntz"))
            rows = rows.withColumns({t: F.coalesce(F.col(quoted(t)).cast("string"), F.lit("")) for t in tags})
            if q.where is not None:
                kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in ("time", *tags)}
                rows = rows.where(Conditions(Schema(kinds, tuple(tags)), self.now()).column(q.where))
            self._append_partials(db, mv["rp"], mv["dest"], rollup.partials(rows, q, columns, tags), tags, -1 - (stream << 40 | number), again=True)

        return rollup.run_stream(source, batch, checkpoint, once=once)

    def _refresh_views(self, db: str, rp: str, name: str, meta: dict, points: DataFrame, batch: int, again: bool) -> None:
        """Adds a batch of a measurement's points, coalesced within itself, to the views that read it."""
        for home, d in self.catalog.databases.items():
            for mv in d["mvs"].values():
                if (mv["source_db"], mv["source_rp"], mv["source"]) != (db, rp, name):
                    continue
                q = parse_one(mv["text"])
                columns = rollup.definition(q)
                tags = self.catalog.measurement(home, mv["rp"], mv["dest"])["tags"]
                fields = list(meta["fields"])
                rows = self._facts_of(name, meta["fields"], points).withColumns({t: F.coalesce(F.col("tags")[t], F.lit("")) for t in meta["tags"] if t not in fields})
                if q.where is not None:
                    kinds = {x.name: x.dataType for x in rows.schema.fields if x.name in fields}
                    rows = rows.where(Conditions(Schema(kinds, tuple(t for t in meta["tags"] if t not in fields)), self.now()).column(q.where))
                self._append_partials(home, mv["rp"], mv["dest"], rollup.partials(rows, q, columns, tags), tags, batch, again)

    # Retention

    def enforce_retention(self, now: int | None = None) -> int:
        """Drops what policies have outlived: the files of whole days, and by a bound on time what is left of the day of the cut; returns measurements touched.

        The bound is in the catalog before files go. Points written later but before it stay hidden; compact() removes what it hides.
        """
        now = self.now() if now is None else now
        touched = []
        for db, d in self.catalog.databases.items():
            for rp, p in d["policies"].items():
                if not p["duration"]:
                    continue
                cut_us = (now - p["duration"]) // 1000
                day = (datetime(1970, 1, 1) + timedelta(microseconds=cut_us)).date().isoformat()
                for name in self.catalog.measurements(db, rp):
                    meta = self.catalog.measurement(db, rp, name)
                    folder = f"{self._folder(db, rp, name)}/facts"
                    held = [f"{folder}/{v['folder']}/{x}" for v in meta["versions"] for x in self.files.list(f"{folder}/{v['folder']}") if x.startswith("date=") and x[5:] <= day]
                    if held:
                        meta["not_before"] = max(cut_us, meta["not_before"] or cut_us)
                        meta["shared"] = meta["shared"] if meta["shared"] == "*" else [x for x in meta["shared"] if x >= day]
                        touched.append([x for x in held if not x.endswith(f"date={day}")])
        if touched:
            self.catalog.save()
        for folders in touched:
            for x in folders:
                self.files.delete(x)
        return len(touched)

    def compact(self, measurement: str, *, db: str | None = None, rp: str | None = None) -> None:
        """Rewrites a measurement's files: one row for each series and instant, in the newest types, sorted by series within its date.

        Nothing changes for queries, but that they need not coalesce. The new files are a version of their own, and take the
        place of the others when the catalog says so; what a compaction that was broken off left is in nobody's way.
        """
        db = db or self.default_db
        rp = self.catalog.rp(db, rp)
        meta = self.catalog.measurement(db, rp, measurement)
        if meta is None:
            raise QueryError(f"measurement not found: {measurement}")
        table = self._table(db, rp, measurement)
        folder, fields = f"{self._folder(db, rp, measurement)}/facts", list(meta["fields"])
        old = [v["folder"] for v in meta["versions"]]
        new = f"v{meta['next_version']}"
        self.files.delete(f"{folder}/{new}")
        rows = table.merged(fields)
        rows.withColumn("date", F.col("time").cast("date")).hint("rebalance", "date").sortWithinPartitions("date", "series_id", "time").write.partitionBy("date").parquet(f"{folder}/{new}")
        meta["versions"] = []
        add_version(meta, meta["fields"])
        meta |= {"shared": [], "not_before": None}
        self.catalog.save()
        for v in old:
            self.files.delete(f"{folder}/{v}")

    # Statements

    def _statement(self, s: Statement, db: str | None, rp: str | None) -> list[dict]:
        out = getattr(self, "_do_" + s.kind.replace(" ", "_"))(s, s.get("db") or db or self.default_db, rp)
        if not s.kind.startswith("show"):
            self.catalog.save()
        return out or []

    def _of(self, s: Statement, db: str, rp: str | None) -> list:
        """Tables of the statement's FROM, or all of the policy."""
        source = s.get("source") or Measurement(regex=".*")
        return self._lookup(source, source.db or db, source.rp or rp)

    @staticmethod
    def _sliced(s: Statement, rows: list) -> list:
        first = s.get("offset") or 0
        return rows[first:] if s.get("limit") is None else rows[first : first + s.get("limit")]

    def _do_show_databases(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        return [result.table("databases", ["name"], [[n] for n in sorted(self.catalog.databases)])]

    def _do_show_measurements(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        names = [t.name for t in self._of(s, db, rp)]
        if s.get("match"):
            op, x = s.get("match")
            names = [n for n in names if (n == x) == (op == "=")] if op in ("=", "!=") else [n for n in names if bool(re.search(x, n)) == (op == "=~")]
        if s.get("where") is not None:
            names = [t.name for t in self._of(s, db, rp) if t.name in names and self._series(t, s).limit(1).count()]
        rows = [[n] for n in self._sliced(s, names)]
        return [result.table("measurements", ["name"], rows)] if rows else []

    def _do_show_tag_keys(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        out = [(t.name, self._sliced(s, [[k] for k in sorted(t.schema.tags)])) for t in self._of(s, db, rp)]
        return [result.table(n, ["tagKey"], rows) for n, rows in out if rows]

    def _do_show_field_keys(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        out = [(t.name, self._sliced(s, [[f, _kind(k)] for f, k in sorted(t.schema.fields.items())])) for t in self._of(s, db, rp)]
        return [result.table(n, ["fieldKey", "fieldType"], rows) for n, rows in out if rows]

    def _series(self, t, s: Statement) -> DataFrame:
        """Distinct tag sets of a table, those that WHERE leaves."""
        columns = [t.schema.tag_column(x) for x in t.schema.tags]
        early = Early(on_time=None if s.get("where") is None else Conditions(t.schema, self.now()).column(s.get("where")))
        if isinstance(t, StoredTable) and early.on_time is None and not t.meta["tombstones"] and t.meta["not_before"] is None:
            return t.series().select(*[F.col(quoted(c)) for c in columns]).distinct() if columns else self.spark.range(1).select()
        return t.rows([], columns, early, Bounds()).select(*[F.col(quoted(c)) for c in columns]).distinct()

    def _do_show_tag_values(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        out = []
        for t in self._of(s, db, rp):
            keys = sorted(t.schema.tags)
            if s.get("match"):
                op, x = s.get("match")
                if op == "in":
                    keys = [k for k in keys if k in x]
                elif op in ("=", "!="):
                    keys = [k for k in keys if x == "*" or (k == x) == (op == "=")]
                else:
                    keys = [k for k in keys if bool(re.search(x, k)) == (op == "=~")]
            if not keys:
                continue
            pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(quoted(t.schema.tag_column(k))).alias("value")) for k in keys])).alias("p")
            rows = self._series(t, s).select(pairs).select("p.*").where("value <> ''").distinct().orderBy("key", "value")
            rows = rows.offset(s.get("offset")) if s.get("offset") else rows
            rows = rows if s.get("limit") is None else rows.limit(s.get("limit"))
            found = [[r["key"], r["value"]] for r in rows.toLocalIterator()]
            if found:
                out.append(result.table(t.name, ["key", "value"], found))
        return out

    def _do_show_series(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        out = None
        for i, t in enumerate(self._of(s, db, rp)):
            parts = [F.when(F.col(quoted(t.schema.tag_column(k))) != "", F.concat(F.lit(f",{k}="), F.col(quoted(t.schema.tag_column(k))))).otherwise("") for k in sorted(t.schema.tags)]
            keys = self._series(t, s).select(F.lit(i).alias("i"), F.concat(F.lit(t.name), *parts).alias("key")).distinct()
            out = keys if out is None else out.union(keys)
        if out is None:
            return []
        # a limit reaches Spark, so no more comes to the driver than is shown
        out = out.orderBy("i", "key")
        out = out.offset(s.get("offset")) if s.get("offset") else out
        out = out if s.get("limit") is None else out.limit(s.get("limit"))
        rows = [[r["key"]] for r in out.toLocalIterator()]
        return [result.table("series", ["key"], rows)] if rows else []

    def _do_show_retention_policies(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        return [result.table("", ["name", "duration", "shardGroupDuration", "replicaN", "default"], self.catalog.policy_rows(db))]

    def _do_show_continuous_queries(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        return [result.table(n, ["name", "query"], [[k, _cq_text(n, k, c)] for k, c in sorted(d["cqs"].items())]) for n, d in sorted(self.catalog.databases.items())]

    def _do_show_materialized_views(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        rows = [[k, n, v["text"], v["source"], v["dest"]] for n, d in sorted(self.catalog.databases.items()) if s.get("db") in (None, n) for k, v in sorted(d["mvs"].items())]
        return [result.table("materialized_views", ["name", "database", "query", "source", "dest"], rows)]

    def _do_show_users(self, s: Statement, db: str, rp: str | None) -> list[dict]:
        return [result.table("", ["user", "admin"], [])]

    def _do_create_database(self, s: Statement, db: str, rp: str | None) -> None:
        how = policy(s.get("duration"), s.get("replication") or 1, s.get("shard"))
        self.catalog.create_database(db, s.get("name") or "autogen", how)

    def _do_drop_database(self, s: Statement, db: str, rp: str | None) -> None:
        self.catalog.databases.pop(db, None)
        for key in [k for k in self.frames if k[0] == db]:
            del self.frames[key]
        if self.root:
            self.files.delete(self._folder(db, "x", "x").rsplit("/", 2)[0])

    def _do_create_retention_policy(self, s: Statement, db: str, rp: str | None) -> None:
        d = self.catalog.database(db)
        if s.get("name") in d["policies"]:
            raise QueryError(f"retention policy exists: {s.get('name')}")
        d["policies"][s.get("name")] = policy(s.get("duration"), s.get("replication"), s.get("shard"))
        if s.get("default"):
            d["default"] = s.get("name")

    def _do_alter_retention_policy(self, s: Statement, db: str, rp: str | None) -> None:
        d = self.catalog.database(db)
        if s.get("name") not in d["policies"]:
            raise QueryError(f"retention policy not found: {s.get('name')}")
        p = d["policies"][s.get("name")]
        duration = s.get("duration") if s.get("has_duration") else p["duration"]
        d["policies"][s.get("name")] = policy(duration, s.get("replication") or p["replication"], s.get("shard") or (None if s.get("has_duration") else p["shard"]))
        if s.get("default"):
            d["default"] = s.get("name")

    def _do_drop_retention_policy(self, s: Statement, db: str, rp: str | None) -> None:
        d = self.catalog.database(db)
        for name in self._names(db, s.get("name")) if s.get("name") in d["policies"] else []:
            self._drop(db, s.get("name"), name)
        d["policies"].pop(s.get("name"), None)

    def _drop(self, db: str, rp: str, name: str) -> None:
        for view, v in list(self.catalog.database(db)["mvs"].items()):
            if (v["source_db"], v["source_rp"], v["source"]) == (db, rp, name):
                self._drop_view(db, view)
        self.frames.pop((db, rp, name), None)
        self.catalog.drop_measurement(db, rp, name)
        if self.root:
            self.files.delete(self._folder(db, rp, name))

    def _drop_view(self, db: str, name: str) -> None:
        v = self.catalog.database(db)["mvs"].pop(name, None)
        if v is None:
            raise QueryError(f"materialized view not found: {name}")
        self._drop(db, v["rp"], v["dest"])

    def _do_drop_measurement(self, s: Statement, db: str, rp: str | None) -> None:
        m = s.get("source")
        db = m.db or db
        self._drop(db, self.catalog.rp(db, m.rp or rp), m.name)

    def _tombstone(self, db: str, rp: str, name: str, text: str) -> None:
        meta = self.catalog.measurement(db, rp, name)
        if meta is None:
            meta = new_measurement()
            self.catalog.put_measurement(db, rp, name, meta)
        meta["tombstones"].append(text)

    def _do_delete(self, s: Statement, db: str, rp: str | None) -> None:
        for t in self._of(s, db, rp):
            m = s.get("source")
            self._tombstone(m.db or db, self.catalog.rp(m.db or db, m.rp or rp), t.name, "*" if s.get("where") is None else _text(s.get("where")))

    def _do_drop_series(self, s: Statement, db: str, rp: str | None) -> None:
        m = s.get("source") or Measurement()
        for t in self._of(s, db, rp):
            self._tombstone(m.db or db, self.catalog.rp(m.db or db, m.rp or rp), t.name, "*" if s.get("where") is None else _text(s.get("where")))

    def _do_create_continuous_query(self, s: Statement, db: str, rp: str | None) -> None:
        Schedule.of(s.get("select"), s.get("resample_every"), s.get("resample_for"))
        self.catalog.database(db)["cqs"][s.get("name")] = {"text": s.get("text"), "every": s.get("resample_every"), "span": s.get("resample_for"), "created": self.now(), "last_run": None}

    def _do_drop_continuous_query(self, s: Statement, db: str, rp: str | None) -> None:
        self.catalog.database(db)["cqs"].pop(s.get("name"), None)

    def _do_create_materialized_view(self, s: Statement, db: str, rp: str | None) -> None:
        self.create_view(db, s.get("name"), s.get("text"), s.get("backfill"))

    def _do_drop_materialized_view(self, s: Statement, db: str, rp: str | None) -> None:
        self._drop_view(db, s.get("name"))

    def _no_users(self, s: Statement, db: str, rp: str | None) -> None:
        raise QueryError("users are those of the cluster; this engine keeps none")

    _do_create_user = _do_drop_user = _do_set_password = _do_grant = _do_revoke = _no_users


def _series_id(name: str) -> Column:
    """Identity of a series: a hash of its measurement and sorted tags."""
    return F.xxhash64(F.lit(name), F.to_json(F.array_sort(F.map_entries("tags")))).alias("series_id")


def _time_of(ns: str) -> Column:
    """The microsecond of nanoseconds since 1970, rounded down, as a timestamp without zone."""
    return F.timestamp_micros(F.expr(f"({ns} - pmod({ns}, 1000)) div 1000")).cast("timestamp_ntz")


def _kind(t: object) -> str:
    """The language's name of a Spark type."""
    if isinstance(t, BooleanType):
        return "boolean"
    if isinstance(t, IntegralType):
        return "integer"
    if isinstance(t, DecimalType) and t.scale == 0:
        return "unsigned"
    return "float" if isinstance(t, (FloatType, DoubleType, DecimalType)) else "string"


def _typed(text: Column, kind: str) -> Column:
    return text.cast(SPARK_TYPES[kind]) if kind != "string" else text


def _text(e: object) -> str:
    """A condition as text that parses to the same."""
    from tidemark.plans.ast import Binary, Dur, Ident, Instant, Lit, Not, Now, Regex

    if isinstance(e, Binary):
        return f"({_text(e.left)} {e.op} {_text(e.right)})"
    if isinstance(e, Not):
        return f"NOT ({_text(e.expr)})"
    if isinstance(e, Ident):
        name = '"' + e.name.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return name + (f"::{e.cast}" if e.cast else "")
    if isinstance(e, Dur):
        return f"{e.ns}ns"
    if isinstance(e, Instant):
        return f"'{e.text}'"
    if isinstance(e, Now):
        return "now()"
    if isinstance(e, Regex):
        return "/" + e.pattern.replace("/", "\\/") + "/"
    if isinstance(e, Lit) and isinstance(e.value, str):
        return "'" + e.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(e.value).lower() if isinstance(e.value, bool) else repr(e.value)


def _cq_text(db: str, name: str, cq: dict) -> str:
    resample = (f" EVERY {duration_text(cq['every'])}" if cq["every"] else "") + (f" FOR {duration_text(cq['span'])}" if cq["span"] else "")
    return f"CREATE CONTINUOUS QUERY {name} ON {db}" + (f" RESAMPLE{resample}" if resample else "") + f" BEGIN {cq['text']} END"


def _as_points(f: Frame, measurement: str) -> DataFrame:
    """Rows of a result as points: numbers become floats, null fields and empty tags are left out, rows without fields too."""
    kinds = {x.name: x.dataType for x in f.df.schema.fields}
    texts, types = [], []
    for c in f.columns:
        kind = {"integer": "float", "unsigned": "float"}.get(_kind(kinds[c]), _kind(kinds[c]))
        v = F.col(quoted(c))
        texts += [F.lit(c), v.cast("double").cast("string") if kind == "float" else v.cast("string")]
        types += [F.lit(c), F.when(v.isNotNull(), F.lit(kind))]
    some = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    tags = F.create_map(*[x for t in f.tags for x in (F.lit(t), F.col(quoted(t)))]) if f.tags else F.create_map().cast("map<string,string>")
    out = f.df.select(
        F.lit(measurement).alias("measurement"), F.map_filter(tags, lambda _, v: F.coalesce(v, F.lit("")) != "").alias("tags"), some(F.create_map(*texts)).alias("fields"),
        some(F.create_map(*types)).alias("types"), (F.unix_micros(F.col("time").cast("timestamp")) * 1000).alias("time_ns"), F.lit(None).cast("string").alias("error"),
    )
    return out.where(F.size("fields") > 0)


def _encoded(df: DataFrame, measurement: str, tags: list[str], kinds: Mapping[str, str]) -> DataFrame:
    """Line protocol of rows whose tag columns are t:name and field columns f:name."""
    plain = df.select("time", *[F.col(quoted(f"t:{t}")).alias(f"__t{i}") for i, t in enumerate(tags)], *[F.col(quoted(f"f:{f}")).alias(f"__f{i}") for i, f in enumerate(kinds)])
    return line_protocol.encode(plain, measurement, {t: f"__t{i}" for i, t in enumerate(tags)}, {f: (f"__f{i}", k) for i, (f, k) in enumerate(kinds.items())})

