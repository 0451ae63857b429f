"""Measurements as the planner reads them: registered frames, and facts with a tag dimension in storage."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, TimestampType, _parse_datatype_string

from tidemark.operators.aggregates import quoted
from tidemark.operators.coalesce import coalesced
from tidemark.plans.resolve import Bounds, Early, Schema, timestamp_literal
from tidemark.sources.catalog import SPARK_TYPES
from tidemark.sources.fsio import Files

#: Microseconds of the years 1 to 9999, the dates that there are.
_FIRST, _LAST = -62_135_596_800_000_000, 253_402_300_799_999_999


class FrameTable:
    """A DataFrame with a time column, tag columns (cast to strings, null is '') and field columns.

    With `order` (columns that tell which of two rows of a series and instant was written later) rows of one
    series and instant are coalesced, each field to its last non-null value; without, rows are taken as unique.
    """

    def __init__(self, name: str, df: DataFrame, time: str, tags: list[str], fields: list[str], order: list[str] | None = None, tombstones: Callable[[Schema], Column | None] | None = None):
        self.name, self.df, self.time, self.order, self.tombstones = name, df, time, order, tombstones
        kinds: dict[str, DataType] = {f.name: f.dataType for f in df.schema.fields}
        self.schema = Schema({f: kinds[f] for f in fields}, tuple(tags))
        self.zoned = isinstance(kinds[time], TimestampType)

    def rows(self, fields: list[str], tags: list[str], early: Early, bounds: Bounds) -> DataFrame:
        t = F.col(quoted(self.time))
        by_column = {self.schema.tag_column(x): x for x in self.schema.tags}
        keep = list(self.schema.tags) if self.order else [by_column[c] for c in tags]
        columns = {"time": t.cast("timestamp_ntz") if self.zoned else t}
        for x in keep:
            c = F.col(quoted(x))
            columns[self.schema.tag_column(x)] = F.coalesce(c if isinstance(self.df.schema[x].dataType, StringType) else c.cast("string"), F.lit(""))
        df = self.df
        for tag, value in bounds.equal:  # on the bare column, so that it reaches the scan
            if isinstance(df.schema[tag].dataType, StringType):
                df = df.where(F.col(quoted(tag)) == value)
        df = df.select(*[c.alias(n) for n, c in columns.items()], *[F.col(quoted(f)) for f in fields], *[F.col(quoted(o)).alias(f"__o{i}") for i, o in enumerate(self.order or [])])
        if (condition := early.all()) is not None:
            df = df.where(condition)
        gone = self.tombstones(self.schema) if self.tombstones else None
        if gone is not None:
            df = df.where(~F.coalesce(gone, F.lit(False)))
        if self.order:
            df = coalesced(df, ["time", *[self.schema.tag_column(x) for x in self.schema.tags]], fields, [F.col(f"__o{i}") for i in range(len(self.order))])
        return df.select("time", *[F.col(quoted(c)) for c in [*tags, *fields]])


class StoredTable:
    """A measurement in a folder: facts/v.../date=... (series_id, time, __ns, ingest_seq, fields) and series (series_id, tags).

    time has microseconds; __ns, the nanoseconds beyond them, keeps instants apart that differ in these only.
    """

    def __init__(self, spark: SparkSession, files: Files, name: str, folder: str, meta: dict, tombstones: Callable[[Schema], Column | None], broadcast_bytes: int = 64 << 20):
        self.spark, self.files, self.name, self.folder, self.meta, self.tombstones, self.broadcast_bytes = spark, files, name, folder, meta, tombstones, broadcast_bytes
        kinds = {f: _parse_datatype_string(SPARK_TYPES[k]) for f, k in sorted(meta["fields"].items())}
        self.schema = Schema(kinds, tuple(meta["tags"]), frozenset(meta["mean_fields"]))

    def series(self, columns: list[str] | None = None) -> DataFrame:
        """series_id and these (by default all) tag columns; an absent tag is the empty string."""
        raw = self.spark.read.schema("series_id bigint, tags map<string,string>").parquet(f"{self.folder}/series").dropDuplicates(["series_id"])
        by_column = {self.schema.tag_column(t): t for t in self.schema.tags}
        return raw.select("series_id", *[F.coalesce(F.col("tags")[by_column[c]], F.lit("")).alias(c) for c in (by_column if columns is None else columns)])

    def small(self) -> bool:
        """Whether the series can be broadcast: strings of compressed files take some times their bytes in memory."""
        return 4 * self.files.size(f"{self.folder}/series") <= self.broadcast_bytes

    def facts(self, fields: list[str], bounds: Bounds, dates: Column | None = None) -> DataFrame:
        """series_id, time, __ns, ingest_seq, these fields and the times of first and last partials, of the dates in bounds.

        Files are kept apart by version of the schema: a version ends when a field's type is widened, and older
        versions are cast. Fields that a version lacks are null.
        """
        rollups, kinds = self.meta["rollups"], self.meta["fields"]
        times = [f"__{rollups[f]}_at_{f}" for f in fields if rollups.get(f) in ("first", "last")]
        lows = [x for x in (bounds.lo, self.meta["not_before"]) if x is not None]
        out = None
        for version in self.meta["versions"]:
            path, types = f"{self.folder}/facts/{version['folder']}", version["types"]
            cols = ["series_id bigint", "time timestamp_ntz", "__ns smallint", "ingest_seq bigint", *[f"{quoted(f)} {SPARK_TYPES[types.get(f, kinds[f])]}" for f in fields], *[f"{quoted(t)} bigint" for t in times], "date date"]
            df = self.spark.read.schema(", ".join(cols)).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], ", ".join(cols))
            if lows:
                low = timestamp_literal(max(lows))
                df = df.where((F.col("date") >= low.cast("date")) & (F.col("time") >= low))
            if bounds.hi is not None:
                high = timestamp_literal(bounds.hi)
                df = df.where((F.col("date") <= high.cast("date")) & (F.col("time") <= high))
            if dates is not None:
                df = df.where(dates)
            df = df.select("series_id", "time", "__ns", "ingest_seq", *[F.col(quoted(f)).cast(SPARK_TYPES[kinds[f]]).alias(f) for f in fields], *[F.col(quoted(t)) for t in times])
            out = df if out is None else out.union(df)
        return out

    def merged(self, fields: list[str]) -> DataFrame:
        """All facts as they are stored, but one row for each series and instant."""
        rollups = self.meta["rollups"]
        held = {f"__{rollups[f]}_at_{f}": F.min if rollups[f] == "first" else F.max for f in fields if rollups.get(f) in ("first", "last")}
        also = [F.max("ingest_seq").alias("ingest_seq"), *[how(quoted(c)).alias(c) for c, how in held.items()]]
        return coalesced(self.facts(fields, Bounds()), ["series_id", "time", "__ns"], fields, [F.col("ingest_seq")], rollups, also)

    def _shared_dates(self, bounds: Bounds) -> list[date]:
        day = lambda us: (datetime(1970, 1, 1) + timedelta(microseconds=us)).date()
        held = [date.fromisoformat(d) for d in self.meta["shared"]]
        return [d for d in held if (bounds.lo is None or d >= day(max(bounds.lo, _FIRST))) and (bounds.hi is None or d <= day(min(bounds.hi, _LAST)))]

    def rows(self, fields: list[str], tags: list[str], early: Early, bounds: Bounds) -> DataFrame:
        """Facts, one row for each series and instant, with tags.

        Dates that one write (or a compaction) has filled hold each series and instant once and are taken as they are: they are
        neither grouped nor shuffled. Only the dates that several writes share are coalesced. Conditions on tags narrow
        the series, a small table, before the facts are joined with it; a series has one set of tags, so all conditions on time and tags come before coalescing.
        """
        gone = self.tombstones(self.schema)
        on_series, on_time = (early.on_series, early.on_time) if self.schema.tags else (None, early.all())
        names = [self.schema.tag_column(t) for t in self.schema.tags] if gone is not None else tags
        dim = self.series(names) if names else None
        if dim is not None and on_series is not None:
            dim = dim.where(on_series)
        narrow = dim is not None and on_series is not None
        small = dim is not None and self.small()
        hinted = F.broadcast if small else (lambda x: x)

        def tagged(x: DataFrame, columns: list[str]) -> DataFrame:
            if dim is None or not (columns or narrow):
                return x
            x = x.join(hinted(dim.select("series_id", *[F.col(quoted(c)) for c in columns])), "series_id", "inner" if narrow else "left")
            return x if narrow else x.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit("")) for c in columns})

        def left(x: DataFrame) -> DataFrame:
            if dim is None and on_series is not None:  # a tag that the measurement lacks
                x = x.where(on_series)
            if on_time is not None:
                x = x.where(on_time)
            return x if gone is None else x.where(~F.coalesce(gone, F.lit(False)))

        want = ["time", *[F.col(quoted(c)) for c in [*tags, *fields]]]
        everything = self.meta["shared"] == "*"
        shared = [] if everything else self._shared_dates(bounds)
        parts = []
        if not everything:
            once = self.facts(fields, bounds, ~F.col("date").isin(shared) if shared else None)
            parts.append(left(tagged(once, names)).select(*want))
        if everything or shared:
            several = self.facts(fields, bounds, None if everything else F.col("date").isin(shared))
            before = several.columns
            if gone is not None or on_time is not None:
                several = left(tagged(several, names)).select(*[F.col(quoted(c)) for c in before])
            elif narrow:
                several = several.join(hinted(dim.select("series_id")), "series_id", "left_semi")
            else:
                several = left(several)
            several = coalesced(several, ["series_id", "time", "__ns"], fields, [F.col("ingest_seq")], self.meta["rollups"])
            parts.append(tagged(several, tags).select(*want))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
