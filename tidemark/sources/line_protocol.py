"""Line protocol: measurement,tag=v field=1i,other="text" timestamp."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durations import PRECISIONS, scaled

#: Columns of parsed points. Field values are kept as text beside their type's name; seq is the order of writing.
POINTS = "measurement string, tags map<string,string>, fields map<string,string>, types map<string,string>, time_ns bigint, error string"
_INT = re.compile(r"[+-]?\d+$")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
_TRUE, _FALSE = {"t", "T", "true", "True", "TRUE"}, {"f", "F", "false", "False", "FALSE"}


class LineError(ValueError):
    """A line can't be parsed."""


def _split(text: str, sep: str, quotes: bool = False) -> list[str]:
    """Parts at separators that no backslash (and, if asked, no double quotes) protects; escapes stay."""
    out, part, i, inside = [], [], 0, False
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            part.append(text[i : i + 2])
            i += 2
            continue
        if quotes and c == '"':
            inside = not inside
        if c == sep and not inside:
            out.append("".join(part))
            part = []
        else:
            part.append(c)
        i += 1
    if inside:
        raise LineError("unterminated string")
    return [*out, "".join(part)]


def _plain(text: str) -> str:
    """Without the escapes of commas, equals signs and spaces."""
    return re.sub(r"\\([,= ])", r"\1", text)


def field_value(raw: str) -> tuple[str, str]:
    """(type, text) of a field's value."""
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        return "string", re.sub(r'\\(["\\])', r"\1", raw[1:-1])
    if raw in _TRUE or raw in _FALSE:
        return "boolean", str(raw in _TRUE).lower()
    if raw[-1:] == "i" and _INT.match(raw[:-1]):
        v = int(raw[:-1])
        if not -(1 << 63) <= v < 1 << 63:
            raise LineError(f"integer out of range: {raw}")
        return "integer", str(v)
    if raw[-1:] == "u" and _INT.match(raw[:-1]):
        v = int(raw[:-1])
        if not 0 <= v < 1 << 64:
            raise LineError(f"unsigned integer out of range: {raw}")
        return "unsigned", str(v)
    if _FLOAT.match(raw):
        return "float", repr(float(raw))
    raise LineError(f"invalid value: {raw!r}")


def parse_line(line: str, precision: str | None = None, now_ns: int = 0) -> tuple[str, dict[str, str], dict[str, str], dict[str, str], int] | None:
    """(measurement, tags, field texts, field types, ns) of a line; None for blank lines and comments. The last of equal keys counts."""
    line = line.strip("\r\n ")
    if not line or line.startswith("#"):
        return None
    parts = [p for p in _split(line, " ", quotes=True) if p != ""]
    if not 2 <= len(parts) <= 3:
        raise LineError("a line has a key, fields and at most a timestamp")
    key = _split(parts[0], ",")
    measurement = _plain(key[0])
    if not measurement:
        raise LineError("no measurement")
    tags = {}
    for item in key[1:]:
        k, *v = _split(item, "=")
        if len(v) != 1 or not k or not v[0]:
            raise LineError(f"invalid tag: {item!r}")
        tags[_plain(k)] = _plain(v[0])
    values, types = {}, {}
    for item in _split(parts[1], ",", quotes=True):
        k, *v = _split(item, "=", quotes=True)
        if not v or not k:
            raise LineError(f"invalid field: {item!r}")
        name = _plain(k)
        types[name], values[name] = field_value("=".join(v))
    if len(parts) == 3:
        if not _INT.match(parts[2]):
            raise LineError(f"invalid timestamp: {parts[2]!r}")
        ns = scaled(int(parts[2]), precision)
    else:
        ns = now_ns
    return measurement, tags, values, types, ns


def record_batch(points: list[tuple]) -> pa.RecordBatch:
    """Rows of POINTS."""
    kv = pa.map_(pa.string(), pa.string())
    types = [pa.string(), kv, kv, kv, pa.int64(), pa.string()]
    names = ["measurement", "tags", "fields", "types", "time_ns", "error"]
    return pa.RecordBatch.from_arrays([pa.array([list(p[i].items()) if isinstance(p[i], dict) else p[i] for p in points], t) for i, t in enumerate(types)], names=names)


# lines without escapes, quotes and repeated spaces: a key, fields that are numbers or booleans, and a timestamp of a size that holds
_NAME = r'[^ ,="\\\t\r\n]+'
_VALUE = r"(?:[+-]?[0-9]{1,18}i|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|" + "|".join(sorted(_TRUE | _FALSE)) + ")"
_SIMPLE = rf"^(?!#){_NAME}(?:,{_NAME}={_NAME})* {_NAME}={_VALUE}(?:,{_NAME}={_VALUE})*(?: [+-]?[0-9]{{1,18}})?$"


def _simple_points(lines: DataFrame, precision: str | None, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """(points, other lines): points of the simple lines whose keys differ."""
    parts = F.split("line", " ")
    item = lambda x, n: F.substring_index(x, "=", n)
    key, fields = F.split(F.get(parts, F.lit(0)), ","), F.split(F.get(parts, F.lit(1)), ",")
    held = lines.withColumn("simple", F.col("line").rlike(_SIMPLE)).withColumn("tag_items", F.when(F.col("simple"), F.slice(key, F.lit(2), F.size(key)))).withColumn("items", F.when(F.col("simple"), fields))
    differ = lambda items: F.size(F.array_distinct(F.transform(items, lambda x: item(x, 1)))) == F.size(items)
    kind = lambda x: F.when(x.endswith("i"), "integer").when(x.rlike("^[tTfF]"), "boolean").otherwise("float")
    text = lambda x: F.when(x.endswith("i"), F.rtrim(x, F.lit("i")).try_cast("bigint").cast("string")).when(x.rlike("^[tT]"), "true").when(x.rlike("^[fF]"), "false").otherwise(x)
    stamp = F.get(parts, F.lit(2))
    ns = F.when(stamp.isNull(), F.lit(now_ns).cast("long")).otherwise(F.try_multiply(stamp.try_cast("bigint"), F.lit(PRECISIONS.get(precision or "ns", 1)).cast("long")))
    whole = F.coalesce(F.col("simple") & differ(F.col("tag_items")) & differ(F.col("items")) & ns.isNotNull(), F.lit(False))
    of = lambda items, keys, values: F.map_from_arrays(F.transform(items, keys), F.transform(items, values))
    out = held.where(whole).select(
        F.get(key, F.lit(0)).alias("measurement"), of(F.col("tag_items"), lambda x: item(x, 1), lambda x: item(x, -1)).alias("tags"), of(F.col("items"), lambda x: item(x, 1), lambda x: text(item(x, -1))).alias("fields"),
        of(F.col("items"), lambda x: item(x, 1), lambda x: kind(item(x, -1))).alias("types"), ns.alias("time_ns"), F.lit(None).cast("string").alias("error"), "place",
    )
    return out, held.where(~whole).select("line", "place")


def parse_lines(lines: DataFrame, precision: str | None = None, now_ns: int = 0) -> DataFrame:
    """Points of a frame with a string column `value`, a line each; see POINTS, and place, the order of the lines. Lines that can't be parsed have an error only.

    Lines without escapes and strings, most of what there is, are parsed by Spark's own expressions; the
    others go to Python. Both branches read the lines, which costs less than passing all of them through Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, places = [], []
            for line, place in zip(batch.column("line").to_pylist(), batch.column("place").to_pylist(), strict=True):
                try:
                    p = parse_line(line, precision, now_ns)
                    if p is None:
                        continue
                    out.append((*p, None))
                except LineError as e:
                    out.append((None, None, None, None, None, f"{e}: {line}"))
                places.append(place)
            points = record_batch(out)
            yield pa.RecordBatch.from_arrays([*points.columns, pa.array(places, pa.int64())], names=[*points.schema.names, "place"])

    numbered = lines.select(F.btrim(F.col("value"), F.lit("\r\n ")).alias("line"), F.monotonically_increasing_id().alias("place"))
    numbered = numbered.where("line is not null and line <> '' and not startswith(line, '#')")
    simple, others = _simple_points(numbered, precision, now_ns)
    return simple.unionByName(others.mapInArrow(run, POINTS + ", place bigint"))


def columnar_points(batches: DataFrame, now_ns: int) -> DataFrame:
    """Points of columnar batches (measurement, tags, field, values, timestamps): one float field and a row for each value.

    Without timestamps the values get the time of writing. Arrays of unlike lengths are an error.
    """
    stamps = F.coalesce("timestamps", F.transform("values", lambda _: F.lit(now_ns).cast("long")))
    ok = F.size("values") == F.size(stamps)
    zipped = F.when(ok, F.arrays_zip(F.col("values").alias("v"), stamps.alias("t"))).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("t"))))
    flat = batches.select("measurement", "tags", "field", (~ok).alias("bad"), F.explode(zipped).alias("z"))
    one = lambda v: F.create_map(F.col("field"), v)
    return flat.select(
        F.when(~F.col("bad"), F.col("measurement")).alias("measurement"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        one(F.col("z.v").cast("string")).alias("fields"),
        one(F.lit("float")).alias("types"),
        F.col("z.t").alias("time_ns"),
        F.when(F.col("bad"), F.concat(F.lit("values and timestamps differ in length: "), "measurement")).alias("error"),
    )


def _escaped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"([{chars}])", r"\\$1")


def encode(df: DataFrame, measurement: str, tags: Mapping[str, str], fields: Mapping[str, tuple[str, str]], time: str = "time") -> DataFrame:
    """Lines (column value) of rows: tags by name to column, fields by name to (column, type).

    Empty tags and null fields are left out, rows without fields too.
    """
    name = re.sub(r"([, ])", r"\\\1", measurement)
    literal = lambda s: re.sub(r"([,= ])", r"\\\1", s)
    pairs = []
    for t, column in sorted(tags.items()):
        c = F.coalesce(F.col(f"`{column}`"), F.lit(""))
        pairs.append(F.when(c != "", F.concat(F.lit(f",{literal(t)}="), _escaped(c, ",= "))).otherwise(""))
    texts = []
    for f, (column, kind) in sorted(fields.items()):
        c = F.col(f"`{column}`")
        if kind == "string":
            v = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\\\$1"), F.lit('"'))
        else:
            v = F.concat(c.cast("string"), F.lit({"integer": "i", "unsigned": "u"}.get(kind, "")))
        texts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{literal(f)}="), v)))
    body = F.concat_ws(",", *texts)
    ns = (F.unix_micros(F.col(time).cast("timestamp")) * 1000).cast("string")
    return df.select(F.concat(F.lit(name), *pairs, F.lit(" "), body, F.lit(" "), ns).alias("value"), body.alias("b")).where("b <> ''").select("value")
