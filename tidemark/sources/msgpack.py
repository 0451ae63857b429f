"""MessagePack bodies: arrays of points, and columnar batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.line_protocol import POINTS, LineError, columnar_points, record_batch

COLUMNAR = "measurement string, tags map<string,string>, field string, values array<double>, timestamps array<bigint>"
# The format's bytes for numbers of a fixed width (struct codes), and for lengths of 1, 2 and 4 bytes.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
LENGTHS = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "array"), 0xDD: (">I", "array"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}


class Decoder:
    """Decodes one value after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) != n:
            raise LineError("the body ends within a value")
        self.at += n
        return part

    def _unpack(self, code: str) -> object:
        return struct.unpack(code, self._take(struct.calcsize(code)))[0]

    def value(self) -> object:
        b = self._take(1)[0]
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return self._sized("map", b & 0x0F)
        if b < 0xA0:
            return self._sized("array", b & 0x0F)
        if b < 0xC0:
            return self._sized("str", b & 0x1F)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in NUMBERS:
            return self._unpack(NUMBERS[b])
        if b in LENGTHS:
            code, kind = LENGTHS[b]
            return self._sized(kind, self._unpack(code))
        raise LineError(f"unknown type byte {b:#x}")

    def _sized(self, kind: str, n: int) -> object:
        if kind == "str":
            return self._take(n).decode()
        if kind == "bin":
            return self._take(n)
        if kind == "array":
            return [self.value() for _ in range(n)]
        return {self.value(): self.value() for _ in range(n)}


def decode(data: bytes) -> object:
    d = Decoder(data)
    out = d.value()
    if d.at != len(data):
        raise LineError("bytes follow the value")
    return out


def typed(v: object) -> tuple[str, str]:
    """(type, text) of a field's Python value."""
    if isinstance(v, bool):
        return "boolean", str(v).lower()
    if isinstance(v, int):
        return ("integer" if v < 1 << 63 else "unsigned"), str(v)
    if isinstance(v, float):
        return "float", repr(v)
    return "string", v.decode() if isinstance(v, bytes) else str(v)


def point(p: Mapping, now_ns: int) -> tuple:
    """A point as POINTS has it; raises for one without measurement or fields."""
    if not isinstance(p, Mapping) or not p.get("measurement") or not p.get("fields"):
        raise LineError("a point has a measurement and fields")
    kinds = {str(k): typed(v) for k, v in p["fields"].items() if v is not None}
    tags = {str(k): str(v) for k, v in (p.get("tags") or {}).items() if v not in (None, "")}
    at = p.get("timestamp")
    return p["measurement"], tags, {k: v[1] for k, v in kinds.items()}, {k: v[0] for k, v in kinds.items()}, now_ns if at is None else int(at), None


def parse_bodies(bodies: DataFrame, now_ns: int) -> DataFrame:
    """Points of a frame with a binary column `content`, an array of points each. A body that can't be decoded is an error as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                try:
                    body = decode(raw)
                    yield record_batch([point(p, now_ns) for p in (body if isinstance(body, list) else [body])])
                except (LineError, TypeError, ValueError) as e:
                    yield record_batch([(None, None, None, None, None, f"invalid body: {e}"[:500])])

    return bodies.select("content").mapInArrow(run, POINTS)


def parse_columnar(bodies: DataFrame, now_ns: int) -> DataFrame:
    """Points of columnar bodies: {measurement, tags, field, values, timestamps}, or an array of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kv = pa.map_(pa.string(), pa.string())
        types = [pa.string(), kv, pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in COLUMNAR.split(", ")]
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                body = decode(raw)
                rows = [(b["measurement"], list((b.get("tags") or {}).items()), b["field"], [float(v) for v in b["values"]], b.get("timestamps")) for b in (body if isinstance(body, list) else [body])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return columnar_points(bodies.select("content").mapInArrow(run, COLUMNAR).where(F.col("measurement").isNotNull()), now_ns)
