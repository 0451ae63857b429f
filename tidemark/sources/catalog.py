"""Databases, retention policies, measurements' schemas, tombstones and rollup definitions, in one JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping

from tidemark.functions.durations import UNITS, format_duration
from tidemark.plans.ast import QueryError
from tidemark.sources.fsio import Files

HOUR, DAY = UNITS["h"], UNITS["d"]
#: Types of fields and the Spark types that hold them.
SPARK_TYPES = {"float": "double", "integer": "bigint", "unsigned": "decimal(20,0)", "string": "string", "boolean": "boolean"}


class CatalogConflict(QueryError):
    """Another engine has changed the catalog since this one read it."""


class FieldTypeConflict(QueryError):
    """A write gives a field a type that its present one can't be widened to."""


def widen(a: str | None, b: str) -> str:
    """The type that holds both: floats take integers, unsigned takes signed; nothing else mixes."""
    if a is None or a == b:
        return b
    if {a, b} == {"float", "integer"}:
        return "float"
    if {a, b} == {"integer", "unsigned"}:
        return "unsigned"
    raise FieldTypeConflict(f"field type conflict: {a} and {b}")


def shard_duration(duration_ns: int | None) -> int:
    """Length of a policy's shard groups, by its own length."""
    if duration_ns and duration_ns < 2 * DAY:
        return HOUR
    return DAY if duration_ns and duration_ns <= 180 * DAY else 7 * DAY


def policy(duration_ns: int | None, replication: int = 1, shard: int | None = None) -> dict:
    duration_ns = duration_ns or None
    if duration_ns is not None and duration_ns < HOUR:
        raise QueryError("a retention policy lasts at least 1h")
    return {"duration": duration_ns, "replication": replication, "shard": shard or shard_duration(duration_ns)}


class Catalog:
    """State of an engine. With a path it is read at the start and written by save(); without, it lives in memory.

    Each save raises the revision, and is refused if the stored one isn't that which was read: of two engines on
    one root the second to write learns of the first and can reload().
    """

    def __init__(self, files: Files | None = None, path: str | None = None):
        self.files, self.path = files, path
        self.state: dict = {}
        self.reload()

    def reload(self) -> None:
        self.state = {"databases": {}, "users": {}, "batch": 0, "revision": 0, "streams": {}}
        if self.path:
            self.files.recover(self.path)
            if self.files.exists(self.path):
                self.state |= json.loads(self.files.read(self.path))

    def save(self) -> None:
        if self.path:
            stored = json.loads(self.files.read(self.path))["revision"] if self.files.exists(self.path) else 0
            if stored != self.state["revision"]:
                raise CatalogConflict(f"the catalog is at revision {stored}, this engine read {self.state['revision']}")
            self.state["revision"] += 1
            self.files.write(self.path, json.dumps(self.state, sort_keys=True))

    # Databases and policies

    @property
    def databases(self) -> dict:
        return self.state["databases"]

    def database(self, name: str | None) -> dict:
        if name is None:
            raise QueryError("no database is named")
        if name not in self.databases:
            raise QueryError(f"database not found: {name}")
        return self.databases[name]

    def create_database(self, name: str, rp: str = "autogen", how: Mapping | None = None) -> None:
        self.databases.setdefault(name, {"policies": {rp: how or policy(None)}, "default": rp, "measurements": {}, "cqs": {}, "mvs": {}})

    def rp(self, db: str, name: str | None) -> str:
        """The named policy; without a name, or for "default", the database's default one."""
        d = self.database(db)
        if name is None or name == "default" and name not in d["policies"]:
            return d["default"]
        if name not in d["policies"]:
            raise QueryError(f"retention policy not found: {name}")
        return name

    def policy_rows(self, db: str) -> list[tuple]:
        d = self.database(db)
        return [(n, format_duration(p["duration"]), format_duration(p["shard"]), p["replication"], n == d["default"]) for n, p in sorted(d["policies"].items())]

    # Measurements

    def measurements(self, db: str, rp: str | None = None) -> dict:
        held = self.database(db)["measurements"]
        return {k.split("\x00", 1)[1]: v for k, v in held.items() if rp is None or k.split("\x00", 1)[0] == rp}

    def measurement(self, db: str, rp: str, name: str) -> dict | None:
        return self.database(db)["measurements"].get(f"{rp}\x00{name}")

    def put_measurement(self, db: str, rp: str, name: str, meta: dict) -> None:
        self.database(db)["measurements"][f"{rp}\x00{name}"] = meta

    def drop_measurement(self, db: str, rp: str, name: str) -> None:
        self.database(db)["measurements"].pop(f"{rp}\x00{name}", None)

    def next_batch(self) -> int:
        self.state["batch"] += 1
        return self.state["batch"]

    # Streams, known by the id that Spark keeps in their checkpoint

    def stream(self, key: str) -> dict:
        """What is kept of a stream: its number, no two of which are equal, and its last batch."""
        streams = self.state["streams"]
        return streams.setdefault(key, {"no": len(streams), "last": -1, "batch": 0, "now": 0})

    def stream_batch(self, key: str, number: int, now: int) -> tuple[int, int, bool]:
        """(batch, time of writing, whether it ran before) of a stream's micro-batch; the same ones whenever it runs again."""
        held = self.stream(key)
        if number < held["last"]:
            raise QueryError(f"micro-batch {number} of a stream comes after {held['last']}")
        again = number == held["last"]
        if not again:
            held |= {"last": number, "batch": self.next_batch(), "now": now}
            self.save()
        return held["batch"], held["now"], again


def new_measurement() -> dict:
    """versions: the folders of facts, a new one where a field's type is widened. shared: dates (or "*" for all) in which a series and
    instant can have several rows, as several writes had them. not_before: microseconds before which retention has dropped all."""
    return {"fields": {}, "tags": [], "tombstones": [], "rollups": {}, "mean_fields": [], "view": None, "versions": [{"folder": "v0", "types": {}}], "next_version": 1, "shared": [], "not_before": None}


def add_version(meta: dict, types: Mapping[str, str]) -> None:
    meta["versions"].append({"folder": f"v{meta['next_version']}", "types": dict(types)})
    meta["next_version"] += 1


def merged(meta: dict, fields: Mapping[str, str], tags: list[str]) -> dict:
    """The schema after a write of these fields and tags; raises without changing anything if a type conflicts."""
    out = json.loads(json.dumps(meta))
    for f, kind in fields.items():
        out["fields"][f] = widen(out["fields"].get(f), kind)
    # files of one version hold one type for each field
    last = out["versions"][-1]["types"]
    if any(f in last and last[f] != out["fields"][f] for f in fields):
        add_version(out, {})
    out["versions"][-1]["types"] |= {f: out["fields"][f] for f in fields}
    out["tags"] = sorted({*out["tags"], *tags})
    return out
