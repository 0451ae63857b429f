"""Time buckets: epoch-aligned, shifted, or following the wall clock of a zone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (the engine keeps the session in UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def instant(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


@dataclass(frozen=True)
class Buckets:
    """Buckets of `step` microseconds shifted by `shift`.

    With a zone, steps of whole days are cut on its wall clock, so days have 23 to 25 hours; shorter steps are
    aligned to the wall clock by the zone's offset at that instant and stay apart where the clock is set back.
    A bucket's key is a number that grows by `step`: wall-clock time for days in a zone, else UTC.
    """

    step: int
    shift: int = 0
    zone: str | None = None

    @property
    def by_wall_clock(self) -> bool:
        return self.zone is not None and self.step % DAY == 0

    def _floor(self, us: Column) -> Column:
        return us - F.pmod(us - F.lit(self.shift), F.lit(self.step))

    def key(self, time: Column) -> Column:
        if self.zone is None:
            return self._floor(micros(time))
        local = F.unix_micros(F.from_utc_timestamp(time.cast("timestamp"), self.zone))
        return self._floor(local) if self.by_wall_clock else self._floor(local) - (local - micros(time))

    def start(self, key: Column) -> Column:
        """Start of a bucket, UTC."""
        if self.by_wall_clock:
            return F.to_utc_timestamp(F.timestamp_micros(key), self.zone).cast("timestamp_ntz")
        return instant(key)

    def key_of(self, us: int) -> int:
        """key() of an instant known to the planner."""
        if self.zone is None:
            return us - (us - self.shift) % self.step
        ahead = (EPOCH + timedelta(microseconds=us)).astimezone(ZoneInfo(self.zone)).utcoffset() // timedelta(microseconds=1)
        local = us + ahead
        key = local - (local - self.shift) % self.step
        return key if self.by_wall_clock else key - ahead
