"""When continuous queries run, and over which windows. All times are epoch nanoseconds."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.plans.ast import QueryError, Select


@dataclass(frozen=True)
class Schedule:
    """interval and offset of GROUP BY time(), and RESAMPLE EVERY and FOR if given."""

    interval: int
    offset: int = 0
    every: int | None = None
    span: int | None = None

    def __post_init__(self) -> None:
        if self.span is not None and self.span < max(self.every or 0, self.interval):
            raise QueryError("FOR must be at least EVERY and the GROUP BY time() interval")

    @staticmethod
    def of(select: Select, every: int | None, span: int | None) -> Schedule:
        if select.every is None:
            raise QueryError("a continuous query needs GROUP BY time()")
        return Schedule(select.every, select.shift, every, span)

    @property
    def basic(self) -> bool:
        return self.every is None and self.span is None

    def _floor(self, at: int, step: int) -> int:
        return at - (at - self.offset) % step

    def boundary(self, now: int) -> int:
        """The last instant at or before now at which a run was due."""
        return self._floor(now, self.every or self.interval)

    def due(self, now: int, last_run: int | None, created: int) -> bool:
        """Whether a boundary has passed since the last run (or since creation)."""
        return self.boundary(now) > self.boundary(created if last_run is None else last_run)

    def window(self, now: int) -> tuple[int, int]:
        """[start, end) of the run that is due at now."""
        end = self.boundary(now)
        if self.span is not None:
            return end - self.span, end
        if self.every is None:
            return end - self.interval, end
        if self.every > self.interval:
            return now - self.every, now
        start = self._floor(now, self.interval)
        return start, start + self.interval
