"""Query objects: plain values that the operators turn into predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

Instant = datetime | str


def to_instant(value: Instant) -> datetime:
    """A naive UTC datetime from an aware or naive datetime, or from ISO text."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def instant(value: Instant) -> Column:
    """A zone-free timestamp literal.

    Compared with a zone-free column it needs no cast, and against a zoned one the cast folds into
    the literal, so either way the predicate reaches the Parquet scan.
    """
    return F.expr(f"TIMESTAMP_NTZ '{to_instant(value).isoformat(sep=' ')}'")


def between(column: str, start: Instant, end: Instant) -> Column:
    """Half-open ``start <= column < end``."""
    return (F.col(column) >= instant(start)) & (F.col(column) < instant(end))


@dataclass(frozen=True)
class CorrelationWindow:
    """An incident window and the earlier baseline it is compared with."""

    start: Instant
    end: Instant
    baseline_start: Instant
    baseline_end: Instant
    owner_groups: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("start", "end", "baseline_start", "baseline_end"):
            object.__setattr__(self, name, to_instant(getattr(self, name)))
        if self.end <= self.start:
            raise ValueError(f"incident window is empty: {self.start} .. {self.end}")
        if self.baseline_end <= self.baseline_start:
            raise ValueError(f"baseline window is empty: {self.baseline_start} .. {self.baseline_end}")
        if self.baseline_end > self.start:
            raise ValueError("baseline overlaps the incident window; first-seen would silently empty out")

    @classmethod
    def for_trigger(
        cls, window_from: Instant, window_to: Instant, owner_groups: Sequence[str] = (), source_id: str = ""
    ) -> CorrelationWindow:
        """The window of an alert trigger; its baseline is the seven days before it."""
        start = to_instant(window_from)
        return cls(
            start,
            to_instant(window_to),
            start - timedelta(days=7),
            start,
            tuple(owner_groups),
            (source_id,) if source_id else (),
        )

    @property
    def length_seconds(self) -> float:
        return (self.end - self.start).total_seconds()

    @property
    def baseline_seconds(self) -> float:
        return (self.baseline_end - self.baseline_start).total_seconds()

    def in_window(self, column: str = "ts") -> Column:
        return between(column, self.start, self.end)

    def in_baseline(self, column: str = "ts") -> Column:
        return between(column, self.baseline_start, self.baseline_end)


@dataclass(frozen=True)
class FieldFilter:
    """``field op values``; op is one of eq, ne, in, gt, lt, contains, startswith."""

    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class EventCursor:
    """Last row of the previous page."""

    ts: Instant
    event_id: str


@dataclass(frozen=True)
class EventQuery:
    start: Instant
    end: Instant
    owner_groups: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    parse_statuses: tuple[str, ...] = ()
    full_text: str = ""
    filters: tuple[FieldFilter, ...] = ()
    limit: int = 100
    ascending: bool = False
    cursor: EventCursor | None = None

    @property
    def page_rows(self) -> int:
        if self.limit < 1:
            raise ValueError(f"a page needs at least one row, not {self.limit}")
        return self.limit


@dataclass(frozen=True)
class ChangeQuery:
    start: Instant
    end: Instant
    owner_groups: tuple[str, ...] = ()
    target_ids: tuple[str, ...] = ()
    change_kinds: tuple[str, ...] = ()
    limit: int | None = None
