"""Search, counts, histogram, activity and paging over events and changes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from logmeridian.functions.predicates import after_cursor, any_of, full_text, matching, search_criteria, time_range
from logmeridian.operators.correlate import source_activity
from logmeridian.scope import AccessScope, in_scope, out_of_scope
from logmeridian.windows import ChangeQuery, EventCursor, EventQuery, Instant, between, to_instant


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: EventCursor | None
    has_more: bool


def search_events(events: DataFrame, query: EventQuery, scope: AccessScope) -> DataFrame:
    """One page in ``(ts, event_id)`` order, holding one row more than asked to tell whether more follow.

    Sort and limit together become a per-partition top-k; nothing is sorted whole.
    """
    rows = events.filter(matching(events, query, scope) & after_cursor(query.cursor, query.ascending))
    return rows.orderBy(*page_order(query.ascending)).limit(query.page_rows + 1)


def page_order(ascending: bool) -> list[Column]:
    keys = (F.col("ts"), F.col("event_id"))
    return [k.asc() if ascending else k.desc() for k in keys]


def page(events: DataFrame, query: EventQuery, scope: AccessScope) -> Page:
    """Fetch one page (at most the page limit) and the cursor of the next."""
    found = search_events(events, query, scope).collect()
    kept = found[: query.page_rows]
    more = len(found) > query.page_rows
    cursor = EventCursor(kept[-1]["ts"], kept[-1]["event_id"]) if more else None
    return Page(kept, cursor, more)


def find_event(events: DataFrame, event_id: str, scope: AccessScope) -> DataFrame:
    return events.filter(in_scope(scope) & (F.col("event_id") == event_id)).limit(1)


def count_events(events: DataFrame, query: EventQuery, scope: AccessScope) -> DataFrame:
    return events.filter(matching(events, query, scope)).agg(F.count(F.lit(1)).alias("event_count"))


def count_events_out_of_scope(events: DataFrame, query: EventQuery, scope: AccessScope) -> DataFrame:
    """Events the scope hides; of the search only time and full text apply, by definition."""
    hidden = time_range(events, query.start, query.end) & out_of_scope(scope) & full_text(query.full_text)
    return events.filter(hidden).agg(F.count(F.lit(1)).alias("event_count"))


def bucket_seconds(start: Instant, end: Instant, requested: int, max_buckets: int | None = None) -> int:
    """The requested width; with ``max_buckets`` widened until the epoch-aligned range needs no more."""
    width = max(requested, 1)
    if max_buckets is not None:
        first, last = (_epoch(t) for t in (start, end))
        width = max(width, math.ceil((last - first) / max_buckets))
        while math.ceil(last / width) - first // width > max_buckets:
            width += 1
    return width


def _epoch(value: Instant) -> float:
    return (to_instant(value) - to_instant("1970-01-01")).total_seconds()


def bucket_start(ts: Column, seconds: int) -> Column:
    """Epoch-aligned bucket a timestamp falls into."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds))).cast("timestamp_ntz")


def histogram(
    events: DataFrame,
    query: EventQuery,
    scope: AccessScope,
    requested_seconds: int,
    by_source: bool = False,
    max_buckets: int | None = None,
) -> DataFrame:
    """Counts per fixed bucket, per source if asked."""
    width = bucket_seconds(query.start, query.end, requested_seconds, max_buckets)
    keys = [bucket_start(F.col("ts"), width).alias("bucket_start")]
    keys.append(F.col("source_id") if by_source else F.lit("").alias("source_id"))
    return (
        events.filter(matching(events, query, scope)).groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    )


def bucket_grid(events: DataFrame, start: Instant, end: Instant, seconds: int) -> DataFrame:
    """Every epoch-aligned bucket of a range."""
    first = int((to_instant(start) - to_instant("1970-01-01")).total_seconds())
    last = (to_instant(end) - to_instant("1970-01-01")).total_seconds()
    first -= first % seconds
    buckets = max(0, math.ceil((last - first) / seconds))
    return events.sparkSession.range(0, buckets, 1, 1).select(
        F.timestamp_seconds(F.lit(first) + F.col("id") * seconds).cast("timestamp_ntz").alias("bucket_start")
    )


def dense_series(
    events: DataFrame, query: EventQuery, scope: AccessScope, requested_seconds: int
) -> DataFrame:
    """The histogram with a zero for every empty bucket."""
    width = bucket_seconds(query.start, query.end, requested_seconds)
    counted = histogram(events, query, scope, width).drop("source_id")
    grid = bucket_grid(events, query.start, query.end, width)
    return grid.join(counted, "bucket_start", "left").select(
        "bucket_start", F.coalesce("event_count", F.lit(0).cast("bigint")).alias("event_count")
    )


def ratio_series(dense: DataFrame, seconds: int) -> DataFrame:
    """Each bucket over the one before it (at least 1); the first bucket has no predecessor and goes.

    Buckets have a fixed width, so the predecessor is found by an equi join and no row order is needed.
    """
    shift = F.expr(f"bucket_start + make_dt_interval(0, 0, 0, {seconds})")
    before = dense.select(shift.alias("bucket_start"), F.col("event_count").alias("previous"))
    return dense.join(before, "bucket_start").select(
        "bucket_start", "event_count", (F.col("event_count") / F.greatest(F.col("previous"), F.lit(1))).alias("ratio")
    )


def source_gaps(events: DataFrame, query: EventQuery, scope: AccessScope, seconds: int) -> DataFrame:
    """Lengths of the silent stretches of each source between its occupied buckets, ends included."""
    width = F.lit(seconds)
    bucket = F.unix_seconds(F.col("ts").cast("timestamp"))
    occupied = (
        events.filter(matching(events, query, scope))
        .select("owner_group", "source_id", (bucket - F.pmod(bucket, width)).alias("at"))
        .distinct()
    )
    first, last = int(_epoch(query.start)) // seconds * seconds, math.ceil(_epoch(query.end) / seconds) * seconds
    by = Window.partitionBy("owner_group", "source_id").orderBy("at")
    previous = F.coalesce(F.lag("at").over(by) + width, F.lit(first))
    inner = occupied.select("owner_group", "source_id", previous.alias("gap_from"), F.col("at").alias("gap_to"))
    tail = occupied.groupBy("owner_group", "source_id").agg((F.max("at") + width).alias("gap_from")).withColumn("gap_to", F.lit(last))
    return (
        inner.unionByName(tail)
        .filter(F.col("gap_to") > F.col("gap_from"))
        .select("owner_group", "source_id", "gap_from", "gap_to", (F.col("gap_to") - F.col("gap_from")).alias("gap_seconds"))
    )


def activity(events: DataFrame, query: EventQuery, scope: AccessScope) -> DataFrame:
    return source_activity(events.filter(matching(events, query, scope)))


def change_criteria(query: ChangeQuery) -> Column:
    return (
        between("ts", query.start, query.end)
        & any_of("target_id", query.target_ids)
        & any_of("change_kind", query.change_kinds)
    )


def search_changes(changes: DataFrame, query: ChangeQuery, scope: AccessScope) -> DataFrame:
    """Newest first."""
    visible = changes.filter(change_criteria(query) & in_scope(scope, query.owner_groups))
    ordered = visible.orderBy(F.col("ts").desc(), F.col("change_id").desc())
    return ordered if query.limit is None else ordered.limit(query.limit)


def count_changes_out_of_scope(changes: DataFrame, query: ChangeQuery, scope: AccessScope) -> DataFrame:
    return changes.filter(change_criteria(query) & out_of_scope(scope)).agg(
        F.count(F.lit(1)).alias("change_count")
    )


def search_sources(inventory: DataFrame, scope: AccessScope) -> DataFrame:
    """The visible inventory in id order, with a flag for sources bound to a parser."""
    return (
        inventory.filter(in_scope(scope))
        .withColumn("has_parser", F.coalesce(F.trim("parser_id") != "", F.lit(False)))
        .orderBy("source_id")
    )


__all__ = [
    "Page",
    "activity",
    "bucket_grid",
    "bucket_seconds",
    "bucket_start",
    "count_changes_out_of_scope",
    "count_events",
    "count_events_out_of_scope",
    "dense_series",
    "find_event",
    "histogram",
    "page",
    "page_order",
    "ratio_series",
    "source_gaps",
    "search_changes",
    "search_criteria",
    "search_events",
    "search_sources",
]
