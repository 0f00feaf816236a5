"""Search predicates over the event table."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.schemas import FILTERABLE_COLUMNS, PARSE_STATUS_ORDINAL
from logmeridian.scope import AccessScope, in_scope
from logmeridian.windows import EventCursor, EventQuery, FieldFilter, Instant, between, instant, to_instant

_INTEGER_RANGES = {
    "smallint": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "bigint": (-(2**63), 2**63 - 1),
}


def time_range(df: DataFrame, start: Instant, end: Instant) -> Column:
    """Half-open range on ``ts``, plus bounds on the partition column where the table has one."""
    predicate = between("ts", start, end)
    if "event_date" not in df.columns:
        return predicate
    first = to_instant(start).date()
    last = (to_instant(end) - timedelta(microseconds=1)).date()
    return (
        (F.col("event_date") >= F.lit(first.isoformat()).cast("date"))
        & (F.col("event_date") <= F.lit(last.isoformat()).cast("date"))
        & predicate
    )


def any_of(column: str, values: Sequence[str]) -> Column:
    """IN-list; an empty list does not restrict."""
    return F.col(column).isin(list(values)) if values else F.lit(True)


def parse_status_in(statuses: Sequence[str]) -> Column:
    unknown = set(statuses) - set(PARSE_STATUS_ORDINAL)
    if unknown:
        raise ValueError(f"unknown parse status: {sorted(unknown)}")
    return any_of("parse_status", statuses)


def full_text(text: str | None, column: str = "body") -> Column:
    """Case-sensitive substring; blank text does not restrict."""
    return F.col(column).contains(text) if text and text.strip() else F.lit(True)


def canonical_ip(text: str) -> str:
    """One spelling per address: plain IPv4 also for the mapped form; unparsable text is kept."""
    try:
        address = ipaddress.ip_address(text.strip())
    except ValueError:
        return text.strip().removeprefix("::ffff:")
    mapped = getattr(address, "ipv4_mapped", None)
    return str(mapped or address)


def _operand(item: FieldFilter, value: str) -> object:
    kind = FILTERABLE_COLUMNS[item.field]
    if item.field in ("src_ip", "dst_ip"):
        if item.op in ("contains", "startswith"):
            return value.removeprefix("::ffff:")
        return canonical_ip(value)
    if kind == "string":
        return value
    number = int(value)
    if item.field == "signature_hash" and number >= 2**63:
        number -= 2**64
    low, high = _INTEGER_RANGES[kind]
    if not low <= number <= high:
        raise ValueError(f"{item.field}: {value} does not fit {kind}")
    return number


def field_filter(item: FieldFilter) -> Column:
    """One typed filter; unknown fields and empty value lists are errors, never ignored."""
    kind = FILTERABLE_COLUMNS.get(item.field)
    if kind is None:
        raise ValueError(f"{item.field!r} cannot be filtered; allowed: {sorted(FILTERABLE_COLUMNS)}")
    if not item.values:
        raise ValueError(f"filter on {item.field!r} has no value")
    operands = [_operand(item, v) for v in item.values]
    column = F.col(item.field)
    first = F.lit(operands[0]).cast(kind)
    if item.op in ("contains", "startswith"):
        if kind != "string":
            raise ValueError(f"{item.op} needs a text column, {item.field!r} is {kind}")
        return column.contains(operands[0]) if item.op == "contains" else column.startswith(operands[0])
    builders = {
        "eq": lambda: column == first,
        "ne": lambda: column != first,
        "in": lambda: column.isin(operands),
        "gt": lambda: column > first,
        "lt": lambda: column < first,
    }
    if item.op not in builders:
        raise ValueError(f"unknown operator {item.op!r}")
    return builders[item.op]()


def after_cursor(cursor: EventCursor | None, ascending: bool) -> Column:
    """Keyset position on ``(ts, event_id)``; the outer bound on ``ts`` reaches the scan."""
    if cursor is None:
        return F.lit(True)
    at, ts, event_id = instant(cursor.ts), F.col("ts"), F.col("event_id")
    if ascending:
        return (ts >= at) & ((ts > at) | (event_id > cursor.event_id))
    return (ts <= at) & ((ts < at) | (event_id < cursor.event_id))


def search_criteria(query: EventQuery) -> Column:
    """Everything a saved search restricts apart from time and scope."""
    predicate = any_of("source_id", query.source_ids) & parse_status_in(query.parse_statuses)
    predicate = predicate & full_text(query.full_text)
    for item in query.filters:
        predicate = predicate & field_filter(item)
    return predicate


def matching(df: DataFrame, query: EventQuery, scope: AccessScope) -> Column:
    """The whole predicate of a search, without its cursor."""
    return time_range(df, query.start, query.end) & in_scope(scope, query.owner_groups) & search_criteria(query)


def populated(column: str, kind: str) -> Column:
    """Whether a sentinel-defaulted column carries a value."""
    value = F.col(column)
    if kind == "text":
        return value != ""
    if kind == "number":
        return value != 0
    if kind == "address":
        return ~value.isin("", "::", "0.0.0.0")
    if kind == "map":
        return F.size(value) > 0
    raise ValueError(f"unknown kind {kind!r}")
