"""What an alert rule would have done: counting rules over a series of their windows, silence rules over the gaps of each source."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.functions.exprs import count_true
from logmeridian.functions.scores import compare
from logmeridian.operators import search
from logmeridian.operators.alerts import Rule
from logmeridian.scope import AccessScope
from logmeridian.windows import EventQuery, Instant, instant, to_instant

DEFAULT_LOOKBACK, MAX_LOOKBACK = 24 * 3600, 7 * 86_400
MAX_SOURCES = 200


def lookback(seconds: int | None) -> int:
    """The span to look at: a day unless asked for more than nothing, a week at most."""
    return DEFAULT_LOOKBACK if seconds is None or seconds <= 0 else min(seconds, MAX_LOOKBACK)


@dataclass(frozen=True)
class Preview:
    """``rows`` are points (``bucket_start, event_count, value, fires``) or sources (``source_id, owner_group, last_seen, gaps, firings``).

    ``summary`` is one row: ``firings``, ``shown`` and ``left_out``, the sources that are not among the rows.
    """

    rows: DataFrame
    summary: DataFrame


def preview_counting(events: DataFrame, rule: Rule, scope: AccessScope, now: Instant, seconds: int | None = None) -> Preview:
    """A threshold or ratio rule over every one of its windows, aligned to the epoch; empty windows count as 0.

    The scope is narrowed to the rule's groups. A ratio compares with the window before, at least 1; the first window has none and goes.
    """
    end = to_instant(now)
    query = EventQuery(end - timedelta(seconds=lookback(seconds)), end)
    width = max(rule.window_seconds, 1)
    dense = search.dense_series(events.filter(F.expr(rule.predicate)), query, scope.narrow(rule.owner_groups), width)
    if rule.kind == "ratio":
        points = search.ratio_series(dense, width).withColumnRenamed("ratio", "value")
    elif rule.kind == "threshold":
        points = dense.withColumn("value", F.col("event_count").cast("double"))
    else:
        raise ValueError(f"{rule.kind!r} rules do not count")
    rows = points.withColumn("fires", compare(F.col("value"), F.lit(rule.threshold), F.lit(rule.comparison)))
    return Preview(rows, rows.agg(count_true(F.col("fires")).alias("firings"), F.count(F.lit(1)).alias("shown"), F.lit(0).cast("long").alias("left_out")))


def preview_silence(
    events: DataFrame, inventory: DataFrame, silence_seconds: int, scope: AccessScope, now: Instant, seconds: int | None = None, source_ids: tuple[str, ...] = (), most: int = MAX_SOURCES
) -> Preview:
    """The silent stretches of each enabled source in the span, and how many of them reach ``silence_seconds``.

    Events count in buckets of a tenth of that, one to sixty minutes; a stretch lasts from the end of a bucket to the start of the
    next, and to the end of the span. A source that was created later is not silent before. The first ``most`` sources by id are shown and
    counted, the summary tells how many more there are.
    """
    end = to_instant(now)
    begin = end - timedelta(seconds=lookback(seconds))
    width = min(max(silence_seconds // 10, 60), 3600)
    query = EventQuery(begin, end, source_ids=source_ids)
    chosen = inventory.filter("enabled").filter(search.in_scope(scope))
    candidates = chosen.filter(F.col("source_id").isin(list(source_ids))) if source_ids else chosen
    shown = candidates.orderBy("source_id").limit(most).select(
        "source_id", "owner_group", F.greatest(F.unix_micros(F.col("created_at").cast("timestamp")), F.unix_micros(instant(begin).cast("timestamp"))).alias("start")
    )
    buckets = search.histogram(events, query, scope, width, by_source=True).select("source_id", F.unix_micros(F.col("bucket_start").cast("timestamp")).alias("at"))
    met = shown.join(buckets, "source_id")
    step = F.lit(width * 1_000_000)
    order = Window.partitionBy("source_id").orderBy("at")
    before = F.greatest(F.col("start"), F.lag("at").over(order) + step)
    inner = met.select("source_id", F.col("at").alias("until"), before.alias("since"))
    last = met.groupBy("source_id").agg(F.max("at").alias("last"))
    tail = shown.join(last, "source_id", "left").select(
        "source_id", F.unix_micros(instant(end).cast("timestamp")).alias("until"), F.greatest(F.col("start"), F.col("last") + step).alias("since")
    )
    gap = F.struct(F.col("since").alias("at"), ((F.col("until") - F.col("since")) / 1_000_000.0).alias("gap"))
    gaps = inner.unionByName(tail).filter("until > since").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(gap)), lambda g: g["gap"]).alias("gaps"))  # at most as many as there are buckets
    none = F.array().cast("array<double>")
    rows = (
        shown.select("source_id", "owner_group").join(last, "source_id", "left").join(gaps, "source_id", "left")
        .select("source_id", "owner_group", F.timestamp_micros("last").cast("timestamp_ntz").alias("last_seen"), F.coalesce("gaps", none).alias("gaps"))
        .withColumn("firings", F.size(F.filter("gaps", lambda g: g >= silence_seconds)).cast("long"))
    )
    found = rows.agg(F.coalesce(F.sum("firings"), F.lit(0)).alias("firings"), F.count(F.lit(1)).alias("shown"))
    return Preview(rows, found.crossJoin(candidates.agg(F.count(F.lit(1)).alias("all_"))).select("firings", "shown", (F.col("all_") - F.col("shown")).alias("left_out")))  # one row each
