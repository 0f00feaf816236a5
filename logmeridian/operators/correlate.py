"""Incident window against baseline: first-seen, volume, lift, propagation, silence, trust, sweep.

Events are read with the window predicate pushed down and collapsed map-side before every shuffle,
so one signature, source or field value holding a third of the rows costs a few partial sums per
task. Message text is never aggregated: sample bodies are looked up afterwards for the rows a report
keeps (:func:`with_sample_bodies`).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions import scores
from logmeridian.functions.exprs import count_true
from logmeridian.functions.predicates import any_of, time_range
from logmeridian.schemas import LIFT_FIELDS
from logmeridian.scope import AccessScope, in_scope
from logmeridian.windows import CorrelationWindow, between, instant


def narrowed(window: CorrelationWindow, scope: AccessScope) -> Column:
    return in_scope(scope, window.owner_groups) & any_of("source_id", window.source_ids)


def window_rows(events: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    return events.filter(time_range(events, window.start, window.end) & narrowed(window, scope))


def baseline_rows(events: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    return events.filter(time_range(events, window.baseline_start, window.baseline_end) & narrowed(window, scope))


def both_rows(events: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    """Window and baseline in one scan; the span between them is pruned by the inner predicate."""
    span = time_range(events, window.baseline_start, window.end)
    return events.filter(span & narrowed(window, scope) & (window.in_window() | window.in_baseline()))


def _keys(signature: str | Sequence[str]) -> list[str]:
    return [signature] if isinstance(signature, str) else list(signature)


def _signed() -> Column:
    """Aggregated beside groups of signatures, for :func:`signed_only`."""
    return F.max("signature_hash").alias("signed_")


def signed_only(grouped: DataFrame) -> DataFrame:
    """Groups whose signature is one (hash 0 means none), told after the aggregation: a filter on the hash itself would
    be pushed below the masks and evaluate them once more for every row."""
    return grouped.filter(F.col("signed_") != 0).drop("signed_")


def first_seen(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    signature: str | Sequence[str] = "signature_hash",
) -> DataFrame:
    """Signatures of the window that the baseline does not hold.

    Both sides collapse before the anti join: the window to (signature, source), the baseline to its
    distinct signatures. Hash 0 means "no signature" and never takes part.
    """
    keys = _keys(signature)
    per_source = signed_only(
        window_rows(events, window, scope)
        .groupBy(*keys, "source_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), _signed())
    )
    seen_before = baseline_rows(events, window, scope).select(*keys).distinct()
    return (
        per_source.groupBy(*keys)
        .agg(
            F.sum("n").alias("event_count"),
            F.min("first_ts").alias("first_seen_at"),
            F.count(F.lit(1)).alias("source_count"),
        )
        .join(seen_before, keys, "left_anti")
    )


def signature_volume(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    signature: str | Sequence[str] = "signature_hash",
) -> DataFrame:
    """Window and baseline counts per signature in one pass, for signatures the window holds."""
    keys = _keys(signature)
    return signed_only(
        both_rows(events, window, scope)
        .groupBy(*keys)
        .agg(
            count_true(window.in_window()).alias("window_count"),
            count_true(window.in_baseline()).alias("baseline_count"),
            F.min(F.when(window.in_window(), F.col("ts"))).alias("first_seen_at"),
            _signed(),
        )
        .filter(F.col("window_count") > 0)
    )


def volume_deviation(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    min_z: float = 3.0,
    min_count: int = 5,
    signature: str | Sequence[str] = "signature_hash",
) -> DataFrame:
    """Signatures whose window count is improbably high for the baseline's rate."""
    counted = signature_volume(events, window, scope, signature).filter(F.col("window_count") >= min_count)
    expected = scores.expected_in_window(F.col("baseline_count"), window.baseline_seconds, window.length_seconds)
    return (
        counted.withColumn("expected", expected)
        .withColumn("z_score", scores.poisson_z(F.col("window_count"), F.col("expected")))
        .filter(F.col("z_score") >= min_z)
    )


def with_sample_bodies(top: DataFrame, events: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    """Add ``sample_body``: the earliest message (ties by id) of each signature in ``top``.

    Only the rows sitting at a signature's first instant survive the join, and only those carry text.
    """
    wanted = top.select("signature_hash", F.col("first_seen_at").alias("ts"))
    samples = (
        window_rows(events, window, scope)
        .select("signature_hash", "ts", "event_id", "body")
        .join(wanted, ["signature_hash", "ts"])
        .groupBy("signature_hash")
        .agg(F.min_by("body", "event_id").alias("sample_body"))
    )
    return top.join(samples, "signature_hash", "left")


def _per_field(grouped: DataFrame, fields: Sequence[str], *measures: str) -> DataFrame:
    pairs = ", ".join(f"'{f}', cast({f} AS string)" for f in fields)
    stacked = grouped.select(F.expr(f"stack({len(fields)}, {pairs}) AS (field, value)"), *measures)
    return stacked.filter(F.col("value") != "")


def attribute_counts(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    fields: Sequence[str] = LIFT_FIELDS,
) -> DataFrame:
    """Window and baseline counts per field value, for values the window holds.

    The fields are unpivoted only after rows are collapsed to their distinct combinations, so the
    eight-fold fan-out applies to combinations and not to events.
    """
    unknown = [f for f in fields if f not in LIFT_FIELDS]
    if unknown:
        raise ValueError(f"not a lift field: {unknown}; allowed: {list(LIFT_FIELDS)}")
    combos = (
        both_rows(events, window, scope)
        .groupBy(*fields)
        .agg(
            count_true(window.in_window()).alias("w"),
            count_true(window.in_baseline()).alias("b"),
        )
    )
    return (
        _per_field(combos, fields, "w", "b")
        .groupBy("field", "value")
        .agg(F.sum("w").alias("window_count"), F.sum("b").alias("baseline_count"))
        .filter(F.col("window_count") > 0)
    )


def top_per_field(counts: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent values of each field, ties in value order.

    Spark ranks within partitions first and drops rows past ``limit`` before the shuffle, so a field
    with many values never reaches one task whole.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("field").orderBy(F.col("window_count").desc(), F.col("value"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .drop("rank")
    )


def attribute_lift(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    fields: Sequence[str] = LIFT_FIELDS,
    min_lift: float = 2.0,
    min_count: int = 5,
    limit_per_field: int | None = None,
) -> DataFrame:
    """Field values over-represented in the window.

    Totals cover all values the window holds; with ``limit_per_field`` they cover the kept values
    only. They come from a second, tiny aggregate joined back, not from a window over all values.
    """
    counts = attribute_counts(events, window, scope, fields)
    if limit_per_field is not None:
        counts = top_per_field(counts, limit_per_field)
    totals = counts.groupBy("field").agg(
        F.sum("window_count").alias("window_total"), F.sum("baseline_count").alias("baseline_total")
    )
    # one row per field of the fixed allow-list
    scored = counts.join(F.broadcast(totals), "field").withColumn(
        "lift",
        scores.lift(
            F.col("window_count"), F.col("window_total"), F.col("baseline_count"), F.col("baseline_total")
        ),
    )
    return scored.filter((F.col("window_count") >= min_count) & (F.col("lift") >= min_lift))


def degraded(severity_mode: str = "ge", severity: int = 4) -> Column:
    """Failed parse, or bad by severity.

    ``ge`` follows the stored scale (higher is worse); ``le`` with 3 selects what the original
    definition does.
    """
    if severity_mode == "ge":
        bad = F.col("severity_num") >= severity
    elif severity_mode == "le":
        bad = (F.col("severity_num") > 0) & (F.col("severity_num") <= severity)
    else:
        raise ValueError(f"unknown severity mode {severity_mode!r}")
    return (F.col("parse_status") == "failed") | bad


def propagation(
    events: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    severity_mode: str = "ge",
    severity: int = 4,
) -> DataFrame:
    """First degraded instant per source."""
    return (
        window_rows(events, window, scope)
        .filter(degraded(severity_mode, severity))
        .groupBy("owner_group", "source_id")
        .agg(
            F.min("ts").alias("first_degraded_at"),
            F.count(F.lit(1)).alias("degraded_count"),
            count_true(F.col("time_source") != "parsed").alias("unreliable_time_count"),
        )
    )


def with_lag(onsets: DataFrame) -> DataFrame:
    """Seconds behind the earliest onset; the earliest comes from a one-row scalar subquery."""
    earliest = onsets.agg(F.min("first_degraded_at")).scalar()
    lag = scores.seconds_between(F.col("first_degraded_at"), F.col("earliest_onset"))
    return (
        onsets.withColumn("earliest_onset", earliest)
        .withColumn("lag_seconds", lag)
        .withColumn("weight", 1.0 / (1.0 + F.col("lag_seconds")))
        .drop("earliest_onset")
    )


def source_activity(rows: DataFrame) -> DataFrame:
    """Last event time, last ingest time and event count per source."""
    return rows.groupBy("owner_group", "source_id").agg(
        F.max("ts").alias("last_ts"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.count(F.lit(1)).alias("event_count"),
    )


def silent_sources(
    events: DataFrame, window: CorrelationWindow, scope: AccessScope, min_expected: float = 5.0
) -> DataFrame:
    """Sources regular in the baseline that sent nothing in the window."""
    baseline = source_activity(baseline_rows(events, window, scope))
    active = window_rows(events, window, scope).select("source_id").distinct()
    expected = scores.expected_in_window(F.col("event_count"), window.baseline_seconds, window.length_seconds)
    return (
        baseline.join(active, "source_id", "left_anti")
        .withColumn("expected", expected)
        .filter(F.col("expected") >= min_expected)
    )


def window_trust(events: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    """How many events of the window carry a time the device did not write itself."""
    return (
        window_rows(events, window, scope)
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            count_true(F.col("time_source") != "parsed").alias("unreliable_events"),
        )
        .withColumn("unreliable_ratio", F.try_divide(F.col("unreliable_events"), F.col("total_events")))
    )


def baseline_sweep(
    events: DataFrame,
    start,
    end,
    lengths: Sequence[timedelta],
    scope: AccessScope,
    gap: timedelta = timedelta(0),
    reach: timedelta = timedelta(hours=1),
    signature: str | Sequence[str] = "signature_hash",
) -> DataFrame:
    """How many window signatures look new under each candidate baseline length.

    One scan and one grouping: per signature its presence in the window and its last instant before
    the baseline end. A signature is new under a length when that instant is older than the length.
    A length whose far end (``reach`` long) holds no signed event is reported as too long for the
    archive and gets no count.
    """
    from logmeridian.windows import to_instant

    keys = _keys(signature)
    start, end = to_instant(start), to_instant(end)
    base_end = start - gap
    starts = [base_end - length for length in lengths]
    rows = events.filter(
        time_range(events, min(starts), end) & in_scope(scope) & (F.col("signature_hash") != 0)
    )
    in_window, before = between("ts", start, end), F.col("ts") < instant(base_end)
    probes = [
        F.max(between("ts", s, s + min(length, reach))).alias(f"reach_{i}")
        for i, (s, length) in enumerate(zip(starts, lengths))
    ]
    per_signature = rows.groupBy(*keys).agg(
        F.max(in_window).alias("in_window"),
        F.max(F.when(before, F.col("ts"))).alias("last_before"),
        *probes,
    )
    measures = [count_true(F.col("in_window")).alias("window_signatures")]
    for i, s in enumerate(starts):
        new = F.col("in_window") & (F.col("last_before").isNull() | (F.col("last_before") < instant(s)))
        measures += [count_true(new).alias(f"new_{i}"), F.max(f"reach_{i}").alias(f"reach_{i}")]
    rows_out = ", ".join(
        f"{int(length.total_seconds())}L, coalesce(reach_{i}, false), new_{i}" for i, length in enumerate(lengths)
    )
    sweep = per_signature.agg(*measures).select(
        "window_signatures",
        F.expr(f"stack({len(lengths)}, {rows_out}) AS (baseline_seconds, reached, new_count)"),
    )
    reached = F.col("reached")
    return sweep.select(
        "baseline_seconds",
        F.when(reached, "measured").otherwise("archive_too_short").alias("status"),
        F.when(reached, F.col("new_count")).otherwise(F.lit(0)).alias("first_seen_count"),
        "window_signatures",
        F.when(reached & (F.col("window_signatures") > 0), F.col("new_count") / F.col("window_signatures"))
        .otherwise(F.lit(0.0))
        .alias("first_seen_ratio"),
    )
