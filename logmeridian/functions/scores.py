"""Correlation statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def expected_in_window(baseline_count: Column, baseline_seconds: float, window_seconds: float) -> Column:
    """What the window would hold at the baseline's rate; 0 for an empty length."""
    if baseline_seconds <= 0 or window_seconds <= 0:
        return F.lit(0.0)
    return baseline_count.cast("double") * F.lit(window_seconds / baseline_seconds)


def poisson_z(observed: Column, expected: Column) -> Column:
    """(observed - expected) / sqrt(expected); 0 when nothing was expected."""
    return F.when(expected <= 0, F.lit(0.0)).otherwise(
        (observed.cast("double") - expected) / F.sqrt(F.when(expected > 0, expected))
    )


def lift(window: Column, window_total: Column, baseline: Column, baseline_total: Column) -> Column:
    """Ratio of shares; 0 when a total or the baseline count is 0."""
    usable = (window_total > 0) & (baseline_total > 0) & (baseline > 0)
    ratio = F.try_divide(
        F.try_divide(window.cast("double"), window_total.cast("double")),
        F.try_divide(baseline.cast("double"), baseline_total.cast("double")),
    )
    return F.when(usable, ratio).otherwise(F.lit(0.0))


def change_proximity(changed_at: Column, window_start: Column, lead_seconds: int) -> Column:
    """1 from the window start on, falling linearly to 0 over the lead before it."""
    before = (F.unix_micros(window_start.cast("timestamp")) - F.unix_micros(changed_at.cast("timestamp"))) / F.lit(
        1_000_000.0
    )
    return F.when(before <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - before / F.lit(float(lead_seconds)))
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def compare(value: Column, threshold: Column, comparison: Column) -> Column:
    """Apply one of >, >=, <, <= named in a column; any other name never matches."""
    return (
        F.when(comparison == ">", value > threshold)
        .when(comparison == ">=", value >= threshold)
        .when(comparison == "<", value < threshold)
        .when(comparison == "<=", value <= threshold)
        .otherwise(F.lit(False))
    )
