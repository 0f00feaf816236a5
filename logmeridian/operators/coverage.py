"""How far parsers fill the canonical columns, per vendor."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.exprs import count_true
from logmeridian.functions.predicates import populated


def field_coverage(events: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``vendor, field, events, populated`` of every measurable column, in one aggregate."""
    counted = events.groupBy("vendor").agg(F.count(F.lit(1)).alias("events"), *[count_true(populated(c, k)).alias(c) for c, k in kinds.items()])
    return counted.select("vendor", "events", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("populated")) for c in kinds])))


def attribute_key_counts(events: DataFrame) -> DataFrame:
    return (
        events.select("vendor", F.explode(F.map_keys("attrs")).alias("attr_key")).groupBy("vendor", "attr_key").agg(F.count(F.lit(1)).alias("events"))
    )


def populated_together(events: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``a, b, n``: how many events fill both columns of each pair; 0 marks columns never filled together.

    Columns are counted, never rows paired: one conditional sum for each pair.
    """
    pairs = list(combinations(sorted(kinds), 2))
    counted = events.agg(*[count_true(populated(a, kinds[a]) & populated(b, kinds[b])).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))
