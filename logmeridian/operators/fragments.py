"""Parts of messages that no field captures: the complement of what the fields' values cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.functions.exprs import let

# Fields that say nothing about what a parser took from the line, and the least lengths.
NO_EVIDENCE = ("body", "raw_ref", "event_id", "signature_hash", "ts", "ingested_at", "owner_group", "source_id")
MIN_VALUE, MIN_FRAGMENT, MOST = 2, 4, 25


def _places(body: Column, value: Column) -> Column:
    """``(start, end)`` of every place, overlapping ones too, at which ``value`` stands in ``body``; counted from 1, the end being the place after it."""
    n = F.length(value)
    starts = F.filter(F.sequence(F.lit(1), F.length(body) - n + 1), lambda i: F.substr(body, i, n) == value)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("end")))


def _standing(body: Column, values: Column) -> Column:
    """Distinct values of two characters or more that stand in ``body``."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.length(v) >= MIN_VALUE) & F.contains(body, v)))


def _complement(body: Column, covered: Column) -> Column:
    """The trimmed texts between the covered places that are four characters or longer."""
    start = F.struct(F.lit(1).alias("reach"), F.array().cast("array<struct<start: int, end: int>>").alias("gaps"))

    def further(s: Column, x: Column) -> Column:
        gap = F.struct(s["reach"].alias("start"), x["start"].alias("end"))
        return F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), F.when(x["start"] > s["reach"], F.array_append(s["gaps"], gap)).otherwise(s["gaps"]).alias("gaps"))

    ended = F.array_append(F.array_sort(covered), F.struct((F.length(body) + 1).alias("start"), (F.length(body) + 1).alias("end")))
    gaps = F.aggregate(ended, start, further, lambda s: s["gaps"])
    texts = F.transform(gaps, lambda g: F.regexp_replace(F.substr(body, g["start"], g["end"] - g["start"]), r"^\s+|\s+$", ""))
    return F.filter(texts, lambda t: F.length(t) >= MIN_FRAGMENT)


def uncaptured(events: DataFrame, fields: Sequence[str], body: str = "body", attrs: str = "attrs") -> DataFrame:
    """``events`` with ``fragments``: the parts of ``body`` that neither a value of ``fields`` or ``attrs`` nor a key of ``attrs`` covers.

    A value that holds another, shorter one as a part is a whole message or block rather than a field, and covers nothing. Fields that
    are no evidence of capture are passed over. Null bodies have no fragments; repeated fragments of a line repeat.
    """
    named = [F.col(f).cast("string") for f in fields if f not in NO_EVIDENCE]
    none = F.array().cast("array<string>")

    def found(text: Column) -> Column:
        given = F.array_distinct(F.filter(F.concat(F.array(*named) if named else none, F.coalesce(F.map_values(attrs), none)), lambda v: F.length(v) >= MIN_VALUE))

        def covered(values: Column) -> Column:
            single = F.filter(values, lambda v: ~F.exists(values, lambda o: (F.length(o) < F.length(v)) & F.contains(v, o)))
            cover = F.concat(_standing(text, single), _standing(text, F.coalesce(F.map_keys(attrs), none)))
            return F.flatten(F.transform(F.array_distinct(cover), lambda v: _places(text, v)))

        return _complement(text, let(given, covered))

    return events.withColumn("fragments", F.when(F.length(body) > 0, let(F.col(body), found)).otherwise(none))


def top_fragments(events: DataFrame, fields: Sequence[str], vendor: str = "vendor", most: int = MOST) -> DataFrame:
    """``vendor, fragment, lines, place``: the ``most`` fragments of each vendor that stand in the greatest number of places, then by text."""
    counted = uncaptured(events, fields).select(F.col(vendor).alias("vendor"), F.explode("fragments").alias("fragment")).groupBy("vendor", "fragment").agg(F.count(F.lit(1)).alias("lines"))
    order = Window.partitionBy("vendor").orderBy(F.desc("lines"), "fragment")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
