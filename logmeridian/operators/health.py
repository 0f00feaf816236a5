"""Health figures: parser coverage, dispatch, values that do not come from the message, reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.exprs import count_true
from logmeridian.functions.predicates import populated


def parser_coverage(parsed: DataFrame, group: str) -> DataFrame:
    """``group, ok, partial, failed, total, ok_percent`` of parsed messages."""
    status = lambda s: count_true(F.col("parse_status") == s).alias(s)
    counted = parsed.groupBy(group).agg(status("ok"), status("partial"), status("failed"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("ok_percent", F.round(F.col("ok") * 100.0 / F.col("total"), 4))


def parser_wins(parsed: DataFrame) -> DataFrame:
    """How many messages each parser took."""
    # Messages without a parser go after the aggregation: before it, the filter would parse everything twice.
    return parsed.groupBy("parser_id").agg(F.count(F.lit(1)).alias("wins"), F.max("parser_id").alias("taken_")).where("taken_ <> ''").drop("taken_")


def dispatch_health(parsed: DataFrame, bound: str, target: float = 0.95) -> DataFrame:
    """One row: messages taken by the parser bound to their source, by another, by none; and the ratios.

    ``bound_misses`` counts messages with a bound parser that another one or none took. Without any
    message the bound ratio is 1 and the unmatched ratio 0.
    """
    taken, tied = F.col("parser_id") != "", F.coalesce(F.col(bound), F.lit("")) != ""
    own = taken & tied & (F.col("parser_id") == F.col(bound))
    totals = parsed.agg(
        count_true(own).alias("bound"), count_true(taken & ~F.coalesce(own, F.lit(False))).alias("candidate"), count_true(~taken).alias("unmatched"),
        count_true(tied & ~F.coalesce(own, F.lit(False))).alias("bound_misses"),
    )
    total = F.col("bound") + F.col("candidate") + F.col("unmatched")
    return totals.withColumns({
        "total": total,
        "bound_ratio": F.coalesce(F.try_divide("bound", total), F.lit(1.0)),
        "unmatched_ratio": F.coalesce(F.try_divide("unmatched", total), F.lit(0.0)),
    }).withColumn("on_target", F.col("bound_ratio") >= target)


def dispatch_tiers(parsed: DataFrame) -> DataFrame:
    """``tier, messages, attempts``: how messages found their parsers, and how many parsers were tried for them."""
    return parsed.groupBy("tier").agg(F.count(F.lit(1)).alias("messages"), F.sum("attempts").alias("attempts"))


def empty_columns(coverage: DataFrame) -> DataFrame:
    """``field, vendor`` of columns no event fills: vendor is NULL where that holds for all vendors.

    Takes the result of :func:`logmeridian.operators.coverage.field_coverage`.
    """
    filled = coverage.groupBy("field").agg(F.sum("populated").alias("all_"))
    everywhere = filled.where("all_ = 0").select("field", F.lit(None).cast("string").alias("vendor"))
    some = coverage.where("populated = 0").join(filled.where("all_ > 0").select("field"), "field").select("field", "vendor")
    return everywhere.unionByName(some)


def _in_body(value: Column, body: Column) -> Column:
    return F.coalesce(body.contains(value), F.lit(False))


def substituted_values(events: DataFrame, kinds: Mapping[str, str], body: str = "body") -> DataFrame:
    """``vendor, field, populated, substituted``: filled columns whose value does not stand in the message."""
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), populated(c, k).alias("filled"), (populated(c, k) & ~_in_body(F.col(c).cast("string"), F.col(body))).alias("foreign"))
        for c, k in kinds.items()
    ])
    return (
        events.select("vendor", F.inline(fields)).groupBy("vendor", "field")
        .agg(count_true(F.col("filled")).alias("populated"), count_true(F.col("foreign")).alias("substituted"))
    )


def relocated_attributes(events: DataFrame, columns: Sequence[str], body: str = "body") -> DataFrame:
    """Attributes that no column repeats: ``vendor, attr_key, events, from_line, case_variants, sample``.

    ``from_line`` counts values that stand in the message, ``case_variants`` those that equal a column
    but for case; the sample is the smallest value.
    """
    values = F.array_compact(F.array(*[F.col(c).cast("string") for c in columns]))
    each = events.select("vendor", values.alias("values"), F.col(body).alias("line"), F.explode("attrs").alias("attr_key", "value"))
    lone = each.where((F.col("value") != "") & ~F.array_contains("values", F.col("value")))
    near = F.exists("values", lambda v: F.lower(v) == F.lower(F.col("value")))
    return lone.groupBy("vendor", "attr_key").agg(
        F.count(F.lit(1)).alias("events"), count_true(_in_body(F.col("value"), F.col("line"))).alias("from_line"), count_true(near).alias("case_variants"), F.min("value").alias("sample")
    )


def review_quality(reviews: DataFrame, verdict: str = "verdict") -> DataFrame:
    """One row: reviews in total, correct, unknown and decided; ratios are NULL where nothing was decided or reviewed."""
    totals = reviews.agg(F.count(F.lit(1)).alias("total"), count_true(F.col(verdict) == "correct").alias("correct"), count_true(F.col(verdict) == "unknown").alias("unknown"))
    return totals.withColumn("decided", F.col("total") - F.col("unknown")).withColumns({
        "accuracy": F.try_divide("correct", "decided"), "unknown_ratio": F.try_divide("unknown", "total"),
    })


def ingest_health(decoded: DataFrame) -> DataFrame:
    """One row over decoded messages: how many were not UTF-8, belied their declared encoding, or had no owner."""
    return decoded.agg(
        F.count(F.lit(1)).alias("total"), count_true(F.col("encoding") != "utf-8").alias("not_utf8"), count_true(~F.col("declared_honored")).alias("mismatched"),
        count_true(F.col("owner_group") == "_unassigned").alias("unassigned"),
    )
