"""Joins of intervals that overlap, as equi joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bucket widths in microseconds: from one second on, each four times the one before; the last holds thousands of years.
WIDTHS = tuple(1_000_000 * 4**i for i in range(20))


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def level_of(first: Column, last: Column) -> Column:
    """The least width that is not exceeded, so that an interval lies in at most two of its buckets."""
    level = F.lit(len(WIDTHS) - 1)
    for i in reversed(range(len(WIDTHS) - 1)):
        level = F.when(last - first < WIDTHS[i], i).otherwise(level)
    return level


def _levels(rows: DataFrame) -> set[int]:
    return {r["level_"] for r in rows.select("level_").distinct().collect()}  # at most as many as there are widths


def _bucketed(rows: DataFrame, levels: set[int], first: str, last: str, bucket: str) -> DataFrame:
    """A row for each bucket that an interval touches, at its own width and at the wider ones that are in use."""
    widths = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(WIDTHS[i]).alias("width")) for i in sorted(levels)])
    used = F.filter(widths, lambda w: w["at"] >= F.col("level_"))
    spans = F.flatten(F.transform(used, lambda w: F.transform(
        F.sequence(F.floor(F.col(first) / w["width"]), F.floor(F.col(last) / w["width"])), lambda b: F.struct(w["at"].alias("at"), w["width"].alias("width"), b.alias("number"))
    )))
    return rows.withColumn(bucket, F.explode(spans))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose closed intervals of instants overlap and that agree in the columns ``on``.

    An interval is entered in the buckets that it touches, of a width in proportion to its length, so in two at most, and
    also in those of each greater width that the other side uses; two intervals meet at the greater of their two
    widths, in the first bucket they share, so once. The columns of the two sides must differ but for ``on``; rows with
    a null or reversed interval, or with nulls in ``on``, meet nothing. A side's rows with equal or
    touching buckets are dealt over tasks by ``on`` and bucket; skewed buckets are split by the engine.
    """

    def prepared(df: DataFrame, span: tuple[Column, Column], a: str, b: str) -> DataFrame:
        timed = df.withColumn(a, micros(span[0])).withColumn(b, micros(span[1])).filter(F.col(a) <= F.col(b))
        return timed.withColumn("level_", level_of(F.col(a), F.col(b)))

    one, two = prepared(left, left_span, "a1_", "b1_"), prepared(right, right_span, "a2_", "b2_")
    first, second = _levels(one), _levels(two)
    levels = {max(x, y) for x in first for y in second} or {0}
    one = _bucketed(one, levels, "a1_", "b1_", "s1_").withColumnRenamed("level_", "l1_")
    two = _bucketed(two, levels, "a2_", "b2_", "s2_").withColumnRenamed("level_", "l2_")
    two = two.withColumnsRenamed({c: f"{c}__" for c in on})
    met = (F.col("s1_.at") == F.col("s2_.at")) & (F.col("s1_.number") == F.col("s2_.number"))
    for c in on:
        met &= F.col(c) == F.col(f"{c}__")
    common = F.greatest(F.floor(F.col("a1_") / F.col("s1_.width")), F.floor(F.col("a2_") / F.col("s1_.width")))
    exact = (F.col("s1_.at") == F.greatest("l1_", "l2_")) & (F.col("s1_.number") == common) & (F.col("a1_") <= F.col("b2_")) & (F.col("a2_") <= F.col("b1_"))
    joined = one.join(two, met & exact)
    return joined.drop("a1_", "b1_", "a2_", "b2_", "l1_", "l2_", "s1_", "s2_", *[f"{c}__" for c in on])
