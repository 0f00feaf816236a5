"""Configuration snapshots: unchanged ones, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_states(snapshots: DataFrame) -> DataFrame:
    """``(connector, taken_at, id, sha, state)`` of snapshots ``(connector, taken_at, id, text)``.

    A snapshot is ``baseline`` if it is its connector's first, ``unchanged`` if its text equals the one
    before, else ``changed``. Only digests are sorted, never texts.
    """
    digests = snapshots.select("connector", "taken_at", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    before = F.lag("sha").over(Window.partitionBy("connector").orderBy("taken_at", "id"))
    return digests.withColumn("before", before).select(
        "connector", "taken_at", "id", "sha", F.when(F.col("before").isNull(), "baseline").when(F.col("before") == F.col("sha"), "unchanged").otherwise("changed").alias("state")
    )


def config_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines ``(id, line)`` of one side that the other has fewer times: ``(id, line, removed, added)``.

    Both sides are counted in one aggregation, so no line is ever joined with another.
    """
    both = before.select("id", "line", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("id", "line", F.lit(0).alias("b"), F.lit(1).alias("a")))
    net = both.groupBy("id", "line").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).where("a <> b")
    return net.select("id", "line", F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("removed"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("added"))
