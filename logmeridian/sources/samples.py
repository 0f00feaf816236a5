"""Golden sample files of log lines, and how well parsers do on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.functions.exprs import count_true
from logmeridian.operators import parse


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, body``: one message for each line that is neither blank nor a comment (``#``)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file"), F.regexp_replace("value", "\r+$", "").alias("body"))
    return lines.filter((F.trim("body") != "") & ~F.ltrim(F.col("body")).startswith("#"))


def sample_coverage(samples: DataFrame, parsers: Sequence[parse.Parser]) -> DataFrame:
    """Per file: messages parsed whole, in part and not at all, and whether none failed."""
    parsed = parse.parse_events(samples, parsers)
    status = lambda s: count_true(F.col("parse_status") == s).alias(s)
    return parsed.groupBy("file").agg(status("ok"), status("partial"), status("failed")).withColumn("passed", F.col("failed") == 0)
