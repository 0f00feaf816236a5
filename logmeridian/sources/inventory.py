"""Import of the source inventory from CSV files: checked line by line, all or nothing, and merged with counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.operators.ordering import numbered
from logmeridian.scope import AccessScope, in_scope
from logmeridian.windows import Instant, instant

REQUIRED = ("source_id", "owner_group")
COLUMNS = ("source_id", "owner_group", "peer_address", "hostname", "vendor", "product", "parser_id", "encoding", "source_class")
DEFAULTS = {"encoding": "auto", "source_class": "default"}
ROWS = ", ".join(f"{c} STRING" for c in COLUMNS)
ERRORS = "line BIGINT, problem STRING, detail STRING"


@dataclass(frozen=True)
class Import:
    """``rows`` (:data:`ROWS`), none where there is any of the ``errors`` (:data:`ERRORS`; line 0 is the whole text)."""

    rows: DataFrame
    errors: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: the lines of the text at ``path`` that hold something and are no comment, numbered from 1.

    Large files are read by many tasks; several files follow each other in the order of their names.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r+$", "")
    # Rows of a split come in the order of the file, so where the split begins and the row's place in its task order all.
    placed = text.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    kept = placed.filter((F.length("value") > 0) & ~F.col("value").startswith("#"))
    return numbered(kept, "line", F.col("file"), F.col("start"), F.col("place")).select("line", "value")


def check(lines: DataFrame, scope: AccessScope) -> Import:
    """Sources of numbered lines, the first of which names the columns; cells are separated by commas and trimmed.

    An error is a line with another number of cells than the header, a blank id or group, an id that an earlier line without
    these errors has, or a group outside ``scope``; each line has its first error only. Of columns that repeat, the first counts, and
    unknown ones are left out.
    """
    spark = lines.sparkSession

    def refused(problem: str, detail: str) -> Import:
        return Import(spark.createDataFrame([], ROWS), spark.createDataFrame([(0, problem, detail)], ERRORS))

    head = lines.filter("line = 1").select("value").first()
    if head is None or lines.filter("line > 1").isEmpty():
        return refused("empty", "a header and at least one line are needed")
    header = [h.strip() for h in head[0].split(",")]
    for name in REQUIRED:
        if name not in header:
            return refused("column", name)
    cells = F.split("value", ",", -1)
    cell = lambda name: F.trim(F.get(cells, F.lit(header.index(name)))) if name in header else F.lit("")
    split = lines.filter("line > 1").select("line", F.size(cells).alias("n"), *[cell(c).alias(c) for c in COLUMNS])
    shape, blank = F.col("n") != len(header), (F.col("source_id") == "") | (F.col("owner_group") == "")
    first = split.filter(~shape & ~blank).groupBy(F.col("source_id").alias("id_")).agg(F.min("line").alias("first_"))
    joined = split.join(first, F.col("source_id") == F.col("id_"), "left")
    allowed = in_scope(scope)
    problem = F.when(shape, "cells").when(blank, "blank").when(F.col("line") != F.col("first_"), "repeated").when(~allowed, "scope")
    detail = (
        F.when(shape, F.concat_ws(" of ", F.col("n").cast("string"), F.lit(str(len(header))))).when(blank, "")
        .when(F.col("line") != F.col("first_"), F.concat(F.col("source_id"), F.lit(" in line "), F.col("first_"))).otherwise(F.col("owner_group"))
    )
    judged = joined.withColumn("problem", problem)
    errors = judged.filter("problem IS NOT NULL").select("line", "problem", detail.alias("detail"))
    named = [F.when(F.col(c) != "", F.col(c)).otherwise(DEFAULTS[c]).alias(c) if c in DEFAULTS else F.col(c) for c in COLUMNS]
    rows = judged.select(*named) if errors.isEmpty() else spark.createDataFrame([], ROWS)
    return Import(rows, errors)


def _nonblank(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def upsert(inventory: DataFrame, rows: DataFrame, now: Instant) -> DataFrame:
    """The inventory after an import, with ``change``: ``created``, ``updated`` or null.

    A row replaces all imported columns of the source with its id; blank addresses, host names and parsers become null. New sources
    are enabled and created ``now``; changed ones keep both, and change their time of update.
    """
    at = instant(now)
    new = rows.select("source_id", F.struct(*[(_nonblank(F.col(c)) if c in ("peer_address", "hostname", "parser_id") else F.col(c)).alias(c) for c in COLUMNS[1:]]).alias("new_"))
    both = inventory.withColumn("known_", F.lit(True)).join(new, "source_id", "full_outer")
    change = F.when(F.col("new_").isNull(), F.lit(None)).when(F.col("known_"), "updated").otherwise("created")
    taken = {c: F.when(F.col("new_").isNotNull(), F.col(f"new_.{c}")).otherwise(F.col(c)) for c in COLUMNS[1:]}
    kept = {"enabled": F.coalesce("enabled", F.lit(True)), "created_at": F.coalesce("created_at", at), "updated_at": F.when(F.col("new_").isNotNull(), at).otherwise(F.col("updated_at"))}
    return both.withColumns({**taken, **kept, "change": change}).select(*inventory.columns, "change")


def import_counts(merged: DataFrame) -> DataFrame:
    """One row: sources created, updated, and both together."""
    count = lambda what: F.count(F.when(F.col("change") == what, F.lit(1)))
    return merged.agg(count("created").alias("created"), count("updated").alias("updated"), F.count("change").alias("rows"))
