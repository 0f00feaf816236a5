"""Replay of history: field-level difference, merge, report and affected partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.exprs import TEXT_MAP, count_true
from logmeridian.scope import AccessScope
from logmeridian.sources import archive
from logmeridian.windows import Instant, between, to_instant


#: Fields that a difference names, in this order; ingest time and generation change with every replay and are left out.
FIELDS = (
    "parse_status", "parser_id", "parser_version", "host", "vendor", "product", "proto", "action", "outcome", "user_name", "src_ip", "dst_ip", "src_port", "dst_port",
    "severity_num", "ocsf_class_uid", "ts", "signature_hash", "time_source",
)
SAMPLES = 20


def attr_changes(old: Column, new: Column) -> Column:
    """``field, before, after`` of every key of two maps whose values differ, a missing key being empty; fields are named ``attrs.key``."""
    none = F.create_map().cast(TEXT_MAP)
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    value = lambda side, k: F.coalesce(F.try_element_at(side, k), F.lit(""))
    pairs = F.transform(
        F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: F.struct(F.concat(F.lit("attrs."), k).alias("field"), value(old, k).alias("before"), value(new, k).alias("after"))
    )
    return F.filter(pairs, lambda p: p["before"] != p["after"])


def diff(existing: DataFrame, rebuilt: DataFrame, fields: Sequence[str] = FIELDS, key: str = "event_id", attrs: str | None = None) -> DataFrame:
    """Rebuilt rows with ``state`` (new, changed, unchanged), ``changes`` and both parse statuses.

    Nulls compare as empty texts. With ``attrs``, the name of a map column, its keys are compared one by one. Of several existing
    rows with a rebuilt row's key, each gives a row.
    """
    named = [*fields, *([attrs] if attrs else []), *(["parse_status"] if "parse_status" not in fields else [])]
    old = existing.select(key, F.struct(*named).alias("old"))
    joined = rebuilt.select(key, F.struct(*named).alias("new")).join(old, key, "left")
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text("old", f).alias("before"), text("new", f).alias("after")) for f in fields])
    found = F.filter(pairs, lambda p: p["before"] != p["after"])
    if attrs:
        found = F.concat(found, attr_changes(F.col(f"old.{attrs}"), F.col(f"new.{attrs}")))
    changes = F.when(F.col("old").isNotNull(), found).otherwise(F.slice(pairs, 1, 0))
    return joined.withColumn("changes", changes).select(
        key,
        F.when(F.col("old").isNull(), "new").when(F.size("changes") > 0, "changed").otherwise("unchanged").alias("state"),
        "changes",
        F.col("old.parse_status").alias("status_before"),
        F.col("new.parse_status").alias("status_after"),
    )


def report(changed: DataFrame) -> DataFrame:
    """Counts of a difference. ``failed_to_ok`` are changed rows that failed before and do not now, ``ok_to_failed`` the reverse; partial is not failed."""
    was, is_ = F.col("status_before") == "failed", F.col("status_after") == "failed"
    state = lambda s: F.col("state") == s
    return changed.agg(
        F.count(F.lit(1)).alias("replayed"), count_true(state("new")).alias("added"), count_true(state("changed")).alias("changed"), count_true(state("unchanged")).alias("unchanged"),
        count_true(state("changed") & was & ~is_).alias("failed_to_ok"), count_true(state("changed") & ~was & is_).alias("ok_to_failed"),
    )


def samples(changed: DataFrame, most: int = SAMPLES, key: str = "event_id") -> DataFrame:
    """The first ``most`` changed rows by key, with their changes."""
    return changed.filter("state = 'changed'").orderBy(key).limit(most).select(key, "status_before", "status_after", "changes")


def changes_per_field(changed: DataFrame) -> DataFrame:
    return changed.select(F.explode("changes").alias("c")).groupBy(F.col("c.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


def merge(existing: DataFrame, rebuilt: DataFrame, key: str = "event_id") -> DataFrame:
    """Rebuilt rows replace existing ones of the same id; the others are copied."""
    return rebuilt.unionByName(existing.join(rebuilt.select(key), key, "left_anti"))


def partitions(events: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Day partitions present in a range, with their row counts."""
    return events.filter(between("ts", start, end)).groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def open_days(days: DataFrame, now: Instant) -> DataFrame:
    """Of ``day`` (yyyyMMdd) those that are still written to: that of ``now`` and later ones."""
    return days.filter(F.col("day") >= to_instant(now).strftime("%Y%m%d"))


def replace_days(merged: DataFrame, path: str, partition: str = "event_date") -> None:
    """Overwrite exactly the day partitions that ``merged`` holds; all others stay. Files of all days are swapped when the job commits."""
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


@dataclass(frozen=True)
class ReplayPlan:
    start: Instant
    end: Instant
    owner_groups: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    allow_open: bool = False
    continue_on_missing: bool = False


@dataclass(frozen=True)
class Replay:
    """What a replay found. ``changed`` and ``merged`` are None where missing objects stopped it."""

    days: DataFrame
    skipped: DataFrame
    missing: DataFrame
    changed: DataFrame | None = None
    merged: DataFrame | None = None
    """The rows of the replayed days as they are to be."""


def prepare(
    plan: ReplayPlan, root: str, objects: DataFrame, events: DataFrame, rebuild: Callable[[DataFrame], DataFrame], now: Instant, fields: Sequence[str] = FIELDS, attrs: str | None = "attrs"
) -> Replay:
    """A replay of the records of ``root`` in ``plan`` against the table ``events``: a dry run, and what an apply would write.

    ``objects`` is the manifest; those that overlap the plan's time but lie no longer in the archive are ``missing`` and stop it,
    unless the plan goes on. ``rebuild`` makes events of records, one for each. Days that are still written to are skipped,
    with the rebuilt rows that fall on them, unless the plan allows them. Existing rows are those of the whole days that the plan touches.
    """
    spark = events.sparkSession
    days = partitions(events, plan.start, plan.end).select("day")
    skipped = days.limit(0) if plan.allow_open else open_days(days, now)
    chosen = days.join(skipped, "day", "left_anti")
    asked = spark.createDataFrame([(0, to_instant(plan.start), to_instant(plan.end))], "range_id int, starts_at timestamp_ntz, ends_at timestamp_ntz")
    mine = objects.filter(F.col("owner_group").isin(list(plan.owner_groups))) if plan.owner_groups else objects
    there = archive.present(spark, root, archive.overlapping(mine, asked).select("object_key"))
    missing = there.filter("NOT exists").select("object_key")
    if not plan.continue_on_missing and not missing.isEmpty():
        return Replay(chosen, skipped, missing)
    records = archive.read_records(spark, root, AccessScope.system(), there.filter("exists"), plan.start, plan.end)
    rebuilt = rebuild(records)
    for column, wanted in (("owner_group", plan.owner_groups), ("source_id", plan.source_ids)):
        rebuilt = rebuilt.filter(F.col(column).isin(list(wanted))) if wanted else rebuilt
    day = F.date_format("ts", "yyyyMMdd")
    rebuilt = rebuilt.withColumn("day_", day).join(skipped.withColumnRenamed("day", "day_"), "day_", "left_anti").drop("day_")
    existing = events.withColumn("day_", day).join(chosen.withColumnRenamed("day", "day_"), "day_", "left_semi").drop("day_")
    # Rebuilt rows on days without any row yet are compared as new, but no partition of theirs is replaced.
    kept = rebuilt.withColumn("day_", day).join(chosen.withColumnRenamed("day", "day_"), "day_", "left_semi").drop("day_")
    return Replay(chosen, skipped, missing, diff(existing, rebuilt, fields, attrs=attrs), merge(existing, kept))
