"""The table of events: appends by day, scans, and changes that a scope may write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logmeridian.schemas import EVENT_SCHEMA
from logmeridian.scope import AccessScope, in_scope, out_of_scope

SORT = ["owner_group", "source_id", "ts"]


def conformed(events: DataFrame) -> DataFrame:
    """``events`` with exactly the columns and types of the canonical table; what is missing gets its "none" value."""
    given = {c.lower() for c in events.columns}
    out = []
    for f in StructType.fromDDL(EVENT_SCHEMA).fields:
        value = F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)
        kind = f.dataType.typeName()
        none = {"string": F.lit(""), "map": F.create_map().cast(f.dataType), "timestamp": None}.get(kind, F.lit(0).cast(f.dataType))
        out.append((value if none is None else F.coalesce(value, none)).alias(f.name))
    return events.select(out)


def _by_day(events: DataFrame) -> DataFrame:
    """A day's rows go to as many tasks as sources need, sorted so that file statistics prune by group, source and time."""
    dated = conformed(events).withColumn("event_date", F.to_date("ts"))
    return dated.repartition("event_date", "owner_group", "source_id").sortWithinPartitions("event_date", *SORT)


def append_events(events: DataFrame, path: str) -> None:
    _by_day(events).write.mode("append").partitionBy("event_date").parquet(path)


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """The canonical table; a predicate on ``event_date`` prunes days."""
    return spark.read.schema(f"{EVENT_SCHEMA}, event_date DATE").parquet(path)


def append_stream(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append arriving events by day, each exactly once: the file sink's log names the files of every batch, and readers of ``path`` follow it."""
    dated = conformed(events).withColumn("event_date", F.to_date("ts"))
    writer = dated.writeStream.format("parquet").outputMode("append").partitionBy("event_date").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def split_changes(changes: DataFrame, scope: AccessScope) -> tuple[DataFrame, DataFrame]:
    """The changes that ``scope`` may write, and those it may not (a null owner group is in no scope but the unrestricted)."""
    owned = F.coalesce(in_scope(scope), F.lit(False))
    return changes.filter(owned), changes.filter(F.coalesce(out_of_scope(scope), F.lit(not scope.unrestricted)))


def write_changes(changes: DataFrame, path: str, scope: AccessScope) -> DataFrame:
    """Append what ``scope`` may write, by month; returns the refused rows."""
    allowed, refused = split_changes(changes, scope)
    allowed.withColumn("event_month", F.date_format("ts", "yyyyMM")).write.mode("append").partitionBy("event_month").parquet(path)
    return refused
