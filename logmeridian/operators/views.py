"""OCSF and OpenTelemetry projections of the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmeridian.functions.exprs import utc_text
from logmeridian.scope import AccessScope, in_scope

# Fixed values: (view column, event column).
OCSF_COLUMNS = (
    ("time", "ts"),
    ("uid", "event_id"),
    ("owner_group", "owner_group"),
    ("class_uid", "ocsf_class_uid"),
    ("activity_id", "ocsf_activity_id"),
    ("severity_id", "severity_num"),
    ("src_endpoint_ip", "src_ip"),
    ("src_endpoint_port", "src_port"),
    ("dst_endpoint_ip", "dst_ip"),
    ("dst_endpoint_port", "dst_port"),
    ("connection_info_protocol_name", "proto"),
    ("activity_name", "action"),
    ("status", "outcome"),
    ("actor_user_name", "user_name"),
    ("device_hostname", "host"),
    ("device_vendor_name", "vendor"),
    ("metadata_product_name", "product"),
    ("metadata_version", "parser_version"),
    ("unmapped", "attrs"),
    ("raw_data", "body"),
    ("raw_ref", "raw_ref"),
)

OTEL_COLUMNS = (
    ("Timestamp", "ts"),
    ("ObservedTimestamp", "ingested_at"),
    ("LogRecordUID", "event_id"),
    ("owner_group", "owner_group"),
    ("Body", "body"),
    ("host.name", "host"),
    ("service.instance.id", "source_id"),
    ("service.name", "product"),
    ("device.manufacturer", "vendor"),
    ("source.address", "src_ip"),
    ("source.port", "src_port"),
    ("destination.address", "dst_ip"),
    ("destination.port", "dst_port"),
    ("network.transport", "proto"),
    ("user.name", "user_name"),
    ("Attributes", "attrs"),
    ("raw_ref", "raw_ref"),
)

#: OCSF severity (1..6) to OpenTelemetry SeverityNumber; anything else is 0.
OTEL_SEVERITY = {1: 9, 2: 13, 3: 14, 4: 17, 5: 19, 6: 21}
OCSF_SEVERITY_ALIAS = "ocsf.severity_id"


def otel_severity(column: Column) -> Column:
    scale = F.lit(0)
    for ocsf, otel in reversed(OTEL_SEVERITY.items()):
        scale = F.when(column == ocsf, otel).otherwise(scale)
    return scale


def ocsf_view(events: DataFrame) -> DataFrame:
    return events.select([F.col(source).alias(name) for name, source in OCSF_COLUMNS])


def otel_view(events: DataFrame) -> DataFrame:
    columns = [F.col(source).alias(name) for name, source in OTEL_COLUMNS]
    severity = [
        otel_severity(F.col("severity_num")).alias("SeverityNumber"),
        F.col("severity_num").alias(OCSF_SEVERITY_ALIAS),
    ]
    return events.select(columns[:4] + severity + columns[4:])


def _display(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.MapType):
        text = F.array_join(
            F.array_sort(
                F.transform(F.map_entries(value), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            ),
            ", ",
        )
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = utc_text(value)
    elif field.name.endswith("_ip") or field.name.endswith(".address"):
        text = F.regexp_replace(value, "^::ffff:", "")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def view_pairs(view: DataFrame, key: str | None = None) -> DataFrame:
    """Every column of a view row as ``(name, value)`` text, in column order."""
    fields = view.schema.fields
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), _display(f).alias("value"))
            for i, f in enumerate(fields)
        ]
    )
    kept = [F.col(f"`{key}`").alias("record_id")] if key else []
    return view.select(*kept, F.inline(pairs))


def event_view(events: DataFrame, event_id: str, scope: AccessScope, kind: str) -> DataFrame:
    """One visible event in the ``ocsf`` or ``otel`` shape, as name/value pairs."""
    shapes = {"ocsf": ocsf_view, "otel": otel_view}
    if kind not in shapes:
        raise ValueError(f"unknown view {kind!r}")
    row = events.filter(in_scope(scope) & (F.col("event_id") == event_id)).limit(1)
    return view_pairs(shapes[kind](row))
