"""Log batches in OTLP/JSON as flat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.exprs import nonblank

# Names of the protocol's fields, and the attributes that may name a source, in order.
SOURCE_KEYS = ("client.address", "net.peer.ip", "host.name", "host.id", "server.address")
_VALUE = "STRUCT<stringValue: STRING, boolValue: STRING, intValue: STRING, doubleValue: STRING, bytesValue: STRING, arrayValue: STRING, kvlistValue: STRING>"
_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {_VALUE}>>"
_RECORD = f"STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: STRING, body: {_VALUE}, attributes: {_ATTRIBUTES}>"
BATCH_SCHEMA = f"STRUCT<resourceLogs: ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTRIBUTES}>, scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<{_RECORD}>>>>>>"


def value_text(value: Column) -> Column:
    """The one value that is set, as text; nested values stay JSON."""
    return F.coalesce(*[value[f] for f in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")], F.lit(""))


def attribute_map(attributes: Column, prefix: str = "") -> Column:
    """Attributes as a map; of repeated keys the last one counts, and a missing list is an empty map."""
    entries = F.transform(attributes, lambda a: F.named_struct(F.lit("key"), F.concat(F.lit(prefix), a["key"]), F.lit("value"), value_text(a["value"])))
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    return F.coalesce(F.map_from_entries(named), F.create_map().cast("map<string,string>"))


def source_key(attributes: Column, keys: Sequence[str] = SOURCE_KEYS) -> Column:
    """The first attribute with a value among those that may name a source, each also tried with its resource prefix."""
    tried = [nonblank(F.try_element_at(attributes, F.lit(p + k))) for k in keys for p in ("", "resource.")]
    return F.coalesce(*tried, F.lit(""))


def nanos_time(nanos: Column) -> Column:
    """An instant from nanoseconds since 1970; 0 and text that is no number are none."""
    micros = F.floor(F.nullif(nanos.try_cast("decimal(20,0)"), F.lit(0)) / 1000).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def log_records(batches: DataFrame, payload: str = "payload", source_keys: Sequence[str] = SOURCE_KEYS) -> DataFrame:
    """One row per log record: the other columns of ``batches``, ``observed_at, source_key, severity_number, body, attributes``.

    Attributes of the resource get the prefix ``resource.``; those of the record win. Payloads that are no
    such JSON, and batches without records, give no rows. A deployment's own attribute that names the
    source goes first in ``source_keys``. The map settings of
    :func:`logmeridian.session.configure` must be in force.
    """
    others = [c for c in batches.columns if c != payload]
    resources = batches.select(*others, F.explode(F.from_json(payload, BATCH_SCHEMA)["resourceLogs"]).alias("r_"))
    scopes = resources.select(*others, attribute_map(F.col("r_.resource.attributes"), "resource.").alias("shared_"), F.explode("r_.scopeLogs").alias("s_"))
    records = scopes.select(*others, "shared_", F.explode("s_.logRecords").alias("l_"))
    flat = records.withColumn("attributes", F.map_concat("shared_", attribute_map(F.col("l_.attributes"))))
    severity = F.coalesce(F.col("l_.severityNumber").try_cast("int"), F.lit(0))
    return flat.select(
        *others,
        F.coalesce(nanos_time(F.col("l_.timeUnixNano")), nanos_time(F.col("l_.observedTimeUnixNano"))).alias("observed_at"),
        source_key(F.col("attributes"), source_keys).alias("source_key"),
        F.greatest(F.least(severity, F.lit(255)), F.lit(0)).alias("severity_number"),
        value_text(F.col("l_.body")).alias("body"),
        "attributes",
    )
