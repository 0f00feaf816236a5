"""The generic warehouse tables seen as canonical log tables.

Everything is a projection of the given rows, so filters on ``ts`` still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.functions.exprs import TEXT_MAP
from logmeridian.functions.signature import with_signature


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(index, *values):
    """The value at ``index``, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def event_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events without a signature: what a query that never groups by message needs."""
    user, eid = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = user % 3
    return (
        table(spark, folder, "events")
        .withColumn("k", k)
        .select(
            eid.cast("string").alias("event_id"),
            F.col("ts"),
            F.expr("ts + make_dt_interval(0, 0, 0, event_id % 5)").alias("ingested_at"),
            F.when(eid % 10 == 0, "observed").otherwise("parsed").alias("time_source"),
            F.concat(F.lit("grp_"), user % 4).alias("owner_group"),
            F.concat(F.lit("src_"), user).alias("source_id"),
            F.concat(F.lit("host_"), user % 7).alias("host"),
            _pick(kind, "Cisco", "Fortinet", "NGINX").alias("vendor"),
            _pick(kind, "ASA", "FortiGate", "nginx").alias("product"),
            _pick(kind, "asa.network", "fortigate.traffic", "nginx.combined").alias("parser_id"),
            F.lit("1.0.0").alias("parser_version"),
            F.when(eid % 20 == 0, "failed").when(eid % 20 == 1, "partial").otherwise("ok").alias("parse_status"),
            F.lit(1).cast("bigint").alias("parse_generation"),
            F.lit("utf-8").alias("encoding_detected"),
            F.lit("").alias("template_id"),
            F.when(F.col("event_type") == "error", 4).otherwise(1).cast("smallint").alias("severity_num"),
            _pick(kind, 4001, 3002, 4002).cast("bigint").alias("ocsf_class_uid"),
            (F.col("k") % 7).alias("ocsf_activity_id"),
            F.concat(F.lit("10.0."), user % 256, F.lit("."), F.col("k")).alias("src_ip"),
            F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("192.0.2."), F.col("k"))).alias("dst_ip"),
            (F.col("k") + 1024).alias("src_port"),
            _pick(F.col("k") % 4, 443, 22, 8291, 53).alias("dst_port"),
            F.when(F.col("k") % 3 == 0, "udp").otherwise("tcp").alias("proto"),
            F.col("event_type").alias("action"),
            F.when(F.col("event_type") == "error", "failure")
            .when(F.col("event_type") == "purchase", "success")
            .otherwise("")
            .alias("outcome"),
            F.when(F.col("k") % 2 == 0, F.concat(F.lit("user"), user)).otherwise("").alias("user_name"),
            F.create_map(
                F.lit("k"), F.col("k").cast("string"), F.lit("otel.url.path"), F.concat(F.lit("/p/"), F.col("k") % 10)
            ).alias("attrs"),
            F.concat(
                F.col("event_type"),
                F.lit(" op_k"),
                F.col("k"),
                F.lit(" user "),
                user,
                F.lit(" value "),
                F.col("value"),
            ).alias("body"),
            F.concat(
                F.lit("raw/grp_"), user % 4, F.lit("/"), F.date_format("ts", "yyyy/MM/dd/HH"), F.lit("/default/")
            ).alias("raw_ref"),
        )
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events with masked text and signature."""
    return with_signature(event_columns(spark, folder))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a change feed spread over January 2024."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, o_orderkey % 43200, 0)").alias("ts"),
        key.cast("string").alias("change_id"),
        F.concat(F.lit("grp_"), F.col("o_custkey") % 4).alias("owner_group"),
        _pick(key % 5, "device", "service", "config", "rule", "host").alias("target_kind"),
        F.concat(F.lit("src_"), F.col("o_custkey") % 150).alias("target_id"),
        F.substring("o_orderpriority", 3, 20).alias("change_kind"),
        F.concat(F.lit("team_"), F.col("o_orderstatus")).alias("actor"),
        F.concat(F.lit("order "), key).alias("summary"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).cast(TEXT_MAP).alias("details"),
        F.lit("orders").alias("source"),
        F.lit("").alias("external_ref"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a source inventory; some sources never send anything."""
    key = F.col("c_custkey")
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("src_"), key).alias("source_id"),
        F.concat(F.lit("10.1."), F.floor(key / 256) % 256, F.lit("."), key % 256).alias("peer_address"),
        F.concat(F.lit("Dev-"), key, F.lit(".example.net")).alias("hostname"),
        F.concat(F.lit("grp_"), key % 4).alias("owner_group"),
        _pick(key % 3, "Cisco", "Fortinet", "NGINX").alias("vendor"),
        _pick(key % 3, "ASA", "FortiGate", "nginx").alias("product"),
        F.when(key % 2 == 0, _pick(key % 3, "asa.network", "fortigate.traffic", "nginx.combined")).alias("parser_id"),
        F.lit("auto").alias("encoding"),
        F.lower("c_mktsegment").alias("source_class"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
