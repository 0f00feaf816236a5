"""Stored evidence bundles: a row for each, its findings and slices beside it, and who may read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.scope import AccessScope, all_groups_readable
from logmeridian.windows import CorrelationWindow, Instant, instant

SCHEMA_VERSION = 1
BUNDLES = (
    "bundle_id STRING, schema_version INT, gathered_at TIMESTAMP_NTZ, window_from TIMESTAMP_NTZ, window_to TIMESTAMP_NTZ, owner_groups ARRAY<STRING>, gathered_by_system BOOLEAN, "
    "findings BIGINT, content_hash STRING"
)
MOST_RECENT = 500


def save_bundle(
    findings: DataFrame, slices: DataFrame, path: str, bundle_id: str, gathered_at: Instant, window: CorrelationWindow, scope: AccessScope, content_hash: str = ""
) -> None:
    """Write findings and slices, each once, and then the bundle's row: what has no row is no bundle."""
    spark = findings.sparkSession
    for name, rows in (("findings", findings), ("slices", slices)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/bundle_id={bundle_id}")
    count = spark.read.parquet(f"{path}/findings/bundle_id={bundle_id}").agg(F.count(F.lit(1)).alias("findings"))
    row = count.select(
        F.lit(bundle_id).alias("bundle_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), instant(gathered_at).alias("gathered_at"), instant(window.start).alias("window_from"), instant(window.end).alias("window_to"),
        F.array(*[F.lit(g) for g in sorted(scope.owner_groups)]).cast("array<string>").alias("owner_groups"), F.lit(scope.unrestricted).alias("gathered_by_system"), "findings", F.lit(content_hash).alias("content_hash"),
    )
    row.write.mode("append").parquet(f"{path}/bundles")


def stored_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(f"{path}/bundles")


def recent_bundles(bundles: DataFrame, scope: AccessScope, limit: int = 50) -> DataFrame:
    """The newest bundles that ``scope`` may read, at least 1 and at most 500 of them, by time and then id."""
    readable = bundles.filter(all_groups_readable(scope, F.col("owner_groups"), F.col("gathered_by_system")))
    return readable.orderBy(F.col("gathered_at").desc(), "bundle_id").limit(min(max(limit, 1), MOST_RECENT))


def load_bundle(spark: SparkSession, path: str, bundle_id: str, scope: AccessScope) -> tuple[DataFrame, DataFrame] | None:
    """Findings and slices of a bundle; None where there is none that ``scope`` may read. Another schema version is an error."""
    bundles = stored_bundles(spark, path).filter(F.col("bundle_id") == bundle_id)
    row = recent_bundles(bundles, scope, 1).first()
    if row is None:
        return None
    if row["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"bundle {bundle_id} has schema version {row['schema_version']}, not {SCHEMA_VERSION}")
    return spark.read.parquet(f"{path}/findings/bundle_id={bundle_id}"), spark.read.parquet(f"{path}/slices/bundle_id={bundle_id}")
