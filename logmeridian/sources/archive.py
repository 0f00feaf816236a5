"""The archive of raw records: compressed NDJSON objects, a manifest of what was committed, reading and checking.

A write makes a batch: one file for each object, under ``batch=../owner_group=../year=../month=../day=../hour=../source_class=../object=..``.
Its manifest is made from the files as they lie there, and appended last; objects of a batch that is not in the
manifest do not exist for readers. Owner groups are read from paths, so what a scope forbids is never opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmeridian.operators.ranges import overlap_join
from logmeridian.scope import AccessScope, in_scope
from logmeridian.windows import Instant, instant

OBJECT_BYTES = 64 << 20
RAW = (
    "event_id STRING, received_at TIMESTAMP, observed_at TIMESTAMP, source_key STRING, source_id STRING, owner_group STRING, "
    "transport STRUCT<proto: STRING, peer: STRING>, encoding_declared STRING, severity_number INT, attrs MAP<STRING,STRING>, raw_b64 STRING"
)
#: What :func:`read_records` gives.
RECORDS = RAW.replace("raw_b64 STRING", "body BINARY") + ", source_class STRING, object_key STRING"
MANIFEST = (
    "object_key STRING, owner_group STRING, sha256 STRING, byte_size BIGINT, event_count BIGINT, ts_from TIMESTAMP, ts_to TIMESTAMP, "
    "state STRING, last_scrubbed_at TIMESTAMP, batch STRING"
)
PARTS = ["owner_group", "year", "month", "day", "hour", "source_class", "object"]
UPLOADED, VERIFIED, MISMATCH, MISSING = "Uploaded", "Verified", "ChecksumMismatch", "Missing"
SCRUB_OBJECTS = 50
LOCATE_OBJECTS = 8


def raw_lines(records: DataFrame) -> DataFrame:
    """One JSON text per record, the body in base64; null and empty members are left out."""
    body = F.base64(F.col("body")).alias("raw_b64")
    kept = F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs")
    severity = F.when(F.col("severity_number") != 0, F.col("severity_number")).alias("severity_number")
    fields = ["event_id", "received_at", "observed_at", "source_key", "source_id", "owner_group", "transport", "encoding_declared", severity, kept, body]
    at = F.coalesce("observed_at", "received_at")
    return records.select(
        "event_id", at.alias("at"), F.col("owner_group"), "source_class", F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timeZone": "UTC"}).alias("value")
    )


def write_batch(records: DataFrame, root: str, object_bytes: int = OBJECT_BYTES) -> str:
    """Write ``records`` (:data:`RAW` with ``body`` for ``raw_b64``, and ``source_class``) as a new batch; returns its name.

    Objects hold about ``object_bytes`` of text each: the records of an owner group, hour and source class are dealt over as
    many objects as their bytes need. Null or empty groups and classes are written as ``_unassigned`` and ``default``.
    """
    lines = raw_lines(records).withColumns({
        "owner_group": F.when(F.trim(F.coalesce("owner_group", F.lit(""))) == "", "_unassigned").otherwise(F.regexp_replace("owner_group", "^/+|/+$", "")),
        "source_class": F.when(F.trim(F.coalesce("source_class", F.lit(""))) == "", "default").otherwise(F.col("source_class")),
        "year": F.date_format("at", "yyyy"), "month": F.date_format("at", "MM"), "day": F.date_format("at", "dd"), "hour": F.date_format("at", "HH"),
    })
    hour = PARTS[:-1]
    sizes = lines.groupBy(*hour).agg(F.ceil(F.sum(F.length("value").cast("long") + 1) / object_bytes).cast("int").alias("objects"))
    dealt = lines.join(sizes, hour).withColumn("object", F.pmod(F.xxhash64("event_id"), F.col("objects")).cast("int")).drop("objects")
    batch = uuid.uuid4().hex
    ordered = dealt.repartition(*PARTS).sortWithinPartitions(*PARTS, "at", "event_id").select(*PARTS, "value")
    ordered.write.partitionBy(*PARTS).option("compression", "gzip").text(f"{root}/objects/batch={batch}")
    return batch


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _part(path: Column, name: str) -> Column:
    """The value of a directory of that name; paths escape what a file system does not take."""
    return _decoded(F.regexp_extract(path, f"/{name}=([^/]*)/", 1))


def _file() -> Column:
    """The path of a row's file as the file system has it."""
    return _decoded(F.col("_metadata.file_path"))


def owner_of(path: Column) -> Column:
    """The owner group in an object's path; null where the path is not that of an object."""
    whole = "/" + "/".join(["batch=[^/]+", "owner_group=[^/]+", "year=[0-9]+", "month=[0-9]+", "day=[0-9]+", "hour=[0-9]+", "source_class=[^/]+", "object=[0-9]+", "[^/]+$"])
    return F.when(path.rlike(whole), _part(path, "owner_group"))


def object_key(path: Column) -> Column:
    """The part of a path that names an object within its archive."""
    return F.regexp_extract(path, "(batch=.*)$", 1)


def raw_ref(batch: Column, owner_group: Column, at: Column, source_class: Column) -> Column:
    """The directory of the objects that may hold a record: what an event remembers of its raw line."""
    return F.concat(F.lit("batch="), batch, F.lit("/owner_group="), F.url_encode(owner_group), F.date_format(at, "'/year='yyyy'/month='MM'/day='dd'/hour='HH'/source_class='"), F.url_encode(source_class), F.lit("/"))


def directory_of(key: Column) -> Column:
    """``raw_ref`` of an object's records, with its names in the spelling of :func:`raw_ref`."""
    again = lambda name: F.url_encode(_part(F.concat(F.lit("/"), key), name))
    times = F.regexp_extract(key, "(/year=.*/source_class=)", 1)
    return F.concat(F.regexp_extract(key, "(batch=[^/]+/owner_group=)", 1), again("owner_group"), times, again("source_class"), F.lit("/"))


def _objects(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").option("timeZone", "UTC").option("recursiveFileLookup", "true").json(path)


def batch_manifest(spark: SparkSession, root: str, batch: str) -> DataFrame:
    """:data:`MANIFEST` rows of a batch, from its files: counts and times from the lines, hash and size from the bytes as they lie."""
    path = f"{root}/objects/batch={batch}"
    at = F.coalesce("observed_at", "received_at")
    lines = _objects(spark, path, "observed_at TIMESTAMP, received_at TIMESTAMP").select(_file().alias("path"), at.alias("at"))
    counted = lines.groupBy(object_key(F.col("path")).alias("object_key")).agg(F.count(F.lit(1)).alias("event_count"), F.min("at").alias("ts_from"), F.max("at").alias("ts_to"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    hashed = files.select(object_key(F.col("path")).alias("object_key"), owner_of(F.col("path")).alias("owner_group"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"))
    return hashed.join(counted, "object_key").select(
        "object_key", "owner_group", "sha256", "byte_size", "event_count", "ts_from", "ts_to", F.lit(UPLOADED).alias("state"), F.lit(None).cast("timestamp").alias("last_scrubbed_at"), F.lit(batch).alias("batch")
    )


def commit(records: DataFrame, root: str, object_bytes: int = OBJECT_BYTES) -> DataFrame:
    """Write a batch and then its manifest; returns the manifest of the whole archive."""
    spark = records.sparkSession
    batch = write_batch(records, root, object_bytes)
    batch_manifest(spark, root, batch).write.mode("append").parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_records(spark: SparkSession, root: str, scope: AccessScope, objects: DataFrame | None = None, start: Instant | None = None, end: Instant | None = None) -> DataFrame:
    """Records of the committed batches that ``scope`` may see, with ``body`` decoded, ``source_class`` and ``object_key``.

    Scope and whole hours of ``start`` to ``end`` prune directories before any file is listed as work; ``objects`` (``object_key``) leaves only the
    records of these. The times are those of arrival in the record, ``observed_at`` before ``received_at``.
    """
    batches = sorted(r["batch"] for r in manifest(spark, root).select("batch").distinct().collect())  # one for each write
    parts = ", ".join(f"{c} STRING" for c in ["batch", *PARTS])
    if not batches:
        return spark.createDataFrame([], RECORDS)
    raw = spark.read.schema(f"value STRING, {parts}").text(f"{root}/objects")
    visible = raw.filter(F.col("batch").isin(batches) & in_scope(scope))
    hour = F.concat("year", "month", "day", "hour")
    if start is not None:
        visible = visible.filter(hour >= F.date_format(instant(start), "yyyyMMddHH"))
    if end is not None:
        visible = visible.filter(hour <= F.date_format(instant(end), "yyyyMMddHH"))
    keyed = visible.select("value", "source_class", object_key(_file()).alias("object_key"))
    if objects is not None:
        keyed = keyed.join(objects.select("object_key").distinct(), "object_key", "left_semi")
    record = F.from_json("value", RAW, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timeZone": "UTC"})
    flat = keyed.withColumn("r", record).select("r.*", "source_class", "object_key")
    at = F.coalesce("observed_at", "received_at")
    if start is not None:
        flat = flat.filter(at >= instant(start))
    if end is not None:
        flat = flat.filter(at < instant(end))
    return flat.withColumn("raw_b64", F.unbase64("raw_b64")).withColumnRenamed("raw_b64", "body")


def readable(objects: DataFrame, scope: AccessScope) -> DataFrame:
    """Objects (``object_key``) whose path names a group in ``scope``; a path that names none is out of everybody's but the system's."""
    owned = objects.withColumn("owner_", owner_of(F.concat(F.lit("/"), F.col("object_key"))))
    return owned.filter(F.col("owner_").isNotNull() & in_scope(scope, column="owner_")).drop("owner_")


def overlapping(objects: DataFrame, ranges: DataFrame) -> DataFrame:
    """Objects of a manifest for each of ``ranges`` (``range_id, starts_at, ends_at``, half-open): those with a record in it, or between two."""
    spans = ranges.select("range_id", "starts_at", "ends_at").filter("starts_at < ends_at")
    micro = F.expr("INTERVAL 1 MICROSECOND")
    return overlap_join(objects, spans, (F.col("ts_from"), F.col("ts_to")), (F.col("starts_at"), F.col("ends_at") - micro))


def present(spark: SparkSession, root: str, objects: DataFrame) -> DataFrame:
    """``objects`` with ``exists``: whether the file lies in the archive. Only names are listed, nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{root}/objects")
    keys = listed.select(object_key(F.col("path")).alias("object_key")).withColumn("exists", F.lit(True))
    return objects.join(keys, "object_key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def scrub(spark: SparkSession, root: str, objects: DataFrame, now: Instant, most: int = SCRUB_OBJECTS) -> DataFrame:
    """The manifest after a check of the ``most`` objects that were checked longest ago, never checked ones first.

    Objects already missing are passed over. A file that is gone makes its object ``Missing``; one that holds other bytes than those
    written, or that its storage cannot read, makes it ``ChecksumMismatch``, equal bytes make it ``Verified``. Only the chosen files are read.
    """
    chosen = objects.filter(F.col("state") != MISSING).orderBy(F.col("last_scrubbed_at").asc_nulls_first(), "object_key").limit(most).select("object_key")
    checked = present(spark, root, chosen).collect()  # at most ``most``
    found = [f"{root}/objects/{r['object_key']}" for r in checked if r["exists"]]
    asked = spark.createDataFrame([(r["object_key"], r["exists"]) for r in checked], "object_key STRING, exists BOOLEAN")
    if found:
        files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(found).select(object_key(F.col("path")).alias("object_key"), F.sha2("content", 256).alias("found"))
    else:
        files = spark.createDataFrame([], "object_key STRING, found STRING")
    state = F.when(F.col("exists").isNull(), F.col("state")).when(~F.col("exists"), MISSING).when(F.col("found") == F.col("sha256"), VERIFIED).otherwise(MISMATCH)
    joined = objects.join(asked, "object_key", "left").join(files, "object_key", "left")
    last = F.when(F.col("exists").isNotNull(), instant(now).cast("timestamp")).otherwise(F.col("last_scrubbed_at"))
    return joined.withColumn("state", state).withColumn("last_scrubbed_at", last).select(objects.columns)


def archive_states(objects: DataFrame) -> DataFrame:
    """One row: objects, those in each state, records, and whether all objects are verified (of none, they are not)."""
    count = lambda state: F.count(F.when(F.col("state") == state, F.lit(1)))
    return objects.agg(
        F.count(F.lit(1)).alias("objects"), count(UPLOADED).alias("uploaded"), count(VERIFIED).alias("verified"), count(MISMATCH).alias("mismatched"), count(MISSING).alias("missing"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("records"), F.coalesce(F.bool_and(F.col("state") == VERIFIED), F.lit(False)).alias("all_verified"),
    )


def locate(spark: SparkSession, root: str, events: DataFrame, objects: DataFrame, scope: AccessScope, most: int = LOCATE_OBJECTS) -> DataFrame:
    """The raw record of each of ``events`` (``event_id, ts, raw_ref``): its columns, ``object_key``, and ``scanned``, the object's place.

    Candidates are the objects under ``raw_ref`` that are not missing and whose times, give or take a millisecond (events keep no
    more), hold the event's; the first ``most`` by time are looked into. Events without a record there have no row.
    """
    milli = F.expr("INTERVAL 1 MILLISECOND")
    under = readable(objects.filter(F.col("state") != MISSING), scope).select("object_key", "ts_from", "ts_to", directory_of(F.col("object_key")).alias("raw_ref"))
    asked = events.select(F.col("event_id").alias("asked_id"), F.col("ts").cast("timestamp").alias("at"), "raw_ref")
    met = overlap_join(asked, under, (F.col("at") - milli, F.col("at") + milli), (F.col("ts_from"), F.col("ts_to")), on=("raw_ref",))
    ranked = F.row_number().over(Window.partitionBy("asked_id").orderBy("ts_from", "object_key"))
    few = met.withColumn("scanned", ranked).filter(F.col("scanned") <= most).select("asked_id", F.col("object_key").alias("key_"), "scanned")
    records = read_records(spark, root, scope, few.select(F.col("key_").alias("object_key")))
    found = few.join(records, (F.col("asked_id") == F.col("event_id")) & (F.col("key_") == F.col("object_key")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("asked_id").orderBy("scanned"))).filter("place = 1").drop("asked_id", "key_", "place")
