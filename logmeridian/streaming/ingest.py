"""Live ingest: raw records that arrive are decoded, parsed, normalised and appended to the table of events by one streaming query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmeridian.functions.exprs import attr, empty_map
from logmeridian.functions.signature import with_signature
from logmeridian.operators import parse
from logmeridian.sources import store
from logmeridian.sources.decode import decode_text


def pipeline(records: DataFrame, parsers: Sequence[parse.Parser], inventory: DataFrame | None = None) -> DataFrame:
    """Events of raw records (``event_id, received_at, observed_at, source_key, body`` as bytes, ``attrs``); batch and stream alike.

    The same columns in the same order of steps as a replay uses. Sources are looked up in ``inventory``, a table that is read
    anew by every batch; without one, the records' own ``source_id`` and ``owner_group`` count. A record without a body has the empty text.
    """
    text = decode_text(records.withColumn("raw_", F.coalesce("body", F.lit(b""))).drop("body"), "raw_").withColumnRenamed("text", "body").drop("raw_")
    bound = None
    if inventory is not None:
        resolved = parse.resolve_sources(text, inventory, "source_key")
        text = resolved.drop("source_id", "owner_group").withColumnsRenamed({"resolved_source": "source_id", "resolved_group": "owner_group"})
    parsed = parse.normalize(parse.parse_events(text, parsers, bound=bound), "observed_at", "received_at", "source_key")
    core = lambda name: F.coalesce(F.try_element_at("core", F.lit(name)), F.lit(""))
    shaped = parsed.withColumns({
        "ts": F.col("event_ts").cast("timestamp"), "ingested_at": F.col("received_at").cast("timestamp"), "host": F.col("event_host"), "encoding_detected": F.col("encoding"),
        "src_ip": F.coalesce("src_address", F.lit("")), "dst_ip": F.coalesce(parse.mapped_address(core("dst_ip")), F.lit("")), "src_port": parse.clamped(core("src_port"), 65535), "dst_port": F.col("dst_port_number"),
        "proto": core("proto"), "action": core("action"), "outcome": core("outcome"), "user_name": core("user_name"), "vendor": core("vendor"), "product": core("product"),
        "parse_generation": F.lit(1), "attrs": F.coalesce("attributes", empty_map()),
    })
    return with_signature(shaped).drop("signature_text")


def ingest(records: DataFrame, parsers: Sequence[parse.Parser], path: str, checkpoint: str, inventory: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Append the events of arriving records to the table at ``path``, each once, whatever is lost and repeated on the way.

    A batch may come as a file or two, so its records are dealt over all cores before they are parsed.
    """
    dealt = records.repartition(records.sparkSession.sparkContext.defaultParallelism, "event_id", "received_at", "source_key")
    return store.append_stream(pipeline(dealt, parsers, inventory), path, checkpoint, **trigger)


def sampled(events: DataFrame, known: DataFrame, percent: int = 1, late: str = "1 day", at: str = "ingested_at") -> DataFrame:
    """Of arriving events those that template mining is to see: each that failed to parse and ``percent`` in a hundred of the others, the first of every signature.

    Signatures of ``known`` (``signature_hash``) are left out, and so are those that came before and are at most ``late`` old: that is what the state
    remembers. Which events count as the hundredth is told by their id, not by chance.
    """
    part = F.conv(F.substring(F.md5("event_id"), 1, 8), 16, 10).cast("long") % 100
    asked = events.filter(((F.col("parse_status") == "failed") | (part < percent)) & (F.col("signature_hash") != 0))
    unseen = asked.join(known.select("signature_hash").distinct(), "signature_hash", "left_anti")
    return unseen.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["signature_hash"])


def tags(events: DataFrame) -> DataFrame:
    """``event_id, tag`` of the parse problems that ingest noted."""
    return events.select("event_id", F.explode(F.split(attr("logmeridian.tags"), ",")).alias("tag")).filter("tag <> ''")
