"""Queries on templates, archives, replay, silence, inventory imports and evidence of many triggers, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from logmeridian.functions import addresses
from logmeridian.functions.exprs import TEXT_MAP, attr
from logmeridian.functions.signature import unsigned_text
from logmeridian.functions import steps as S
from logmeridian.operators import alerts, correlate, detect, fragments, health, parse, preview, replay, search, templates, views
from logmeridian.parsing_queries import _PARSED, PARSERS, _lines
from logmeridian.plans import bundles, evidence, triggers
from logmeridian.queries import _CHANGES, ALL, MONTH, SOME, WINDOW, _ev, _inputs, _query
from logmeridian.schemas import LIFT_FIELDS
from logmeridian.scope import AccessScope, all_groups_readable
from logmeridian.session import checkpoint_dir
from logmeridian.sources import adapt, archive, inventory, samples, store
from logmeridian.streaming import ingest, live
from logmeridian.windows import CorrelationWindow, EventQuery

_FIRST_TYPES = ("click", "error", "view")


def _signatures(events):
    return events.groupBy(F.col("vendor").alias("source_class"), F.col("signature_text").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def _runs(spark, folder):
    """Events, and the templates after two runs: one that sees three types of events, and one that sees all the others."""
    events = adapt.events(spark, folder)
    early = F.col("action").isin(*_FIRST_TYPES)
    first = templates.mine_templates(_signatures(events.filter(early)))
    return events, first, templates.mine_templates(_signatures(events.filter(~early)), first)


_EARLY = "action IN ('click', 'error', 'view')"
_TEMPLATES = f"""t AS (SELECT vendor, action, count(*) AS size, row_number() OVER (PARTITION BY vendor ORDER BY NOT ({_EARLY}), action) AS cluster_id FROM ev GROUP BY vendor, action),
tp AS (SELECT vendor || ':' || cluster_id AS template_id, vendor AS source_class, cluster_id, action, action || ' <*> user <NUMBER> value <NUMBER>' AS template, size, NOT ({_EARLY}) AS is_new FROM t)"""


@_query("template_mining", _ev(f", {_TEMPLATES} SELECT template_id, source_class, cluster_id, template, size, 'NUMBER' AS masks, is_new FROM tp"))
def _mining(spark, folder):
    """Two runs: templates of the first keep their ids and sizes in the second."""
    return _runs(spark, folder)[2].withColumn("masks", F.array_join("mask_names", ",")).drop("mask_names")


@_query("template_annotation", _ev(f", {_TEMPLATES} SELECT template_id, source_id, count(*) AS events FROM ev JOIN tp ON tp.source_class = ev.vendor AND tp.action = ev.action GROUP BY ALL"))
def _annotation(spark, folder):
    events, _, mined = _runs(spark, folder)
    return templates.annotate(events, mined).groupBy("template_id", "source_id").agg(F.count(F.lit(1)).alias("events"))


@_query("discovery_sample", _ev(f"SELECT event_id, parse_status FROM ev WHERE NOT ({_EARLY}) AND (parse_status = 'failed' OR ('0x' || substr(md5(event_id), 1, 8))::BIGINT % 100 < 5)"))
def _sample(spark, folder):
    events, first, _ = _runs(spark, folder)
    return templates.discovery_sample(events, first, percent=5).select("event_id", "parse_status")


def _stream(spark, folder, name):
    """A table read as a stream; the pattern stands for its single file."""
    return spark.readStream.schema(adapt.table(spark, folder, name).schema).parquet(f"{folder}/{name}[.]parquet")


_SILENT = 4 * 3600


@_query("live_silence", f"""WITH inv AS (SELECT 'src_' || c_custkey AS source_id, 'grp_' || (c_custkey % 4) AS owner_group, TIMESTAMP '2024-01-01' AS created_at FROM customer WHERE c_acctbal > 0),
ev AS (SELECT 'src_' || user_id AS source_id, least(ts + (event_id % 5) * INTERVAL 1 SECOND, TIMESTAMP '2024-01-29') AS came FROM events),
passed AS (SELECT date_trunc('milliseconds', max(came)) - INTERVAL 1 HOUR AS w FROM ev),
s AS (SELECT source_id, owner_group, came AS since, false AS never_seen, lead(came) OVER (PARTITION BY source_id ORDER BY came) AS next FROM ev JOIN inv USING (source_id)
  UNION ALL SELECT source_id, owner_group, created_at, true, (SELECT min(came) FROM ev WHERE ev.source_id = inv.source_id) FROM inv)
SELECT source_id, owner_group, never_seen, CASE WHEN NOT never_seen THEN since END AS last_at, since + INTERVAL {_SILENT} SECOND AS fired_at FROM s, passed
WHERE next >= since + INTERVAL {_SILENT} SECOND OR (next IS NULL AND date_trunc('milliseconds', since + INTERVAL {_SILENT} SECOND) < w)""")
def _live_silence(spark, folder):
    """Events and inventory read as streams to their end; clocks beyond January 29 count as ahead."""
    at = F.expr("ts + make_dt_interval(0, 0, 0, event_id % 5)").alias("ingested_at")
    arrivals = _stream(spark, folder, "events").select(F.concat(F.lit("src_"), F.col("user_id")).alias("source_id"), at)
    key = F.col("c_custkey")
    inventory = _stream(spark, folder, "customer").select(
        F.concat(F.lit("src_"), key).alias("source_id"), F.concat(F.lit("grp_"), key % 4).alias("owner_group"), (F.col("c_acctbal") > 0).alias("enabled"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("created_at"),
    )
    found = live.drain(live.silences(arrivals, inventory, _SILENT, now=F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'")), "silences")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_at", "fired_at")})


def _new_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hurried(spark, folder):
    """Events of a month in two and a half days, so that an hour's object holds more than a few."""
    base = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    hurried = F.timestamp_micros(base + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - base) / 12).cast("long"))
    return adapt.event_columns(spark, folder).withColumn("ts", hurried.cast("timestamp_ntz"))


def _records(spark, folder):
    """Events as raw records, observed before they were received."""
    number = F.col("event_id").cast("long")
    return _hurried(spark, folder).select(
        "event_id", F.expr("ts + make_dt_interval(0, 0, 0, 2)").cast("timestamp").alias("received_at"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("host").alias("source_key"), "source_id",
        F.when(number % 50 != 0, F.concat(F.lit("/net/"), F.col("owner_group"))).alias("owner_group"), F.struct(F.lit("udp").alias("proto"), F.col("src_ip").alias("peer")).alias("transport"),
        F.lit("utf-8").alias("encoding_declared"), (number % 3).cast("int").alias("severity_number"), F.create_map(F.lit("k"), F.col("attrs")["k"]).alias("attrs"),
        F.lit("network").alias("source_class"), F.encode("body", "UTF-8").alias("body"),
    )


_ARCHIVES: dict[tuple[str, str], str] = {}


def _archive(spark, folder):
    """The archive of a folder's events and its manifest, written once for an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ARCHIVES:
        root = _new_folder(spark, "archive")
        archive.commit(_records(spark, folder), root)
        _ARCHIVES[key] = root
    return _ARCHIVES[key], archive.manifest(spark, _ARCHIVES[key])


_RAW = """raw AS (SELECT ev.* REPLACE (make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ev.ts) - epoch_us(TIMESTAMP '2024-01-01')) // 12) AS ts), user_id, action || ' op_k' || k || ' user ' || user_id || ' value ' || value AS body,
  CASE WHEN ev.event_id::BIGINT % 50 = 0 THEN '_unassigned' ELSE 'net/' || owner_group END AS grp FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, user_id, value FROM events) e USING (event_id)),
ob AS (SELECT grp, date_trunc('hour', ts) AS hour, count(*) AS n, min(ts) AS ts_from, max(ts) AS ts_to FROM raw GROUP BY ALL)"""


@_query("archive_round_trip", _ev(f", {_RAW} SELECT event_id, CASE WHEN grp <> '_unassigned' THEN grp END AS owner_group, ts, 'network' AS source_class, k::VARCHAR AS k, length(body) AS chars FROM raw WHERE grp IN ('net/grp_1', 'net/grp_2') AND ts >= TIMESTAMP '2024-01-01 10:30:00' AND ts < TIMESTAMP '2024-01-03'"))
def _round_trip(spark, folder):
    """Records written as an archive, then read by a scope and a time range."""
    root, _ = _archive(spark, folder)
    rows = archive.read_records(spark, root, AccessScope.groups("net/grp_1", "net/grp_2"), start="2024-01-01T10:30:00", end="2024-01-03")
    return rows.select(
        "event_id", F.regexp_replace("owner_group", "^/", "").alias("owner_group"), F.col("observed_at").cast("timestamp_ntz").alias("ts"), "source_class", F.col("attrs")["k"].alias("k"),
        F.length(F.decode("body", "UTF-8")).cast("long").alias("chars"),
    )


@_query("archive_manifest", _ev(f", {_RAW} SELECT grp AS owner_group, count(*) AS objects, sum(n)::BIGINT AS records, min(ts_from) AS ts_from, max(ts_to) AS ts_to FROM ob GROUP BY grp"))
def _manifest(spark, folder):
    _, objects = _archive(spark, folder)
    ntz = lambda c: c.cast("timestamp_ntz")
    return objects.groupBy("owner_group").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("event_count").alias("records"), ntz(F.min("ts_from")).alias("ts_from"), ntz(F.max("ts_to")).alias("ts_to")
    )


@_query("archive_scrub", _ev(f""", {_RAW} SELECT count(*) AS objects, 0 AS uploaded, count(*) FILTER (grp NOT IN ('net/grp_0', 'net/grp_1')) AS verified, count(*) FILTER (grp = 'net/grp_0') AS mismatched,
  count(*) FILTER (grp = 'net/grp_1') AS missing, sum(n)::BIGINT AS records, false AS all_verified FROM ob"""))
def _scrub(spark, folder):
    """A manifest that names other bytes for one group's objects, and files that do not exist for another's."""
    root, objects = _archive(spark, folder)
    strange = objects.withColumn("sha256", F.when(F.col("owner_group") == "net/grp_0", F.lit("0")).otherwise(F.col("sha256")))
    strange = strange.withColumn("object_key", F.when(F.col("owner_group") == "net/grp_1", F.concat("object_key", F.lit(".gone"))).otherwise(F.col("object_key")))
    return archive.archive_states(archive.scrub(spark, root, strange, "2024-02-01", most=1_000_000))


@_query("manifest_overlap", _ev(f""", {_RAW}, r AS (SELECT n_nationkey AS range_id, TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 2 HOUR AS a, TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 2 HOUR + (n_nationkey * n_nationkey * 7) * INTERVAL 1 MINUTE AS b FROM nation)
SELECT range_id, grp AS owner_group, count(*) AS objects, sum(n)::BIGINT AS records FROM r JOIN ob ON ts_to >= a AND ts_from < b WHERE a < b GROUP BY ALL"""))
def _overlap(spark, folder):
    n = F.col("n_nationkey")
    starts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, n_nationkey * 2, 0, 0)")
    ranges = adapt.table(spark, folder, "nation").select(n.alias("range_id"), starts.alias("starts_at")).withColumn("ends_at", F.expr("starts_at + make_dt_interval(0, 0, range_id * range_id * 7, 0)"))
    _, objects = _archive(spark, folder)
    return archive.overlapping(objects, ranges).groupBy("range_id", "owner_group").agg(F.count(F.lit(1)).alias("objects"), F.sum("event_count").alias("records"))


@_query("raw_lookup", _ev(f", {_RAW} SELECT event_id, body FROM raw WHERE grp IN ('net/grp_1', 'net/grp_2')"))
def _lookup(spark, folder):
    """The raw line of every event, whose own time keeps milliseconds only, through the manifest."""
    root, objects = _archive(spark, folder)
    batch = objects.select("batch").first()[0]
    owner = F.regexp_replace(F.coalesce("owner_group", F.lit("_unassigned")), "^/", "")
    events = _records(spark, folder).select("event_id", F.date_trunc("millisecond", "observed_at").alias("ts"), archive.raw_ref(F.lit(batch), owner, F.col("observed_at"), F.col("source_class")).alias("raw_ref"))
    found = archive.locate(spark, root, events, objects, AccessScope.groups("net/grp_1", "net/grp_2"))
    return found.select("event_id", F.decode("body", "UTF-8").alias("body"))


_REPLAYED = ("parse_status", "action", "user_name")
_REPLAY = f"""{_RAW}, old AS (SELECT event_id, ts, parse_status, CASE WHEN parse_status = 'failed' THEN '' ELSE action END AS action, user_name, k FROM raw WHERE event_id::BIGINT % 11 <> 0),
new AS (SELECT event_id, ts, 'ok' AS parse_status, action, 'user' || user_id AS user_name, k FROM raw WHERE ts >= TIMESTAMP '2024-01-01 12:00:00' AND ts < TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-03'),
j AS (SELECT new.event_id, old.event_id IS NULL AS is_new, old.parse_status AS was, coalesce(old.parse_status <> new.parse_status, false) AS c1, coalesce(old.action <> new.action, false) AS c2,
  coalesce(old.user_name <> new.user_name, false) AS c3, new.k % 4 = 0 AND old.event_id IS NOT NULL AS c4, new.k % 10 = 3 AND old.event_id IS NOT NULL AS c5 FROM new LEFT JOIN old USING (event_id))"""


def _table_and_plan(spark, folder):
    """A table that lost rows, kept failures and other attributes; and its archive, with the parser of today."""
    number, k = F.col("event_id").cast("long"), F.col("attrs")["k"]
    events = _hurried(spark, folder).filter(number % 11 != 0).select(
        "event_id", "ts", "owner_group", "source_id", "parse_status", F.when(F.col("parse_status") == "failed", "").otherwise(F.col("action")).alias("action"), "user_name", F.create_map(F.lit("k"), k).alias("attrs")
    )

    def rebuild(records):
        body, own = F.decode("body", "UTF-8"), F.col("attrs")["k"].cast("int")
        extra = F.when(own % 4 == 0, F.create_map(F.lit("even"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
        return records.select(
            "event_id", F.col("observed_at").cast("timestamp_ntz").alias("ts"), "owner_group", "source_id", F.lit("ok").alias("parse_status"), F.regexp_extract(body, "^(\\w+) ", 1).alias("action"),
            F.concat(F.lit("user"), F.regexp_extract(body, " user (\\d+) ", 1)).alias("user_name"), F.map_concat(F.when(own % 10 != 3, F.col("attrs")).otherwise(F.create_map().cast("map<string,string>")), extra).alias("attrs"),
        )

    root, objects = _archive(spark, folder)
    return events, lambda table: replay.prepare(replay.ReplayPlan("2024-01-01T12:00:00", "2024-01-03T06:00:00"), root, objects, table, rebuild, now="2024-01-03T08:00:00", fields=_REPLAYED)


@_query("replay_from_archive", _ev(f""", {_REPLAY} SELECT count(*) AS replayed, count(*) FILTER (is_new) AS added, count(*) FILTER (c1 OR c2 OR c3 OR c4 OR c5) AS changed, count(*) FILTER (NOT is_new AND NOT (c1 OR c2 OR c3 OR c4 OR c5)) AS unchanged,
  count(*) FILTER (was = 'failed') AS failed_to_ok, 0 AS ok_to_failed, count(*) FILTER (c4) AS even_added, count(*) FILTER (c5) AS k_lost FROM j"""))
def _from_archive(spark, folder):
    """Records of three days, of which the last is still open, against the table: a dry run."""
    events, prepare = _table_and_plan(spark, folder)
    changed = prepare(events).changed
    named = lambda field: F.count(F.when(F.exists("changes", lambda c: c["field"] == field), F.lit(1)))
    attrs = changed.agg(named("attrs.even").alias("even_added"), named("attrs.k").alias("k_lost"))
    return replay.report(changed).crossJoin(attrs)  # one row each


@_query("replay_applied", _ev(f""", {_REPLAY} SELECT event_id, parse_status, action, user_name FROM new UNION ALL SELECT event_id, parse_status, action, user_name FROM old WHERE event_id NOT IN (SELECT event_id FROM new)"""))
def _applied(spark, folder):
    """The table written by day, replayed, its closed days replaced, and read again."""
    events, prepare = _table_and_plan(spark, folder)
    path = _new_folder(spark, "events")
    dated = lambda df: df.withColumn("event_date", F.to_date("ts"))
    dated(events).write.partitionBy("event_date").parquet(path)
    table = spark.read.schema(dated(events).schema).parquet(path)
    replay.replace_days(dated(prepare(table.drop("event_date")).merged), path)
    return spark.read.schema(table.schema).parquet(path).select("event_id", "parse_status", "action", "user_name")


@_query("event_store", _ev("SELECT owner_group, vendor, count(*) AS events, sum(severity_num)::BIGINT AS severity, count(*) FILTER (dst_ip = '') AS no_target FROM ev WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND owner_group IN ('grp_1', 'grp_2') GROUP BY ALL"))
def _event_store(spark, folder):
    """Events appended to the canonical table in two writes, then a scan of some days by its fixed schema."""
    path, events = _new_folder(spark, "store"), adapt.event_columns(spark, folder)
    first = F.col("vendor") == "Cisco"
    store.append_events(events.filter(first), path)
    store.append_events(events.filter(~first).drop("template_id"), path)
    rows = store.scan_events(spark, path).filter("event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'").filter(F.col("owner_group").isin(sorted(SOME.owner_groups)))
    return rows.groupBy("owner_group", "vendor").agg(F.count(F.lit(1)).alias("events"), F.sum("severity_num").alias("severity"), F.count(F.when(F.col("dst_ip") == "", 1)).alias("no_target"))


@_query("changes_written", """WITH c AS (SELECT 'grp_' || (o_custkey % 4) AS owner_group FROM orders)
SELECT 'written' AS what, owner_group, count(*) AS n FROM c WHERE owner_group IN ('grp_1', 'grp_2') GROUP BY 2 UNION ALL SELECT 'refused', owner_group, count(*) FROM c WHERE owner_group NOT IN ('grp_1', 'grp_2') GROUP BY 2""")
def _changes_written(spark, folder):
    path = _new_folder(spark, "changes")
    refused = store.write_changes(adapt.changes(spark, folder), path, SOME)
    counts = lambda df, what: df.groupBy("owner_group").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "owner_group", "n")
    return counts(spark.read.parquet(path), "written").unionByName(counts(refused, "refused"))


def _csv(spark, folder, damaged):
    """Customers as lines of a CSV text in several files, with comments, blank lines and, if wanted, errors."""
    key = F.col("c_custkey")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    row = part("src_", key, " , grp_", key % 4, ",10.1.0.", key % 250, ",", F.when(key % 3 == 0, " ").otherwise(part("dev", key)), ",", F.when(key % 2 == 0, "").otherwise("nginx.combined"), "\r")
    if damaged:
        row = (
            F.when(key % 37 == 5, part("src_", key, ",grp_1")).when(key % 41 == 6, part(" ,grp_1,,,")).when(key % 43 == 7, part("src_", key - 1, ",grp_1,,,")).otherwise(row)
        )
    body = adapt.table(spark, folder, "customer").select((key * 3 + 1).alias("at"), row.alias("value"))
    extra = body.filter("at % 10 = 1").select(F.col("at") + 1, F.when(F.col("at") % 20 == 1, "# a comment, with, commas").otherwise(""))
    head = spark.createDataFrame([(-1, "# sources"), (0, "source_id,owner_group, peer_address ,hostname,parser_id")], "at long, value string")
    path = _new_folder(spark, "csv")
    head.unionByName(body).union(extra).repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.text(path)
    return inventory.read_lines(spark, path)


_LINES = """l AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) + 1 AS line, CASE WHEN c_custkey % 37 = 5 THEN 'cells' WHEN c_custkey % 41 = 6 THEN 'blank' END AS bad,
  CASE WHEN c_custkey % 43 = 7 THEN c_custkey - 1 ELSE c_custkey END AS id, CASE WHEN c_custkey % 43 = 7 THEN 'grp_1' ELSE 'grp_' || (c_custkey % 4) END AS grp FROM customer),
f AS (SELECT id, min(line) AS first FROM l WHERE bad IS NULL GROUP BY id),
e AS (SELECT line, coalesce(bad, CASE WHEN line <> first THEN 'repeated' WHEN grp NOT IN ('grp_1', 'grp_2') THEN 'scope' END) AS problem,
  CASE WHEN bad = 'cells' THEN '2 of 5' WHEN bad = 'blank' THEN '' WHEN line <> first THEN 'src_' || l.id || ' in line ' || first ELSE grp END AS detail FROM l LEFT JOIN f USING (id))"""


@_query("inventory_errors", f"WITH {_LINES} SELECT * FROM e WHERE problem IS NOT NULL")
def _inventory_errors(spark, folder):
    """Every line of a damaged import that is refused, by a scope of two groups; no row comes through."""
    found = inventory.check(_csv(spark, folder, True), SOME)
    return found.errors.join(found.rows.select("source_id"), F.lit(False), "left").select("line", "problem", "detail")


@_query("inventory_import", """WITH c AS (SELECT c_custkey AS key FROM customer)
SELECT 'src_' || key AS source_id, 'grp_' || (key % 4) AS owner_group, '10.1.0.' || (key % 250) AS peer_address, CASE WHEN key % 3 <> 0 THEN 'dev' || key END AS hostname, CASE WHEN key % 2 = 1 THEN 'nginx.combined' END AS parser_id,
  'auto' AS encoding, 'default' AS source_class, key % 5 = 0 OR key % 2 = 0 AS enabled, CASE WHEN key % 5 = 0 THEN 'created' ELSE 'updated' END AS change FROM c
UNION ALL SELECT 'old_' || n_nationkey, 'grp_9', NULL, NULL, NULL, 'auto', 'default', true, NULL FROM nation""")
def _inventory_import(spark, folder):
    """A clean import merged into an inventory that lacks every fifth source and has some others."""
    none = F.lit(None).cast("string")
    schema = ["source_id", "owner_group", "peer_address", "hostname", "vendor", "product", "parser_id", "encoding", "source_class", "enabled", "created_at", "updated_at"]
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    plain = {c: none for c in schema} | {"encoding": F.lit("auto"), "source_class": F.lit("default"), "created_at": at, "updated_at": at}
    key = F.col("c_custkey")
    known = adapt.table(spark, folder, "customer").filter(key % 5 != 0).select(key).withColumns(plain | {"source_id": F.concat(F.lit("src_"), key), "owner_group": F.lit("grp_old"), "enabled": key % 2 == 0, "hostname": F.lit("old")})
    others = adapt.table(spark, folder, "nation").withColumns(plain | {"source_id": F.concat(F.lit("old_"), F.col("n_nationkey")), "owner_group": F.lit("grp_9"), "enabled": F.lit(True)})
    before = known.select(schema).unionByName(others.select(schema))
    merged = inventory.upsert(before, inventory.check(_csv(spark, folder, False), ALL).rows, "2024-02-01")
    return merged.select("source_id", "owner_group", "peer_address", "hostname", "parser_id", "encoding", "source_class", "enabled", "change")


@_query("address_forms", """WITH e AS (SELECT event_id, user_id % 256 AS u, event_id % 8 AS kind, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id, CASE kind WHEN 0 THEN '10.0.' || u || '.' || k WHEN 1 THEN '10.0.' || u || '.' || k WHEN 2 THEN '2001:db8::' || CASE WHEN k > 0 THEN lower(to_hex(k)) ELSE '' END WHEN 3 THEN 'fe80::' || lower(to_hex(k + 1))
  WHEN 5 THEN '2001:db8::' || lower(to_hex(k + 1)) || ':1' END AS address, kind IN (0, 1) AND u < 16 AS inside FROM e""")
def _address_forms(spark, folder):
    """Addresses in eight spellings, three of which are none."""
    kind, u = F.col("event_id") % 8, (F.col("user_id") % 256).cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    form = (
        F.when(kind == 0, text(" 10.0.", u, ".", k)).when(kind == 1, text("::FFFF:10.0.", u, ".", k)).when(kind == 2, text("2001:DB8:0:0:0:0:0:", F.hex(k))).when(kind == 3, text("fe80::", F.hex(k + 1), "%eth0"))
        .when(kind == 4, "0:0:0:0:0:0:0:0").when(kind == 5, text("[2001:0db8::00", F.lpad(F.hex(k + 1), 2, "0"), ":0001]")).when(kind == 6, text("10.", k)).otherwise("2001:db8::1::2")
    )
    events = adapt.table(spark, folder, "events").select("event_id", form.alias("form"))
    return events.select("event_id", addresses.canonical_address(F.col("form")).alias("address"), addresses.within(F.col("form"), "10.0.0.0/20").alias("inside"))


@_query("uncaptured_fragments", _ev(""", f AS (SELECT vendor, unnest(['op_k' || k || ' user', 'value ' || value]) AS fragment FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, value FROM events) USING (event_id)),
c AS (SELECT vendor, fragment, count(*) AS lines FROM f GROUP BY vendor, fragment)
SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY lines DESC, fragment)::INTEGER AS place FROM c QUALIFY place <= 25"""))
def _fragments(spark, folder):
    """Messages of which the type and the user are captured; one value of no line, and one that holds another, cover nothing."""
    user = F.concat(F.lit(" "), F.regexp_extract("source_id", r"(\d+)", 1), F.lit(" "))
    events = adapt.event_columns(spark, folder).withColumns({"user_": user, "all_": F.concat(F.lit("user"), user, F.lit("value")), "attrs": F.create_map(F.lit("none"), F.lit("nothing"))})
    return fragments.top_fragments(events, ("action", "user_", "all_", "event_id"))


def _findings(spark, folder):
    """Orders as findings of the evidence providers."""
    key = F.col("o_orderkey")
    return adapt.table(spark, folder, "orders").select(
        F.concat(F.lit("i"), key).alias("item_id"), F.element_at(F.array(F.lit("logs.propagation"), F.lit("logs.first-seen"), F.lit("other")), (key % 3 + 1).cast("int")).alias("provider_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, o_orderkey % 600, 0)").alias("ts"), F.floor("o_totalprice").cast("double").alias("weight"), (key % 500).cast("int").alias("order_in_slice"),
    )


_RANKED = """f AS (SELECT 'i' || o_orderkey AS item_id, ['logs.propagation', 'logs.first-seen', 'other'][o_orderkey % 3 + 1] AS provider_id, TIMESTAMP '2024-01-01' + (o_orderkey % 600) * INTERVAL 1 MINUTE AS ts, floor(o_totalprice)::DOUBLE AS weight, (o_orderkey % 500)::INTEGER AS slot FROM orders),
s AS (SELECT *, {rank} + CASE WHEN max(weight) OVER (PARTITION BY provider_id) > 0 THEN weight / max(weight) OVER (PARTITION BY provider_id) ELSE 0 END AS score FROM f)"""


def _rank_sql():
    cases = " ".join(f"WHEN '{name}' THEN {value}" for name, value in evidence.CLASS_RANKS.items())
    return "WITH " + _RANKED.format(rank=f"CASE provider_id {cases} ELSE {evidence.UNRANKED} END")


@_query("ranked_positions", f"{_rank_sql()} SELECT item_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, slot, item_id) AS position FROM s")
def _positions(spark, folder):
    """The place of every finding, without a budget."""
    return evidence.rank(_findings(spark, folder)).select("item_id", F.round("score", 9).alias("score"), "position")


@_query("finding_timeline", f"{_rank_sql()} SELECT item_id, ts, row_number() OVER (ORDER BY ts, score DESC, item_id) AS position FROM s")
def _timeline(spark, folder):
    return evidence.timeline(evidence.rank(_findings(spark, folder))).select("item_id", "ts", "position")


_TRIGGERS = """tr AS (SELECT o_orderkey AS trigger_id, 'grp_' || (o_custkey % 4) AS owner_group, CASE WHEN o_orderkey % 50 <> 0 THEN 'src_' || (o_custkey % 150) END AS source_id, TIMESTAMP '2024-01-08' + (o_orderkey % 20000) * INTERVAL 1 MINUTE AS w0,
  TIMESTAMP '2024-01-08' + (o_orderkey % 20000) * INTERVAL 1 MINUTE + (o_orderkey % 90) * INTERVAL 10 MINUTE AS w1 FROM orders WHERE o_orderkey % 25 = 0),
m AS (SELECT trigger_id, sig, count(*) FILTER (ts >= w0) AS window_count, count(*) FILTER (ts < w0) AS baseline_count, min(ts) FILTER (ts >= w0) AS first_seen_at, any_value(epoch(w1) - epoch(w0)) AS span
  FROM tr JOIN ev ON ts >= w0 - INTERVAL 7 DAY AND ts < w1 AND (ev.source_id = tr.source_id OR (tr.source_id IS NULL AND ev.owner_group = tr.owner_group)) WHERE w0 < w1 GROUP BY ALL HAVING count(*) FILTER (ts >= w0) > 0)"""


def _alarms(spark, folder):
    """Orders as triggers of a source or, without one, of a whole group; some windows are empty."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00' + make_dt_interval(0, 0, o_orderkey % 20000, 0)")
    return adapt.table(spark, folder, "orders").filter(key % 25 == 0).select(
        key.alias("trigger_id"), F.concat(F.lit("grp_"), cust % 4).alias("owner_group"), F.when(key % 50 != 0, F.concat(F.lit("src_"), cust % 150)).alias("source_id"), start.alias("window_from"),
        F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00' + make_dt_interval(0, 0, o_orderkey % 20000 + (o_orderkey % 90) * 10, 0)").alias("window_to"),
    )


@_query("trigger_signatures", _ev(f""", {_TRIGGERS} SELECT trigger_id, sig AS signature_text, window_count, baseline_count, first_seen_at, round(baseline_count * span / 604800.0::DOUBLE, 6) AS expected FROM m"""))
def _trigger_signatures(spark, folder):
    """What every trigger's window holds, against the week before it."""
    out = triggers.signature_counts(_alarms(spark, folder), adapt.events(spark, folder), ALL)
    return out.select("trigger_id", "signature_text", "window_count", "baseline_count", "first_seen_at", F.round("expected", 6).alias("expected"))


@_query("trigger_evidence", _ev(f""", {_TRIGGERS}, p AS (SELECT trigger_id, unnest(['logs.first-seen', 'logs.volume']) AS provider_id FROM tr WHERE w0 < w1),
n AS (SELECT trigger_id, 'logs.first-seen' AS provider_id, count(*) AS n FROM m WHERE baseline_count = 0 GROUP BY 1 UNION ALL
  SELECT trigger_id, 'logs.volume', count(*) FROM m WHERE window_count >= 2 AND baseline_count > 0 AND (window_count - baseline_count * span / 604800.0::DOUBLE) / sqrt(baseline_count * span / 604800.0::DOUBLE) >= 2 GROUP BY 1)
SELECT trigger_id, provider_id, CASE WHEN n > 0 THEN 'gathered' ELSE 'empty' END AS status, coalesce(n, 0) AS findings FROM p LEFT JOIN n USING (trigger_id, provider_id)"""))
def _trigger_evidence(spark, folder):
    alarms = _alarms(spark, folder)
    return triggers.trigger_slices(alarms, triggers.trigger_findings(alarms, adapt.events(spark, folder), ALL, min_z=2.0, min_count=2))


@_query("live_ingest", _ev(f""", {_PARSED} SELECT parser_id, parse_status, time_source, CAST(event_ts AS DATE) AS day, count(*) AS events, count(DISTINCT host) AS hosts, count(*) FILTER (tags <> '') AS tagged, sum(port)::BIGINT AS ports, max(src) AS last_source
FROM (SELECT *, coalesce(parsed_at, CASE WHEN event_id::BIGINT % 3 > 0 THEN ts END, ingested_at) AS event_ts, CASE WHEN parsed_at IS NOT NULL THEN 'parsed' WHEN event_id::BIGINT % 3 > 0 THEN 'observed' ELSE 'received' END AS time_source,
  CASE parser_id WHEN 'firewall' THEN 'fw' ELSE 'key ' || source_id END AS host, coalesce(dst_port::INTEGER, 0) AS port, CASE WHEN src_ip IS NULL THEN '' ELSE '::ffff:' || src_ip END AS src FROM pb) GROUP BY ALL"""))
def _live_ingest(spark, folder):
    """Device lines arrive as files of raw records; one streaming query makes the table of events, which is then scanned."""
    inbox, path = _new_folder(spark, "inbox"), _new_folder(spark, "events")
    rows = _lines(spark, folder).select(
        "event_id", F.col("ingested_at").alias("received_at"), F.when(F.col("event_id").cast("long") % 3 > 0, F.col("ts")).alias("observed_at"), F.concat(F.lit("key "), "source_id").alias("source_key"), "source_id",
        F.lit("grp").alias("owner_group"), F.encode("body", "UTF-8").alias("body"), F.create_map().cast(TEXT_MAP).alias("given"),
    )
    rows.write.parquet(inbox)
    query = ingest.ingest(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(inbox), PARSERS, path, _new_folder(spark, "state"), availableNow=True)
    query.awaitTermination()
    events = store.scan_events(spark, path)
    tagged = F.count(F.when(attr("logmeridian.tags") != "", F.lit(1)))
    return events.groupBy("parser_id", "parse_status", "time_source", F.col("event_date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("host").alias("hosts"), tagged.alias("tagged"), F.sum("dst_port").alias("ports"), F.max("src_ip").alias("last_source")
    )


@_query("live_sample", _ev("SELECT DISTINCT sig AS signature_text FROM ev WHERE event_type_ <> 'view' AND (parse_status = 'failed' OR ('0x' || substr(md5(event_id), 1, 8))::BIGINT % 100 < 10)".replace("event_type_", "action")))
def _live_sample(spark, folder):
    """Signatures that the sampler passes on when the events arrive as a stream and those of views are known."""
    known = adapt.events(spark, folder).filter("action = 'view'").select("signature_hash")
    inbox = _new_folder(spark, "inbox")
    adapt.events(spark, folder).select("event_id", "ingested_at", "parse_status", "signature_hash", "signature_text").write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    return live.drain(ingest.sampled(stream, known, percent=10, late="40 days"), "sample").select("signature_text")


@_query("replay_all_fields", _ev(f""", o AS (SELECT * FROM ev WHERE event_id::BIGINT % 9 <> 0), j AS (SELECT ev.*, o.event_id IS NULL AS is_new FROM ev LEFT JOIN o USING (event_id)),
c AS (SELECT 'vendor' AS field, k % 4 = 0 AS c, is_new FROM j UNION ALL SELECT 'dst_port', k % 5 = 1, is_new FROM j UNION ALL SELECT 'ts', k % 6 = 2, is_new FROM j UNION ALL SELECT 'time_source', time_source = 'observed', is_new FROM j
  UNION ALL SELECT 'attrs.new', k % 7 = 3, is_new FROM j UNION ALL SELECT 'attrs.k', k % 8 = 4, is_new FROM j UNION ALL SELECT 'parse_status', parse_status = 'partial', is_new FROM j)
SELECT field, count(*) AS n FROM c WHERE c AND NOT is_new GROUP BY field"""))
def _all_fields(spark, folder):
    """Changes by field over all fields of an event and each key of its attributes."""
    events, k = adapt.events(spark, folder), F.col("attrs")["k"].cast("int")
    rebuilt = events.withColumns({
        "vendor": F.when(k % 4 == 0, F.upper(F.concat("vendor", F.lit("x")))).otherwise(F.col("vendor")), "dst_port": F.when(k % 5 == 1, F.col("dst_port") + 1).otherwise(F.col("dst_port")),
        "ts": F.when(k % 6 == 2, F.expr("ts + make_dt_interval(0, 0, 0, 1)")).otherwise(F.col("ts")), "time_source": F.lit("parsed"), "parse_status": F.when(F.col("parse_status") == "partial", "ok").otherwise(F.col("parse_status")),
        "attrs": F.map_concat(F.when(k % 8 == 4, F.map_filter("attrs", lambda n, _: n != "k")).otherwise(F.col("attrs")), F.when(k % 7 == 3, F.create_map(F.lit("new"), F.lit("1"))).otherwise(F.create_map().cast(TEXT_MAP))),
    })
    changed = replay.diff(events.filter(F.col("event_id").cast("long") % 9 != 0), rebuilt, attrs="attrs")
    return replay.changes_per_field(changed)


_NOW = "2024-01-29 06:30:00"
_RATIO = alerts.Rule("errors-rise", "ratio", 3 * 3600, 1.2, ">=", (" grp_1", "grp_3"), "action = 'error'")


@_query("alert_preview", _ev(f""", g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-27 06:00:00', TIMESTAMP '{_NOW}' - INTERVAL 1 SECOND, INTERVAL 3 HOUR)) AS bucket_start),
c AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS n FROM ev WHERE action = 'error' AND owner_group = 'grp_1' AND ts >= TIMESTAMP '2024-01-27 06:30:00' AND ts < TIMESTAMP '{_NOW}' GROUP BY 1),
d AS (SELECT bucket_start, coalesce(n, 0) AS event_count, lag(coalesce(n, 0)) OVER (ORDER BY bucket_start) AS before FROM g LEFT JOIN c USING (bucket_start))
SELECT bucket_start, event_count, round(event_count / greatest(before, 1)::DOUBLE, 6) AS value, event_count / greatest(before, 1)::DOUBLE >= 1.2 AS fires FROM d WHERE before IS NOT NULL"""))
def _preview(spark, folder):
    """A ratio rule of two groups, one of which the reader may not see, over two days."""
    rows = preview.preview_counting(adapt.event_columns(spark, folder), _RATIO, SOME, _NOW, 2 * 86_400).rows
    return rows.withColumn("value", F.round("value", 6))


_GAPS = f"""inv AS (SELECT 'src_' || c_custkey AS source_id, 'grp_' || (c_custkey % 4) AS owner_group, TIMESTAMP '2024-01-22' + (c_custkey % 9) * INTERVAL 1 DAY AS created FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 IN (1, 2)),
s AS (SELECT source_id, owner_group, greatest(created, TIMESTAMP '2024-01-22 06:30:00') AS start FROM inv ORDER BY source_id LIMIT 100),
b AS (SELECT DISTINCT s.source_id, start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS at_ FROM s JOIN ev ON ev.source_id = s.source_id AND ev.owner_group IN ('grp_1', 'grp_2') AND ts >= TIMESTAMP '2024-01-22 06:30:00' AND ts < TIMESTAMP '{_NOW}'),
w AS (SELECT source_id, at_ AS until, greatest(start, coalesce(lag(at_) OVER (PARTITION BY source_id ORDER BY at_) + INTERVAL 1 HOUR, start)) AS since FROM b
  UNION ALL SELECT source_id, TIMESTAMP '{_NOW}', greatest(start, coalesce((SELECT max(at_) FROM b WHERE b.source_id = s.source_id) + INTERVAL 1 HOUR, start)) FROM s),
p AS (SELECT source_id, owner_group, (SELECT max(at_) FROM b WHERE b.source_id = s.source_id) AS last_seen, (SELECT count(*) FROM w WHERE w.source_id = s.source_id AND until > since) AS gaps,
  coalesce((SELECT round(max(epoch(until) - epoch(since)), 3) FROM w WHERE w.source_id = s.source_id AND until > since), 0) AS longest, (SELECT count(*) FROM w WHERE w.source_id = s.source_id AND until > since AND epoch(until) - epoch(since) >= 43200) AS firings FROM s)"""


def _silence_preview(spark, folder):
    inventory_ = adapt.inventory(spark, folder).withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-22 00:00:00' + make_dt_interval(CAST(substring(source_id, 5) AS INT) % 9, 0, 0, 0)"))
    return preview.preview_silence(adapt.event_columns(spark, folder), inventory_, 43_200, SOME, _NOW, 30 * 86_400, most=100)


@_query("silence_preview", _ev(f", {_GAPS} SELECT * FROM p"))
def _silent_sources(spark, folder):
    """A week is the most that a preview looks back; the first hundred sources of a scope are shown."""
    longest = F.round(F.coalesce(F.array_max("gaps"), F.lit(0.0)), 3)
    return _silence_preview(spark, folder).rows.select("source_id", "owner_group", "last_seen", F.size("gaps").cast("long").alias("gaps"), longest.alias("longest"), "firings")


@_query("silence_preview_total", _ev(f", {_GAPS} SELECT (SELECT sum(firings) FROM p)::BIGINT AS firings, (SELECT count(*) FROM p) AS shown, (SELECT count(*) FROM inv) - (SELECT count(*) FROM p) AS left_out"))
def _silent_total(spark, folder):
    return _silence_preview(spark, folder).summary


_HITS = (
    alerts.Rule("many", "threshold", 6 * 3600, 3.0, ">=", ("grp_0", "grp_1"), "action = 'error'"), alerts.Rule("never", "threshold", 3600, 1e9, ">"), alerts.Rule("gone", "silence", 86_400, 0, ">=", ("grp_2",)),
)


@_query("alert_hits", _ev(f""", inv AS (SELECT 'src_' || c_custkey AS source_id FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 = 2), act AS (SELECT source_id, max(ingested_at) AS last_at FROM ev WHERE ts < TIMESTAMP '{_NOW}' GROUP BY 1),
q AS (SELECT source_id, last_at IS NULL AS never, floor(greatest(0, epoch(TIMESTAMP '{_NOW}') - epoch(coalesce(last_at, TIMESTAMP '2024-01-01'))))::BIGINT AS s FROM inv LEFT JOIN act USING (source_id)),
m AS (SELECT count(*) AS n FROM ev WHERE action = 'error' AND owner_group IN ('grp_0', 'grp_1') AND ts >= TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR AND ts < TIMESTAMP '{_NOW}')
SELECT 'many' AS rule_id, CASE WHEN n >= 3 THEN 'fired' ELSE 'quiet' END AS state, CASE WHEN n >= 3 THEN '' END AS source_id, CASE WHEN n >= 3 THEN n::DOUBLE END AS value, CASE WHEN n >= 3 THEN TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR END AS window_from FROM m
UNION ALL SELECT 'never', 'quiet', NULL, NULL, NULL UNION ALL SELECT 'gone', 'fired', source_id, s::DOUBLE, TIMESTAMP '{_NOW}' - least(s, 86400) * INTERVAL 1 SECOND FROM q WHERE s >= 86400"""))
def _hits(spark, folder):
    found = alerts.hits(adapt.event_columns(spark, folder), adapt.inventory(spark, folder), _HITS, _NOW)
    return found.select("rule_id", "state", "source_id", "value", "window_from")


@_query("full_text_search", _ev("SELECT event_id, ts FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, user_id FROM events) USING (event_id) WHERE owner_group IN ('grp_1', 'grp_2') AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND contains(action || ' op_k' || k || ' user ' || user_id, '_k7 user 1')"))
def _full_text(spark, folder):
    """All events of a scope whose message holds a text."""
    query = EventQuery(MONTH.start, MONTH.end, full_text="_k7 user 1")
    return adapt.event_columns(spark, folder).filter(search.matching(adapt.event_columns(spark, folder), query, SOME)).select("event_id", "ts")


@_query("event_by_id", _ev("SELECT event_id, ts, action, owner_group FROM ev WHERE event_id = '42' AND owner_group IN ('grp_0', 'grp_1', 'grp_2', 'grp_3')"))
def _by_id(spark, folder):
    return search.find_event(adapt.event_columns(spark, folder), "42", ALL).select("event_id", "ts", "action", "owner_group")


@_query("event_view_pairs", _ev("""SELECT event_id AS record_id, unnest(['uid', 'severity_id', 'src_endpoint_ip', 'src_endpoint_port']) AS name, unnest([event_id, severity_num::VARCHAR, src_ip, src_port::VARCHAR]) AS value FROM ev WHERE action = 'error'"""))
def _pairs(spark, folder):
    """Four fields of the OCSF view of every error as names and values."""
    shown = views.view_pairs(views.ocsf_view(adapt.event_columns(spark, folder).filter("action = 'error'")), "uid")
    return shown.filter(F.col("name").isin("uid", "severity_id", "src_endpoint_ip", "src_endpoint_port")).select("record_id", "name", "value")


@_query("readable_bundles", """WITH b AS (SELECT o_orderkey AS bundle, o_orderkey % 7 = 0 AS by_system, list_distinct(['grp_' || (o_custkey % 4), 'grp_' || (o_custkey % 3)]) AS groups FROM orders)
SELECT bundle FROM b WHERE NOT by_system AND len(list_filter(groups, lambda g: g NOT IN ('grp_1', 'grp_2'))) = 0""")
def _bundles(spark, folder):
    """Bundles that a reader of two groups may open: all their groups are allowed, and the system did not gather them."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    groups = F.array_distinct(F.array(F.concat(F.lit("grp_"), cust % 4), F.concat(F.lit("grp_"), cust % 3)))
    return adapt.table(spark, folder, "orders").filter(all_groups_readable(SOME, groups, key % 7 == 0)).select(key.alias("bundle"))


@_query("lift_top_values", _ev("""SELECT field, value, window_count, baseline_count FROM (SELECT field, value, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS window_count, count(*) FILTER (ts < TIMESTAMP '2024-01-29') AS baseline_count
  FROM (SELECT 'source_id' AS field, source_id AS value, ts FROM ev UNION ALL SELECT 'action', action, ts FROM ev) u WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-30' GROUP BY ALL)
WHERE window_count > 0 QUALIFY row_number() OVER (PARTITION BY field ORDER BY window_count DESC, value) <= 3"""))
def _top_values(spark, folder):
    """The three most frequent values of each field in a window."""
    counts = correlate.attribute_counts(adapt.event_columns(spark, folder), WINDOW, ALL, ("source_id", "action"))
    return correlate.top_per_field(counts, 3).select("field", "value", "window_count", "baseline_count")


@_query("detection_expectations", _ev("""SELECT 'ssh-or-winbox' AS rule_id, true AS expected, count(*) AS hits, count(*) > 0 AS passed FROM ev WHERE dst_port IN (22, 8291)
UNION ALL SELECT 'internal-peer', false, count(*), (count(*) > 0) = false FROM ev WHERE src_ip LIKE '10.0.1.%' UNION ALL SELECT 'no-such-rule', true, 0, false"""))
def _expectations(spark, folder):
    expected = spark.createDataFrame([("ssh-or-winbox", True), ("internal-peer", False), ("no-such-rule", True)], "rule_id string, expected boolean")
    return detect.expectations(detect.detections(adapt.event_columns(spark, folder), detect.example_rules()), expected)


@_query("drilldown_events", _ev("""SELECT event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30' AND sig NOT IN (SELECT sig FROM ev WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29')"""))
def _drilldown(spark, folder):
    """The events behind the findings of first-seen signatures, through the signature that each finding carries."""
    events = adapt.events(spark, folder)
    new = correlate.first_seen(events, WINDOW, ALL, ["signature_hash", "signature_text"])
    findings = new.select(F.create_map(F.lit("signature_hash"), unsigned_text(F.col("signature_hash"))).alias("payload"))
    return evidence.drilldown_events(events, findings, WINDOW, ALL).select("event_id")


@_query("report_flags", """WITH s AS (SELECT ['gathered', 'empty', 'failed', 'never_fed', 'unavailable'][o_orderkey % 5 + 1] AS status, o_custkey % 3 AS hidden, o_orderkey % 2 = 0 AS truncated FROM orders)
SELECT sum(hidden)::BIGINT AS out_of_scope_count, bool_or(status IN ('failed', 'unavailable') OR truncated) AS is_partial, count(*) FILTER (status NOT IN ('gathered', 'empty')) AS not_consulted FROM s""")
def _flags(spark, folder):
    kinds = F.array(*[F.lit(x) for x in ("gathered", "empty", "failed", "never_fed", "unavailable")])
    slices = adapt.table(spark, folder, "orders").select(
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"), (F.col("o_custkey") % 3).alias("out_of_scope_count"), (F.col("o_orderkey") % 2 == 0).alias("truncated")
    )
    return evidence.report_flags(slices)


_FIVE = (
    *PARSERS[:1],
    parse.Parser("any-web", (S.Grok(patterns=(r"^%{COMMONAPACHELOG} %{GREEDYDATA:rest}$",)),), ('"GET',), 45, ocsf={"http.method": "{{ verb }}", "status": parse.Lookup("response", {"200": "Success"}, "Failure")}, otel={"url.path": "{{request}}"}),
    *PARSERS[1:],
)


@_query("dispatch_tiers", _ev("""SELECT CASE WHEN event_id::BIGINT % 20 = 0 THEN 'unmatched' WHEN vendor = 'NGINX' AND event_id::BIGINT % 3 = 1 THEN 'bound' ELSE 'candidate' END AS tier, count(*) AS messages,
sum(CASE WHEN event_id::BIGINT % 20 = 0 THEN 0 ELSE 1 END)::BIGINT AS attempts FROM ev GROUP BY 1"""))
def _tiers(spark, folder):
    """Device lines, a third of them from sources bound to a parser that only takes web lines."""
    bound = F.when(F.col("event_id").cast("long") % 3 == 1, "any-web").alias("bound")
    parsed = parse.parse_events(_lines(spark, folder).select("event_id", "body", bound), _FIVE, bound="bound")
    return health.dispatch_tiers(parsed)


@_query("attribute_maps", _ev("""SELECT event_id, 'GET' AS method, CASE WHEN action = 'error' THEN 'Failure' ELSE 'Success' END AS status, '/p/' || k AS path, 'forced' AS tier, src_ip AS clientip
FROM ev WHERE vendor = 'NGINX' AND event_id::BIGINT % 20 <> 0"""))
def _attribute_maps(spark, folder):
    """Web lines by one forced parser: fields of the grok library, values for both views, and the engine's own keys."""
    lines = _lines(spark, folder).select("event_id", "body", "source_id", "ingested_at", "ts")
    out = parse.normalize(parse.parse_events(lines, _FIVE, forced="any-web"), "ts", "ingested_at", "source_id").filter("parse_status = 'ok'")
    at = lambda key: F.col("attributes")[key]
    return out.select(
        "event_id", at("ocsf.http.method").alias("method"), at("ocsf.status").alias("status"), at("otel.url.path").alias("path"), at("logmeridian.dispatch_tier").alias("tier"), at("clientip").alias("clientip")
    )


_IN_WINDOW, _IN_BASELINE = ("ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30'", "ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29'")
_LIFTED = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value, ts FROM ev" for f in LIFT_FIELDS)


def _found(provider: str, sql: str, window: CorrelationWindow = WINDOW) -> None:
    """A query of all findings of one evidence provider, without a budget, in their order."""

    def run(spark, folder):
        only = [p for p in evidence.PROVIDERS if p.id == provider]
        found = evidence.gather(replace(_inputs(spark, folder, None), window=window, now=window.end), only).findings
        return found.select("item_id", "ts", F.round("weight", 6).alias("weight"), "order_in_slice", "summary")

    _query("evidence_" + provider.replace("logs.", "").replace(".", "_").replace("-", "_"), sql)(run)


_found("logs.first-seen", _ev(f""", n AS (SELECT sig, count(*) AS n, min(ts) AS ts, count(DISTINCT source_id) AS sources, min_by(body, (ts, event_id)) AS body FROM (SELECT ev.*, action || ' op_k' || k || ' user ' || user_id || ' value ' || value AS body
  FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, user_id, value FROM events) USING (event_id)) WHERE {_IN_WINDOW} AND sig NOT IN (SELECT sig FROM ev WHERE {_IN_BASELINE}) GROUP BY sig)
SELECT 'first-seen:' || sig AS item_id, ts, sources::DOUBLE AS weight, (row_number() OVER (ORDER BY n DESC, sig) - 1)::INTEGER AS order_in_slice, 'first seen · ' || sources || ' sources · ' || n || ' events · ' || body AS summary FROM n"""))
_found("logs.propagation", _ev(f""", d AS (SELECT owner_group, source_id, min(ts) AS ts, count(*) AS n, count(*) FILTER (time_source <> 'parsed') AS late FROM ev WHERE {_IN_WINDOW} AND (parse_status = 'failed' OR severity_num >= 4) GROUP BY ALL),
l AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM d)) / 1e6 AS lag FROM d)
SELECT 'propagation:' || source_id AS item_id, ts, round(1.0 / (1.0 + lag), 6) AS weight, (row_number() OVER (ORDER BY ts, source_id, owner_group) - 1)::INTEGER AS order_in_slice,
  source_id || ' · first degraded +' || round(lag)::BIGINT || 's · ' || n || ' events' || CASE WHEN late > 0 THEN ' · ' || late || ' events with unreliable time' ELSE '' END AS summary FROM l"""))
_found("logs.silence", _ev(f""", s AS (SELECT owner_group, source_id, max(ingested_at) AS ts, count(*) / 7.0::DOUBLE AS expected FROM ev WHERE {_IN_BASELINE} AND source_id NOT IN (SELECT source_id FROM ev WHERE {_IN_WINDOW}) GROUP BY ALL HAVING count(*) >= 7)
SELECT 'silence:' || source_id AS item_id, ts, round(expected, 6) AS weight, (row_number() OVER (ORDER BY expected DESC, source_id, owner_group) - 1)::INTEGER AS order_in_slice,
  source_id || ' fell silent · about ' || regexp_replace(round(expected, 1)::DECIMAL(18, 1)::VARCHAR, '\\.0$', '') || ' events expected · last heard ' || strftime(ts, '%Y-%m-%d %H:%M') AS summary FROM s"""))
_found("logs.window", _ev(f"""SELECT event_id AS item_id, ts, CASE WHEN parse_status = 'failed' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, (row_number() OVER (ORDER BY ts, event_id) - 1)::INTEGER AS order_in_slice,
  source_id || ' · ' || parse_status || ' · ' || action || ' op_k' || k || ' user ' || user_id || ' value ' || value AS summary
FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, user_id, value FROM events) USING (event_id) WHERE {_IN_WINDOW} AND parse_status IN ('failed', 'partial')"""))
_found("logs.attribute-lift", _ev(f""", u AS ({_LIFTED}), c AS (SELECT field, value, count(*) FILTER ({_IN_WINDOW}) AS w, count(*) FILTER ({_IN_BASELINE}) AS b FROM u WHERE value <> '' GROUP BY ALL HAVING count(*) FILTER ({_IN_WINDOW}) > 0),
t AS (SELECT *, sum(w) OVER (PARTITION BY field) AS tw, sum(b) OVER (PARTITION BY field) AS tb FROM c), l AS (SELECT *, (w::DOUBLE / tw) / (b::DOUBLE / tb) AS lift FROM t WHERE b > 0)
SELECT 'lift:' || field || '=' || value AS item_id, TIMESTAMP '2024-01-29' AS ts, round(lift, 6) AS weight, (row_number() OVER (ORDER BY lift DESC, field, value) - 1)::INTEGER AS order_in_slice,
  field || '=' || value || ' · lift ' || regexp_replace(round(lift, 1)::DECIMAL(18, 1)::VARCHAR, '\\.0$', '') || '× · ' || w || ' events (baseline ' || b || ')' AS summary FROM l WHERE lift >= 1"""))
_found("logs.volume", _ev(f""", v AS (SELECT sig, count(*) FILTER ({_IN_WINDOW}) AS w, count(*) FILTER ({_IN_BASELINE}) AS b FROM ev GROUP BY sig HAVING count(*) FILTER ({_IN_WINDOW}) > 0),
z AS (SELECT *, b / 7.0::DOUBLE AS e, (w - b / 7.0::DOUBLE) / sqrt(b / 7.0::DOUBLE) AS z, (SELECT min_by(body, (ts, event_id)) FROM (SELECT ev.*, action || ' op_k' || k || ' user ' || user_id || ' value ' || value AS body
  FROM ev JOIN (SELECT event_id::VARCHAR AS event_id, user_id, value FROM events) USING (event_id)) m WHERE m.sig = v.sig AND {_IN_WINDOW}) AS body FROM v WHERE b > 0)
SELECT 'volume:' || sig AS item_id, TIMESTAMP '2024-01-29' AS ts, round(z, 6) AS weight, (row_number() OVER (ORDER BY z DESC, sig) - 1)::INTEGER AS order_in_slice,
  'volume ' || w || ' events, expected ' || regexp_replace(round(e, 1)::DECIMAL(18, 1)::VARCHAR, '\\.0$', '') || ' (z=' || regexp_replace(round(z, 1)::DECIMAL(18, 1)::VARCHAR, '\\.0$', '') || ') · ' || body AS summary FROM z WHERE z >= 1"""))
_found("change.feed", f"""WITH {_CHANGES}, c AS (SELECT ch.*, o_orderstatus FROM ch JOIN (SELECT o_orderkey::VARCHAR AS change_id, o_orderstatus FROM orders) USING (change_id)
  WHERE ts >= TIMESTAMP '2024-01-05' - INTERVAL {{lead}} SECOND AND ts < TIMESTAMP '2024-01-06')
SELECT change_id AS item_id, ts, round(CASE WHEN ts >= TIMESTAMP '2024-01-05' THEN 1 ELSE greatest(0, 1 - (epoch_us(TIMESTAMP '2024-01-05') - epoch_us(ts)) / 1e6 / {{lead}}) END::DOUBLE, 6) AS weight,
  (row_number() OVER (ORDER BY ts DESC, change_id DESC) - 1)::INTEGER AS order_in_slice, change_kind || ' · ' || target_id || ' · by team_' || o_orderstatus || ' — order ' || change_id AS summary FROM c""".format(lead=int(evidence.CHANGE_LEAD.total_seconds())), CorrelationWindow("2024-01-05", "2024-01-06", "2023-12-29", "2024-01-05"))


@_query("recent_bundles", """SELECT o_orderkey::VARCHAR AS bundle_id, o_orderdate AS gathered_at FROM orders
WHERE o_orderkey % 7 <> 0 AND 'grp_' || (o_custkey % 4) IN ('grp_1', 'grp_2') AND 'grp_' || (o_custkey % 3) IN ('grp_1', 'grp_2') ORDER BY o_orderdate DESC, bundle_id LIMIT 500""")
def _recent(spark, folder):
    """The newest bundles of a reader of two groups; five hundred are the most that are listed."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    groups = F.array_distinct(F.array(F.concat(F.lit("grp_"), cust % 4), F.concat(F.lit("grp_"), cust % 3)))
    stored = adapt.table(spark, folder, "orders").select(key.cast("string").alias("bundle_id"), F.col("o_orderdate").alias("gathered_at"), groups.alias("owner_groups"), (key % 7 == 0).alias("gathered_by_system"))
    return bundles.recent_bundles(stored, SOME, 1000).select("bundle_id", "gathered_at")


@_query("sample_coverage", _ev(f""", {_PARSED}, s AS (SELECT CASE WHEN event_id::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, parse_status FROM pb)
SELECT kind, count(*) FILTER (parse_status = 'ok') AS ok, count(*) FILTER (parse_status = 'partial') AS partial, count(*) FILTER (parse_status = 'failed') AS failed, count(*) FILTER (parse_status = 'failed') = 0 AS passed FROM s GROUP BY kind"""))
def _samples(spark, folder):
    """Device lines written as sample files, with comments and blank lines, and read again."""
    path = _new_folder(spark, "samples")
    number = F.col("event_id").cast("long")
    for kind, rest in (("even", 0), ("odd", 1)):
        lines = _lines(spark, folder).filter(number % 2 == rest).select(F.explode(F.array(F.col("body"), F.when(number % 10 < 2, F.concat(F.lit("# "), F.col("body"))).otherwise(""))).alias("value"))
        lines.write.text(f"{path}/{kind}")
    found = samples.sample_lines(spark, f"{path}/even").withColumn("file", F.lit("even")).unionByName(samples.sample_lines(spark, f"{path}/odd").withColumn("file", F.lit("odd")))
    return samples.sample_coverage(found, PARSERS).withColumnRenamed("file", "kind")
