"""The library's operators over the generic tables, one query each, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.functions import scores
from logmeridian.operators import alerts, correlate, coverage, detect, replay, search, views
from logmeridian.plans import evidence
from logmeridian.scope import AccessScope
from logmeridian.session import configure
from logmeridian.sources import adapt
from logmeridian.windows import ChangeQuery, CorrelationWindow, EventCursor, EventQuery, FieldFilter, instant

WINDOW = CorrelationWindow("2024-01-29", "2024-01-30", "2024-01-22", "2024-01-29")
MONTH = EventQuery("2024-01-01", "2024-01-31")
ALL = AccessScope.system()
SOME = AccessScope.groups("grp_1", "grp_2")
SIGNATURE = ["signature_hash", "signature_text"]
HOUR = 3600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_K = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER)"
_EVENTS = f"""ev AS (
  SELECT event_id::VARCHAR AS event_id, ts, ts + (event_id % 5) * INTERVAL 1 SECOND AS ingested_at,
         CASE WHEN event_id % 10 = 0 THEN 'observed' ELSE 'parsed' END AS time_source,
         'grp_' || (user_id % 4) AS owner_group, 'src_' || user_id AS source_id, 'host_' || (user_id % 7) AS host,
         ['Cisco', 'Fortinet', 'NGINX'][user_id % 3 + 1] AS vendor, ['ASA', 'FortiGate', 'nginx'][user_id % 3 + 1] AS product,
         ['asa.network', 'fortigate.traffic', 'nginx.combined'][user_id % 3 + 1] AS parser_id,
         CASE WHEN event_id % 20 = 0 THEN 'failed' WHEN event_id % 20 = 1 THEN 'partial' ELSE 'ok' END AS parse_status,
         CASE WHEN event_type = 'error' THEN 4 ELSE 1 END AS severity_num, [4001, 3002, 4002][user_id % 3 + 1] AS ocsf_class_uid,
         {_K} AS k, '10.0.' || (user_id % 256) || '.' || {_K} AS src_ip,
         CASE WHEN {_K} % 5 = 0 THEN '' ELSE '192.0.2.' || {_K} END AS dst_ip, {_K} + 1024 AS src_port, [443, 22, 8291, 53][{_K} % 4 + 1] AS dst_port,
         CASE WHEN {_K} % 3 = 0 THEN 'udp' ELSE 'tcp' END AS proto, event_type AS action,
         CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE '' END AS outcome,
         CASE WHEN {_K} % 2 = 0 THEN 'user' || user_id ELSE '' END AS user_name, '/p/' || ({_K} % 10) AS url_path,
         event_type || ' op_k' || {_K} || ' user <NUMBER> value <NUMBER>' AS sig
  FROM events)"""
_CHANGES = """ch AS (
  SELECT TIMESTAMP '2024-01-01' + (o_orderkey % 43200) * INTERVAL 1 MINUTE AS ts, o_orderkey::VARCHAR AS change_id,
         'grp_' || (o_custkey % 4) AS owner_group, 'src_' || (o_custkey % 150) AS target_id, substr(o_orderpriority, 3) AS change_kind
  FROM orders)"""
_IN_WINDOW = "ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30'"
_IN_BASELINE = "ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29'"
_IN_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        QUERIES[name] = configured
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def _ev(sql: str) -> str:
    return f"WITH {_EVENTS} {sql}"


@_query("first_seen_signatures", _ev(f"""SELECT sig AS signature_text, count(*) AS event_count, min(ts) AS first_seen_at, count(DISTINCT source_id) AS source_count
FROM ev WHERE {_IN_WINDOW} AND sig NOT IN (SELECT sig FROM ev WHERE {_IN_BASELINE}) GROUP BY sig"""))
def _first_seen(spark, folder):
    return correlate.first_seen(adapt.events(spark, folder), WINDOW, ALL, SIGNATURE).drop("signature_hash")


_VOLUME = f"""vol AS (SELECT sig AS signature_text, count(*) FILTER ({_IN_WINDOW}) AS window_count, count(*) FILTER ({_IN_BASELINE}) AS baseline_count
  FROM ev GROUP BY sig HAVING count(*) FILTER ({_IN_WINDOW}) > 0)"""


@_query("signature_volume", _ev(f", {_VOLUME} SELECT * FROM vol"))
def _volume(spark, folder):
    return correlate.signature_volume(adapt.events(spark, folder), WINDOW, ALL, SIGNATURE).select("signature_text", "window_count", "baseline_count")


@_query("signature_volume_zscore", _ev(f""", {_VOLUME}, z AS (SELECT *, baseline_count / 7.0::DOUBLE AS e FROM vol)
SELECT signature_text, window_count, baseline_count, round(e, 6) AS expected, round(CASE WHEN e <= 0 THEN 0 ELSE (window_count - e) / sqrt(e) END, 6) AS z_score
FROM z WHERE e > 0 AND (window_count - e) / sqrt(CASE WHEN e > 0 THEN e ELSE 1 END) >= 1"""))
def _zscore(spark, folder):
    out = correlate.volume_deviation(adapt.events(spark, folder), WINDOW, ALL, 1.0, 1, SIGNATURE)
    return out.select("signature_text", "window_count", "baseline_count", F.round("expected", 6).alias("expected"), F.round("z_score", 6).alias("z_score"))


_LIFT = ("source_id", "parser_id", "action", "proto")
_LIFT_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value, ts FROM ev" for f in _LIFT)


@_query("attribute_lift", _ev(f""", u AS ({_LIFT_SQL}), c AS (SELECT field, value, count(*) FILTER ({_IN_WINDOW}) AS w, count(*) FILTER ({_IN_BASELINE}) AS b
  FROM u WHERE value <> '' GROUP BY ALL HAVING count(*) FILTER ({_IN_WINDOW}) > 0), t AS (SELECT *, sum(w) OVER (PARTITION BY field) AS tw, sum(b) OVER (PARTITION BY field) AS tb FROM c)
SELECT field, value, w AS window_count, b AS baseline_count, round((w::DOUBLE / tw) / (b::DOUBLE / tb), 6) AS lift FROM t WHERE b > 0 AND (w::DOUBLE / tw) / (b::DOUBLE / tb) >= 1"""))
def _lift(spark, folder):
    out = correlate.attribute_lift(adapt.event_columns(spark, folder), WINDOW, ALL, _LIFT, min_lift=1.0, min_count=1)
    return out.select("field", "value", "window_count", "baseline_count", F.round("lift", 6).alias("lift"))


@_query("silent_sources", _ev(f"""SELECT owner_group, source_id, max(ingested_at) AS last_ingested_at, count(*) AS event_count, round(count(*) / 7.0::DOUBLE, 6) AS expected
FROM ev WHERE {_IN_BASELINE} AND source_id NOT IN (SELECT source_id FROM ev WHERE {_IN_WINDOW}) GROUP BY ALL HAVING count(*) >= 7"""))
def _silent(spark, folder):
    out = correlate.silent_sources(adapt.event_columns(spark, folder), WINDOW, ALL, 1.0)
    return out.select("owner_group", "source_id", "last_ingested_at", "event_count", F.round("expected", 6).alias("expected"))


@_query("propagation_order", _ev(f""", d AS (SELECT owner_group, source_id, min(ts) AS first_degraded_at, count(*) AS degraded_count, count(*) FILTER (time_source <> 'parsed') AS unreliable_time_count
  FROM ev WHERE {_IN_WINDOW} AND (parse_status = 'failed' OR severity_num >= 4) GROUP BY ALL)
SELECT *, (epoch_us(first_degraded_at) - (SELECT min(epoch_us(first_degraded_at)) FROM d)) / 1e6 AS lag_seconds FROM d"""))
def _propagation(spark, folder):
    onsets = correlate.propagation(adapt.event_columns(spark, folder), WINDOW, ALL)
    return correlate.with_lag(onsets).drop("weight").withColumn("lag_seconds", F.col("lag_seconds").cast("double"))


@_query("event_histogram", _ev(f"SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket_start, '' AS source_id, count(*) AS event_count FROM ev WHERE {_IN_MONTH} GROUP BY ALL"))
def _histogram(spark, folder):
    return search.histogram(adapt.event_columns(spark, folder), MONTH, ALL, HOUR)


@_query("histogram_by_source", _ev(f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS bucket_start, source_id, count(*) AS event_count FROM ev WHERE {_IN_MONTH} GROUP BY ALL"))
def _histogram_by_source(spark, folder):
    return search.histogram(adapt.event_columns(spark, folder), MONTH, ALL, 24 * HOUR, by_source=True)


_DENSE = f""", c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n FROM ev WHERE {_IN_MONTH} AND action = 'error' GROUP BY 1),
dense AS (SELECT g.b AS bucket_start, coalesce(n, 0) AS event_count FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS b) g LEFT JOIN c ON c.b = g.b)"""
ERRORS = EventQuery("2024-01-01", "2024-01-31", filters=(FieldFilter("action", "eq", ("error",)),))


@_query("dense_series", _ev(f"{_DENSE} SELECT * FROM dense"))
def _dense(spark, folder):
    return search.dense_series(adapt.event_columns(spark, folder), ERRORS, ALL, HOUR)


@_query("ratio_series", _ev(f"{_DENSE} SELECT d.bucket_start, d.event_count, d.event_count::DOUBLE / greatest(p.event_count, 1) AS ratio FROM dense d JOIN dense p ON p.bucket_start = d.bucket_start - INTERVAL 1 HOUR"))
def _ratio(spark, folder):
    return search.ratio_series(search.dense_series(adapt.event_columns(spark, folder), ERRORS, ALL, HOUR), HOUR)


@_query("source_gaps", _ev(f""", o AS (SELECT DISTINCT owner_group, source_id, epoch_us(ts) // 3600000000 * 3600 AS b FROM ev WHERE {_IN_MONTH}),
g AS (SELECT owner_group, source_id, coalesce(lag(b) OVER (PARTITION BY owner_group, source_id ORDER BY b) + 3600, epoch(TIMESTAMP '2024-01-01')::BIGINT) AS gap_from, b AS gap_to FROM o
  UNION ALL SELECT owner_group, source_id, max(b) + 3600, epoch(TIMESTAMP '2024-01-31')::BIGINT FROM o GROUP BY ALL)
SELECT owner_group, source_id, gap_from::BIGINT AS gap_from, gap_to::BIGINT AS gap_to, (gap_to - gap_from)::BIGINT AS gap_seconds FROM g WHERE gap_to > gap_from"""))
def _gaps(spark, folder):
    return search.source_gaps(adapt.event_columns(spark, folder), MONTH, ALL, HOUR)


_PAGE = EventQuery("2024-01-01", "2024-01-31", parse_statuses=("failed", "partial"), limit=100)


@_query("event_search_page", _ev(f"SELECT event_id, ts, source_id, parse_status FROM ev WHERE {_IN_MONTH} AND parse_status <> 'ok' AND owner_group IN ('grp_1', 'grp_2') ORDER BY ts DESC, event_id DESC LIMIT 101"))
def _page(spark, folder):
    return search.search_events(adapt.event_columns(spark, folder), _PAGE, SOME).select("event_id", "ts", "source_id", "parse_status")


@_query("keyset_page_2", _ev(f"SELECT event_id, ts, action FROM ev WHERE {_IN_MONTH} AND action = 'error' AND (ts, event_id) > (TIMESTAMP '2024-01-10 12:00:00', '500') ORDER BY ts, event_id LIMIT 51"))
def _page_2(spark, folder):
    query = EventQuery(MONTH.start, MONTH.end, filters=ERRORS.filters, limit=50, ascending=True, cursor=EventCursor("2024-01-10 12:00:00", "500"))
    return search.search_events(adapt.event_columns(spark, folder), query, ALL).select("event_id", "ts", "action")


@_query("field_filters", _ev(f"SELECT count(*) AS event_count FROM ev WHERE {_IN_MONTH} AND owner_group = 'grp_1' AND dst_port IN (22, 443) AND src_port > 1050 AND user_name LIKE 'user%' AND proto <> 'udp' AND src_ip LIKE '%.0.%'"))
def _filters(spark, folder):
    filters = (
        FieldFilter("dst_port", "in", ("22", "443")), FieldFilter("src_port", "gt", ("1050",)), FieldFilter("user_name", "startswith", ("user",)),
        FieldFilter("proto", "ne", ("udp",)), FieldFilter("src_ip", "contains", (".0.",)),
    )
    return search.count_events(adapt.event_columns(spark, folder), EventQuery(MONTH.start, MONTH.end, owner_groups=("grp_1", "grp_9"), filters=filters), SOME)


@_query("changes_newest", f"WITH {_CHANGES} SELECT ts, change_id, owner_group, target_id, change_kind FROM ch WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND owner_group IN ('grp_1', 'grp_2') AND change_kind IN ('HIGH', 'URGENT')")
def _changes(spark, folder):
    kinds = ChangeQuery("2024-01-10", "2024-01-20", change_kinds=("HIGH", "URGENT"))
    return search.search_changes(adapt.changes(spark, folder), kinds, SOME).select("ts", "change_id", "owner_group", "target_id", "change_kind")


@_query("scope_counts", _ev(f""", {_CHANGES} SELECT 'visible' AS what, count(*) AS n FROM ev WHERE {_IN_MONTH} AND owner_group IN ('grp_1', 'grp_2')
UNION ALL SELECT 'hidden', count(*) FROM ev WHERE {_IN_MONTH} AND owner_group NOT IN ('grp_1', 'grp_2') UNION ALL SELECT 'nothing', 0
UNION ALL SELECT 'hidden changes', count(*) FROM ch WHERE {_IN_MONTH} AND owner_group NOT IN ('grp_1', 'grp_2')"""))
def _scope_counts(spark, folder):
    events = adapt.event_columns(spark, folder)
    hidden_changes = search.count_changes_out_of_scope(adapt.changes(spark, folder), ChangeQuery(MONTH.start, MONTH.end), SOME)
    named = lambda what, df: df.select(F.lit(what).alias("what"), F.col(df.columns[0]).alias("n"))
    return (
        named("visible", search.count_events(events, MONTH, SOME))
        .unionByName(named("hidden", search.count_events_out_of_scope(events, MONTH, SOME)))
        .unionByName(named("nothing", search.count_events(events, MONTH, AccessScope.nothing())))
        .unionByName(named("hidden changes", hidden_changes))
    )


@_query("source_activity", _ev(f"SELECT owner_group, source_id, max(ts) AS last_ts, max(ingested_at) AS last_ingested_at, count(*) AS event_count FROM ev WHERE {_IN_MONTH} GROUP BY ALL"))
def _activity(spark, folder):
    return search.activity(adapt.event_columns(spark, folder), MONTH, ALL)


@_query("window_trust", _ev(f"SELECT count(*) AS total_events, count(*) FILTER (time_source <> 'parsed') AS unreliable_events, count(*) FILTER (time_source <> 'parsed') / count(*)::DOUBLE AS unreliable_ratio FROM ev WHERE {_IN_WINDOW}"))
def _trust(spark, folder):
    return correlate.window_trust(adapt.event_columns(spark, folder), WINDOW, ALL)


@_query("ocsf_view", _ev("SELECT ts AS time, event_id AS uid, ocsf_class_uid::BIGINT AS class_uid, severity_num::SMALLINT AS severity_id, src_ip AS src_endpoint_ip, dst_port AS dst_endpoint_port, proto AS connection_info_protocol_name, action AS activity_name, outcome AS status FROM ev"))
def _ocsf(spark, folder):
    view = views.ocsf_view(adapt.event_columns(spark, folder))
    return view.select("time", "uid", "class_uid", "severity_id", "src_endpoint_ip", "dst_endpoint_port", "connection_info_protocol_name", "activity_name", "status")


@_query("otel_view", _ev("""SELECT ts AS "Timestamp", event_id AS "LogRecordUID", host AS "host.name", vendor AS "device.manufacturer", CASE severity_num WHEN 4 THEN 17 WHEN 1 THEN 9 END AS "SeverityNumber" FROM ev"""))
def _otel(spark, folder):
    return views.otel_view(adapt.event_columns(spark, folder)).select("Timestamp", "LogRecordUID", "`host.name`", "`device.manufacturer`", "SeverityNumber")


@_query("change_proximity", f"""WITH {_CHANGES} SELECT change_id, round(CASE WHEN ts >= TIMESTAMP '2024-01-01 12:00:00' THEN 1 ELSE 1 - (epoch(TIMESTAMP '2024-01-01 12:00:00') - epoch(ts)) / 1800.0 END::DOUBLE, 6) AS proximity
FROM ch WHERE ts >= TIMESTAMP '2024-01-01 11:30:00' AND ts < TIMESTAMP '2024-01-01 15:00:00'""")
def _proximity(spark, folder):
    near = search.search_changes(adapt.changes(spark, folder), ChangeQuery("2024-01-01 11:30:00", "2024-01-01 15:00:00"), ALL)
    return near.select("change_id", F.round(scores.change_proximity(F.col("ts"), instant("2024-01-01 12:00:00"), 1800), 6).alias("proximity"))


_SWEEP_SQL = " UNION ALL ".join(
    f"SELECT {d * 86400}::BIGINT AS baseline_seconds, count(*) FILTER (l IS NULL OR l < TIMESTAMP '2024-01-29' - INTERVAL {d} DAY) AS first_seen_count, count(*) AS window_signatures FROM s" for d in (1, 3, 7, 14)
)


@_query("baseline_sweep", _ev(f""", s AS (SELECT sig, max(ts) FILTER (ts < TIMESTAMP '2024-01-29') AS l FROM ev WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-30' GROUP BY sig HAVING count(*) FILTER ({_IN_WINDOW}) > 0) {_SWEEP_SQL}"""))
def _sweep(spark, folder):
    lengths = [timedelta(days=d) for d in (1, 3, 7, 14)]
    out = correlate.baseline_sweep(adapt.events(spark, folder), WINDOW.start, WINDOW.end, lengths, ALL, reach=timedelta(days=1), signature=SIGNATURE)
    return out.select("baseline_seconds", "first_seen_count", "window_signatures")


_COVERED = {"dst_ip": "dst_ip <> ''", "user_name": "user_name <> ''", "outcome": "outcome <> ''", "src_port": "src_port <> 0"}
_COVERAGE_SQL = " UNION ALL ".join(f"SELECT vendor, '{c}' AS field, count(*) AS events, count(*) FILTER ({p}) AS populated FROM ev GROUP BY vendor" for c, p in _COVERED.items())


@_query("field_coverage", _ev(_COVERAGE_SQL))
def _coverage(spark, folder):
    return coverage.field_coverage(adapt.event_columns(spark, folder), {"dst_ip": "address", "user_name": "text", "outcome": "text", "src_port": "number"})


@_query("attr_key_counts", _ev("SELECT vendor, attr_key, count(*) AS events FROM (SELECT vendor, unnest(['k', 'otel.url.path']) AS attr_key FROM ev) GROUP BY ALL"))
def _attr_keys(spark, folder):
    return coverage.attribute_key_counts(adapt.event_columns(spark, folder))


@_query("never_together", _ev("""SELECT * FROM (SELECT 'dst_ip' AS a, 'outcome' AS b, count(*) FILTER (dst_ip <> '' AND outcome <> '') AS n FROM ev
UNION ALL SELECT 'dst_ip', 'user_name', count(*) FILTER (dst_ip <> '' AND user_name <> '') FROM ev UNION ALL SELECT 'outcome', 'user_name', count(*) FILTER (outcome <> '' AND user_name <> '') FROM ev) ORDER BY n"""))
def _together(spark, folder):
    return coverage.populated_together(adapt.event_columns(spark, folder), {"dst_ip": "address", "user_name": "text", "outcome": "text"})


_RULES_SQL = {
    "failed-login": "vendor = 'Fortinet' AND action = 'login' AND outcome = ''",
    "error-burst": "severity_num >= 4 AND lower(action) LIKE 'err%'",
    "ssh-or-winbox": "dst_port IN (22, 8291)",
    "internal-peer": "src_ip LIKE '10.0.1.%'",
    "web-path": "vendor = 'NGINX' AND url_path = '/p/7'",
}


@_query("detection_hits", _ev(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, owner_group, count(*) AS hits FROM ev WHERE {_IN_MONTH} AND {p} GROUP BY owner_group" for r, p in _RULES_SQL.items())))
def _detections(spark, folder):
    hits = detect.detections(adapt.event_columns(spark, folder).filter(MONTH_ROWS), detect.example_rules())
    return hits.groupBy("rule_id", "owner_group").agg(F.count(F.lit(1)).alias("hits"))


MONTH_ROWS = "ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-31 00:00:00'"
NOW = "2024-01-29 12:00:00"
_RULES = (
    alerts.Rule("errors", "threshold", 6 * HOUR, 10.0, ">=", ("grp_0", "grp_1"), "action = 'error'"),
    alerts.Rule("purchases", "ratio", 24 * HOUR, 1.0, ">", (), "action = 'purchase'"),
    alerts.Rule("failed", "threshold", 24 * HOUR, 1_000_000.0, "<", (), "parse_status = 'failed'"),
)


def _alert_sql(rule: alerts.Rule) -> str:
    groups = f"AND owner_group IN ({', '.join(repr(g) for g in rule.owner_groups)})" if rule.owner_groups else ""
    count = lambda a, b: f"count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL {a} SECOND AND ts < TIMESTAMP '{NOW}' - INTERVAL {b} SECOND)"
    w = rule.window_seconds
    value = f"{count(w, 0)}::DOUBLE" if rule.kind == "threshold" else f"{count(w, 0)}::DOUBLE / greatest({count(2 * w, w)}, 1)"
    return f"SELECT '{rule.id}' AS rule_id, {value} AS value, {value} {rule.comparison} {rule.threshold} AS fired FROM ev WHERE {rule.predicate} {groups}"


@_query("alert_threshold_ratio", _ev(" UNION ALL ".join(map(_alert_sql, _RULES))))
def _alerts(spark, folder):
    return alerts.evaluate(adapt.event_columns(spark, folder), _RULES, NOW)


@_query("alert_silence", _ev(f""", inv AS (SELECT 'src_' || c_custkey AS source_id, 'grp_' || (c_custkey % 4) AS owner_group FROM customer WHERE c_acctbal > 0),
act AS (SELECT source_id, max(ingested_at) AS last_at FROM ev WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1)
SELECT inv.owner_group, inv.source_id, act.last_at IS NULL AS never_seen, floor(greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(act.last_at, TIMESTAMP '2024-01-01'))))::BIGINT AS silent_seconds
FROM inv LEFT JOIN act USING (source_id) WHERE floor(greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(act.last_at, TIMESTAMP '2024-01-01'))))::BIGINT >= 86400"""))
def _silence(spark, folder):
    return alerts.silent_inventory(adapt.inventory(spark, folder), adapt.event_columns(spark, folder), NOW, 86400)


_TRIGGERS = """tr AS (SELECT 'rule_' || (o_custkey % 50) AS rule_id, ' grp_' || (o_custkey % 4) || ',, grp_' || (o_custkey % 3) AS owner_group, TIMESTAMP '2024-01-01' + (o_orderkey % 43200) * INTERVAL 1 MINUTE AS fired_at, o_orderkey::VARCHAR AS id FROM orders),
mw AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'rule_' || n_nationkey END AS rule_id, CASE WHEN n_nationkey % 2 = 1 THEN 'grp_' || (n_nationkey % 4) END AS owner_group,
  TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 1 DAY AS starts_at, TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 1 DAY + INTERVAL 4 HOUR AS ends_at FROM nation)"""


@_query("alert_suppression", f"""WITH RECURSIVE {_TRIGGERS}, h AS (SELECT DISTINCT id FROM tr JOIN mw ON starts_at <= fired_at AND fired_at < ends_at
    AND (mw.rule_id = tr.rule_id OR (mw.rule_id IS NULL AND list_contains(list_transform(string_split(tr.owner_group, ','), lambda g: trim(g)), mw.owner_group)))),
free AS (SELECT DISTINCT rule_id, fired_at FROM tr WHERE id NOT IN (SELECT id FROM h)),
chain AS (SELECT rule_id, min(fired_at) AS fired_at FROM free GROUP BY rule_id UNION ALL
  SELECT chain.rule_id, min(free.fired_at) FROM chain JOIN free ON free.rule_id = chain.rule_id AND free.fired_at >= chain.fired_at + INTERVAL 10 MINUTE GROUP BY chain.rule_id)
SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'maintenance' WHEN chain.fired_at IS NULL THEN 'repeat' ELSE '' END AS reason FROM tr LEFT JOIN chain USING (rule_id, fired_at)""")
def _suppression(spark, folder):
    key, nation = F.col("o_custkey"), F.col("n_nationkey")
    triggers = adapt.table(spark, folder, "orders").select(
        F.concat(F.lit("rule_"), key % 50).alias("rule_id"), F.concat(F.lit(" grp_"), key % 4, F.lit(",, grp_"), key % 3).alias("owner_group"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, o_orderkey % 43200, 0)").alias("fired_at"), F.col("o_orderkey").cast("string").alias("id"),
    )
    windows = adapt.table(spark, folder, "nation").select(
        F.when(nation % 2 == 0, F.concat(F.lit("rule_"), nation)).alias("rule_id"), F.when(nation % 2 == 1, F.concat(F.lit("grp_"), nation % 4)).alias("owner_group"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(n_nationkey, 0, 0, 0)").alias("starts_at"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(n_nationkey, 4, 0, 0)").alias("ends_at"),
    )
    return alerts.suppression(triggers, windows, 600)


_REBUILT = """old AS (SELECT event_id, parse_status, action, user_name, outcome FROM ev WHERE CAST(event_id AS BIGINT) % 7 <> 0),
new AS (SELECT event_id, CASE WHEN parse_status = 'failed' AND k % 2 = 0 THEN 'ok' ELSE parse_status END AS parse_status, upper(action) AS action, user_name, CASE WHEN k % 3 = 0 THEN 'success' ELSE outcome END AS outcome
  FROM ev WHERE CAST(event_id AS BIGINT) % 11 <> 0)"""
_FIELDS = ("parse_status", "action", "user_name", "outcome")


def _sides(spark, folder):
    events = adapt.event_columns(spark, folder)
    k, number = F.col("attrs")["k"].cast("int"), F.col("event_id").cast("long")
    old = events.filter(number % 7 != 0).select("event_id", *_FIELDS)
    new = events.filter(number % 11 != 0).select(
        "event_id", F.when((F.col("parse_status") == "failed") & (k % 2 == 0), "ok").otherwise(F.col("parse_status")).alias("parse_status"),
        F.upper("action").alias("action"), "user_name", F.when(k % 3 == 0, "success").otherwise(F.col("outcome")).alias("outcome"),
    )
    return old, new


@_query("replay_diff", _ev(f""", {_REBUILT}, j AS (SELECT n.event_id, o.event_id IS NULL AS is_new, {', '.join(f'coalesce(o.{f} <> n.{f}, false) AS c_{f}' for f in _FIELDS)} FROM new n LEFT JOIN old o USING (event_id))
SELECT event_id, CASE WHEN is_new THEN 'new' WHEN {' OR '.join(f'c_{f}' for f in _FIELDS)} THEN 'changed' ELSE 'unchanged' END AS state,
  concat_ws(',', {', '.join(f"CASE WHEN c_{f} THEN '{f}' END" for f in _FIELDS)}) AS fields FROM j"""))
def _replay_diff(spark, folder):
    diff = replay.diff(*_sides(spark, folder), _FIELDS)
    return diff.select("event_id", "state", F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"))


@_query("replay_report", _ev(f""", {_REBUILT}, j AS (SELECT o.event_id IS NULL AS is_new, o.parse_status AS was, n.parse_status AS is_, {' OR '.join(f'coalesce(o.{f} <> n.{f}, false)' for f in _FIELDS)} AS changed FROM new n LEFT JOIN old o USING (event_id))
SELECT count(*) AS replayed, count(*) FILTER (is_new) AS added, count(*) FILTER (NOT is_new AND changed) AS changed, count(*) FILTER (NOT is_new AND NOT changed) AS unchanged,
  count(*) FILTER (changed AND was = 'failed' AND is_ <> 'failed') AS failed_to_ok, count(*) FILTER (changed AND was <> 'failed' AND is_ = 'failed') AS ok_to_failed FROM j"""))
def _replay_report(spark, folder):
    return replay.report(replay.diff(*_sides(spark, folder), _FIELDS))


@_query("replay_merge", _ev(f", {_REBUILT} SELECT * FROM new UNION ALL SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM new)"))
def _replay_merge(spark, folder):
    return replay.merge(*_sides(spark, folder))


@_query("day_partitions", _ev(f"SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS events FROM ev WHERE {_IN_MONTH} GROUP BY 1"))
def _days(spark, folder):
    return replay.partitions(adapt.event_columns(spark, folder), MONTH.start, MONTH.end)


@_query("source_inventory", """SELECT 'src_' || c_custkey AS source_id, 'grp_' || (c_custkey % 4) AS owner_group, c_custkey % 2 = 0 AS has_parser FROM customer WHERE c_custkey % 4 IN (1, 2)""")
def _inventory(spark, folder):
    return search.search_sources(adapt.inventory(spark, folder), SOME).select("source_id", "owner_group", "has_parser")


def _inputs(spark, folder, budget: int | None = 400) -> evidence.Inputs:
    return evidence.Inputs(
        adapt.events(spark, folder), adapt.changes(spark, folder), WINDOW, ALL, budget, min_z=1.0, min_count=1, min_lift=1.0, min_expected=1.0, label="signature_text", now=WINDOW.end
    )


@_query("evidence_ranked")
def evidence_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The ranked report of one incident window: a top-k report of at most 400 findings per provider."""
    return evidence.rank(evidence.gather(_inputs(spark, folder)).findings)


@_query("evidence_slices")
def _slices(spark, folder):
    return evidence.gather(_inputs(spark, folder)).slices


@_query("masked_signatures", _ev("SELECT sig AS signature_text, count(*) AS events FROM ev GROUP BY 1"))
def _masked(spark, folder):
    return adapt.events(spark, folder).groupBy("signature_text").agg(F.count(F.lit(1)).alias("events"))
