"""Queries on changes, configurations, decoding, batches, health figures and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.operators import changes, coverage, health, parse
from logmeridian.parsing_queries import _PARSED, PARSERS, _lines
from logmeridian.queries import _ev, _query
from logmeridian.sources import adapt, decode, otlp
from logmeridian.streaming import live


def _payloads(spark, folder) -> DataFrame:
    """Orders as payloads of build servers: five kinds that map, one that is no object, one that is unknown."""
    kind, final = F.col("o_orderkey") % 7, F.col("o_orderstatus") != "O"
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pick = lambda yes, no: F.when(final, yes).otherwise(no)
    repository = ('"repository":{"full_name":"org/r', cust, '"},"sender":{"login":"s', cust, '"}')
    body = (
        F.when(kind == 0, text('{"action":"', pick("completed", "requested"), '",', *repository, ',"workflow_run":{"name":"build","run_number":', key,
                               ',"conclusion":"success","updated_at":"2024-01-05T10:00:00Z","html_url":"u', key, '","id":', key, "}}"))
        .when(kind == 1, text("{", *repository, ',"deployment_status":{"state":"', pick("success", "pending"), '","environment":"prod","updated_at":"2024-01-05T10:00:00Z"}}'))
        .when(kind == 2, text("{", *repository, ',"ref":"main","pusher":{"name":"p', cust, '"},"head_commit":',
                              pick('{"id":"c","message":"line one\\nline two","timestamp":"2024-01-05T12:00:00+02:00"}', "null"), "}"))
        .when(kind == 3, text('{"name":"job', cust, '","build":{"number":', key, ',"phase":"', pick("COMPLETED", "STARTED"), '","status":"SUCCESS","timestamp":1704448800000}}'))
        .when(kind == 4, text('{"object_kind":"pipeline","project":{"path_with_namespace":"grp/p', cust, '"},"object_attributes":{"id":', key, ',"ref":"main","status":"',
                              pick("success", "running"), '","finished_at":"2024-01-05 10:00:00 UTC"}}'))
        .when(kind == 5, "[1]").otherwise("{}")
    )
    provider = F.when(kind == 3, "jenkins").when(kind == 4, "gitlab").otherwise("github")
    event = F.when(kind == 0, "workflow_run").when(kind == 1, "deployment_status").when(kind == 2, "push").when(kind == 6, "ping")
    return adapt.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), provider.alias("provider"), event.alias("event"), F.when(kind.isin(0, 1, 2, 6), F.concat(F.lit("d"), key)).alias("delivery"),
        body.alias("body"), F.lit("deploy").alias("default_kind"), F.expr("TIMESTAMP_NTZ '2024-02-01'").alias("received_at"),
    )


@_query("change_mapping", """WITH o AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, o_orderkey % 7 AS kind, o_orderstatus <> 'O' AS fin FROM orders),
m AS (SELECT *, fin AND kind < 5 AS ok FROM o)
SELECT id, CASE WHEN ok THEN 'mapped' WHEN kind = 5 THEN 'invalid' ELSE 'ignored' END AS outcome,
CASE WHEN kind IN (0, 1, 2, 6) THEN 'd' || k WHEN kind = 3 THEN 'job' || c || '#' || k || CASE WHEN ok THEN ':SUCCESS' ELSE '' END WHEN kind = 4 AND ok THEN 'pipeline:' || k || ':success' ELSE '' END AS delivery_id,
CASE WHEN ok THEN TIMESTAMP '2024-01-05 10:00:00' END AS ts, CASE WHEN ok THEN CASE kind WHEN 3 THEN 'job' || c WHEN 4 THEN 'grp/p' || c ELSE 'org/r' || c END END AS target_id,
CASE WHEN ok THEN CASE kind WHEN 2 THEN 'config_push' ELSE 'deploy' END END AS change_kind, CASE WHEN ok THEN CASE kind WHEN 2 THEN 'p' || c WHEN 3 THEN '' WHEN 4 THEN '' ELSE 's' || c END END AS actor,
CASE WHEN ok THEN CASE kind WHEN 0 THEN 'build #' || k || ' → success' WHEN 1 THEN 'prod dağıtımı → success' WHEN 2 THEN 'line one' WHEN 3 THEN 'job' || c || ' #' || k || ' → SUCCESS' ELSE 'Pipeline #' || k || ' (main) → success' END END AS summary,
CASE WHEN ok THEN CASE kind WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END END AS n_details FROM m""")
def _change_mapping(spark, folder):
    out = changes.map_changes(_payloads(spark, folder))
    size = F.when(F.col("details").isNotNull(), F.size("details"))
    return out.select("id", "outcome", "delivery_id", "ts", "target_id", "change_kind", "actor", "summary", size.alias("n_details"))


@_query("first_deliveries", """WITH d AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderdate FROM orders)
SELECT id, o_custkey AS connector FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, id) AS n FROM d) WHERE n = 1""")
def _first_deliveries(spark, folder):
    d = adapt.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("connector"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("at"))
    return changes.first_deliveries(d, ("connector", "kind"), ("at", "id")).select("id", "connector")


@_query("snapshots_retained", """WITH s AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT id, o_custkey AS connector FROM s WHERE n = 1 OR o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 97 = 0)""")
def _retained(spark, folder):
    o = adapt.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("connector"), F.col("o_orderdate").alias("taken_at"))
    cutoff = o.where("id % 97 = 0").agg(F.max("taken_at")).first()[0]
    return changes.retained(o, F.lit(cutoff)).select("id", "connector")


_SHA = lambda value: f"'<gizli:' || substr(sha256({value}), 1, 8) || '>'"
_CONFIG_ROWS = {
    0: [(1, "'system admin'", "'config system admin'"), (2, "'system admin / a' || k", "'edit \"a' || k || '\"'"), (3, "'system admin / a' || k", "'set password ENC ' || " + _SHA("'pw' || (k::BIGINT % 7)")),
        (4, "'system admin / a' || k", "'next'"), (5, "'(kök)'", "'end'"), (7, "'(kök)'", "'set tail ' || k")],
    1: [(2, "'hostname fw' || k", "'hostname fw' || k"), (3, "'interface Gi0'", "'interface Gi0'"), (4, "'interface Gi0'", "'nameif in'"),
        (5, "'snmp-server community ' || " + _SHA("'c' || (k::BIGINT % 5)"), "'snmp-server community ' || " + _SHA("'c' || (k::BIGINT % 5)"))],
    2: [(1, "'ip firewall filter'", "'/ip firewall filter'"), (2, "'ip firewall filter'", "'add chain=' || k"), (4, "'user'", "'/user'"), (5, "'user'", "'add password=' || " + _SHA("'x' || (k::BIGINT % 3)"))],
}


@_query("config_lines", "WITH c AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS k FROM customer) " + " UNION ALL ".join(
    f"SELECT id, {n} AS line_no, {section} AS section, {line} AS line FROM c WHERE id % 3 = {v}" for v, rows in _CONFIG_ROWS.items() for n, section, line in rows))
def _config_lines(spark, folder):
    k = F.col("c_custkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit('#buildno=1\nconfig system admin\n    edit "a'), k, F.lit('"\n        set password ENC pw'), k % 7, F.lit("\n    next\nend\n#\nset tail "), k, F.lit(" \t\r")))
        .when(k % 3 == 1, F.concat(F.lit(": Saved\n!\nhostname fw"), k, F.lit('\ninterface Gi0\n nameif in\nsnmp-server community "c'), k % 5, F.lit('"\nCryptochecksum:ab')))
        .otherwise(F.concat(F.lit("# aug/18/2026 10:32:11 by RouterOS 7.1\n/ip firewall filter\nadd chain="), k, F.lit("\n\n/user\nadd password=x"), k % 3 + 0 * k))
    )
    vendor = F.when(k % 3 == 0, "fortinet.fortigate").when(k % 3 == 1, "cisco.asa").otherwise("mikrotik.routeros")
    return changes.config_lines(adapt.table(spark, folder, "customer").select(k.alias("id"), vendor.alias("vendor"), text.alias("text")))


@_query("decode_text", """SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE ['utf-8', 'utf-16', 'windows-1254', 'utf-8'][doc_id % 4 + 1] END AS encoding,
CASE WHEN text IS NOT NULL THEN doc_id % 4 < 2 END AS declared_honored, sha256(CASE WHEN doc_id % 4 = 2 THEN 'ı' || sha256(text) ELSE nfc_normalize(text) END) AS text_sha FROM documents""")
def _decode(spark, folder):
    kind, text = F.col("doc_id") % 4, F.col("text")
    raw = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == 2, F.concat(F.unhex(F.lit("FD")), F.encode(F.sha2(text, 256), "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    docs = adapt.table(spark, folder, "documents").select("doc_id", raw.alias("raw"), F.when(kind == 2, "utf-8").when(kind == 3, "no-such").alias("said"))
    return decode.decode_text(docs, "raw", F.col("said")).select("doc_id", "encoding", "declared_honored", F.sha2("text", 256).alias("text_sha"))


@_query("otlp_records", """WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS us, user_id % 2 = 0 AS even FROM events)
SELECT event_id, make_timestamp(us) AS observed_at, CASE WHEN even THEN '10.0.0.' || (user_id % 256) ELSE 'h' || user_id END AS source_key, 9 AS severity_number, event_type AS body, CASE WHEN even THEN 3 ELSE 2 END AS n_attributes, '6' AS n FROM e
UNION ALL SELECT event_id, make_timestamp(us + 1000000), 'h' || user_id, 255, '', 1, NULL FROM e""")
def _otlp(spark, folder):
    user, micros = F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp"))
    peer = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"key":"client.address","value":{"stringValue":"10.0.0.'), F.col("user_id") % 256, F.lit('"}},'))).otherwise("")
    payload = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"h'), user, F.lit('"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"'), micros,
        F.lit('000","severityNumber":9,"body":{"stringValue":"'), "event_type", F.lit('"},"attributes":['), peer,
        F.lit('{"key":"n","value":{"intValue":"5"}},{"key":"n","value":{"intValue":"6"}}]}]},{"logRecords":[{"timeUnixNano":"0","observedTimeUnixNano":"'), micros + 1_000_000,
        F.lit('000","severityNumber":300,"extra":[1]}]}]}]}'),
    )
    out = otlp.log_records(adapt.table(spark, folder, "events").select("event_id", payload.alias("payload")))
    return out.select("event_id", "observed_at", "source_key", "severity_number", "body", F.size("attributes").alias("n_attributes"), F.try_element_at("attributes", F.lit("n")).alias("n"))


def _parsed(spark, folder) -> DataFrame:
    bound = F.when(F.col("event_id").cast("long") % 4 == 0, "web")
    return parse.parse_events(_lines(spark, folder).select("event_id", "source_id", "body", bound.alias("bound")), PARSERS, bound="bound")


@_query("dispatch_health", _ev(f""", {_PARSED}, t AS (SELECT parser_id, event_id::BIGINT % 4 = 0 AS tied, event_id::BIGINT % 4 = 0 AND parser_id = 'web' AS own FROM pb)
SELECT count(*) FILTER (own) AS bound, count(*) FILTER (parser_id <> '' AND NOT own) AS candidate, count(*) FILTER (parser_id = '') AS unmatched, count(*) FILTER (tied AND NOT own) AS bound_misses, count(*) AS total,
count(*) FILTER (own) / count(*)::DOUBLE AS bound_ratio, count(*) FILTER (parser_id = '') / count(*)::DOUBLE AS unmatched_ratio, count(*) FILTER (own) / count(*)::DOUBLE >= 0.95 AS on_target FROM t"""))
def _dispatch(spark, folder):
    return health.dispatch_health(_parsed(spark, folder), "bound")


@_query("parser_coverage", _ev(f""", {_PARSED} SELECT source_id, count(*) FILTER (parse_status = 'ok') AS ok, count(*) FILTER (parse_status = 'partial') AS partial, count(*) FILTER (parse_status = 'failed') AS failed,
count(*) AS total, round(count(*) FILTER (parse_status = 'ok') * 100.0::DOUBLE / count(*), 4) AS ok_percent FROM pb GROUP BY source_id"""))
def _parser_coverage(spark, folder):
    return health.parser_coverage(_parsed(spark, folder), "source_id").withColumn("ok_percent", F.col("ok_percent").cast("double"))


@_query("parser_wins", _ev(f", {_PARSED} SELECT parser_id, count(*) AS wins FROM pb WHERE parser_id <> '' GROUP BY parser_id"))
def _wins(spark, folder):
    return health.parser_wins(_parsed(spark, folder))


@_query("review_quality", """WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS v FROM labels), t AS (SELECT count(*) AS total, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'unknown') AS unknown FROM r)
SELECT total, correct, unknown, total - unknown AS decided, correct / nullif(total - unknown, 0)::DOUBLE AS accuracy, unknown / nullif(total, 0)::DOUBLE AS unknown_ratio FROM t""")
def _reviews(spark, folder):
    verdict = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "correct").otherwise("wrong")
    return health.review_quality(adapt.table(spark, folder, "labels").select(verdict.alias("verdict")))


@_query("substituted_values", _ev("""SELECT vendor, 'action' AS field, count(*) AS populated, 0 AS substituted FROM ev GROUP BY vendor UNION ALL
SELECT vendor, 'user_name', count(*) FILTER (user_name <> ''), count(*) FILTER (user_name <> '') FROM ev GROUP BY vendor UNION ALL SELECT vendor, 'product', count(*), count(*) FROM ev GROUP BY vendor"""))
def _substituted(spark, folder):
    return health.substituted_values(adapt.event_columns(spark, folder), {"action": "text", "user_name": "text", "product": "text"})


@_query("relocated_attributes", _ev(""", a AS (SELECT vendor, 'k' AS attr_key, k::VARCHAR AS value, 1 AS line, [source_id, dst_port::VARCHAR, user_name] AS vs FROM ev UNION ALL SELECT vendor, 'otel.url.path', url_path, 0, [source_id, dst_port::VARCHAR, user_name] FROM ev)
SELECT vendor, attr_key, count(*) AS events, sum(line)::BIGINT AS from_line, 0 AS case_variants, min(value) AS sample FROM a WHERE NOT list_contains(vs, value) GROUP BY vendor, attr_key"""))
def _relocated(spark, folder):
    return health.relocated_attributes(adapt.event_columns(spark, folder), ("source_id", "dst_port", "user_name"))


@_query("empty_columns", _ev("SELECT 'proto' AS field, NULL::VARCHAR AS vendor WHERE EXISTS (SELECT 1 FROM ev) UNION ALL SELECT 'outcome', 'NGINX' WHERE EXISTS (SELECT 1 FROM ev WHERE vendor = 'NGINX')"))
def _empty(spark, folder):
    e = adapt.event_columns(spark, folder).withColumns({"proto": F.lit(""), "outcome": F.when(F.col("vendor") == "NGINX", "").otherwise(F.col("outcome"))})
    return health.empty_columns(coverage.field_coverage(e, {"proto": "text", "outcome": "text", "action": "text"}))


@_query("live_histogram", """SELECT to_timestamp(epoch_us(ts) // 3600000000 * 3600)::TIMESTAMP AS bucket_start, count(*) AS event_count FROM events GROUP BY 1
HAVING to_timestamp(epoch_us(min(ts)) // 3600000000 * 3600 + 3600)::TIMESTAMP <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def _live(spark, folder):
    """All buckets that are final when the table, read as a stream, has been read to its end."""
    return live.drain(live.histogram(_arriving(spark, folder), 3600), "histogram")


@_query("live_deliveries", "SELECT DISTINCT user_id, event_type FROM events")
def _deliveries(spark, folder):
    once = live.without_repeats(_arriving(spark, folder), ("user_id", "event_type"))
    return live.drain(once.select("user_id", "event_type"), "deliveries")


def _arriving(spark, folder) -> DataFrame:
    return spark.readStream.schema(adapt.table(spark, folder, "events").schema).parquet(f"{folder}/events[.]parquet")  # as a pattern: a stream takes no single file by its name
