"""Parsing, normalising and configuration operators over the generic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.functions import steps as S
from logmeridian.operators import config, parse
from logmeridian.queries import _ev, _query
from logmeridian.sources import adapt

_STATUS = {"200": "success", "404": "failure"}
WEB = S.Grok(patterns=(
    r'^%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:at}\] "%{WORD:method} %{NOTSPACE:path} HTTP/%{NUMBER:version}" %{NUMBER:response:int} (?:%{NUMBER:bytes:long}|-) "%{DATA:referrer}" "%{DATA:agent}"$',
))
FIREWALL = S.Grok(patterns=(r"%ASA-%{INT:level:int}-%{INT:code}: Deny %{WORD:proto} src %{WORD}:%{IPV4:src_ip}/%{INT:src_port} dst %{WORD}:%{IPV4:dst_ip}/%{INT:dst_port}",))
PAIRS = S.KeyValue(exclude=("devname",))
PARSERS = (
    parse.Parser("web", (WEB, S.Date(field="at", formats=("dd/MMM/yyyy:HH:mm:ss xx",)), S.Drop(names=("ident",))), ('HTTP/1.1"',), 50,
                 {"src_ip": "{{ clientip }}", "action": "{{ method }}", "outcome": parse.Lookup("response", _STATUS, "other"), "host": "", "dst_port": "443"}),
    parse.Parser("traffic", (PAIRS, S.Date(field="eventtime", formats=("UNIX_AUTO",), on_failure="tag", tag="_date_failure")), ("srcip=",), 40,
                 {"src_ip": "{{srcip}}", "dst_port": "{{ dstport }}", "action": "{{ action }}", "host": "{{ msg }}/{{ missing }}"}),
    parse.Parser("firewall", (FIREWALL,), ("%ASA-",), 40, {"src_ip": "{{ src_ip }}", "dst_port": "{{dst_port}}", "action": "deny {{ proto }}", "host": "fw"}),
)


def _lines(spark, folder) -> DataFrame:
    """Events written out as the lines of three kinds of device, some of them damaged."""
    e, k = adapt.event_columns(spark, folder), F.col("attrs")["k"]
    number, cat = F.col("event_id").cast("long"), F.concat
    web = cat("src_ip", F.lit(" - "), F.when(F.col("user_name") == "", "-").otherwise(F.col("user_name")), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p/'), k,
              F.lit(' HTTP/1.1" '), F.when(F.col("action") == "error", "404").otherwise("200"), F.lit(" "), F.when(k == "7", "-").otherwise(k), F.lit(' "-" "agent (x) '), k, F.lit('"'))
    epoch = F.unix_micros(F.col("ts").cast("timestamp"))
    pairs = cat(F.lit('devname="fw 1" srcip='), "src_ip", F.lit(" eventtime="), F.when(number % 20 == 1, "never").otherwise(epoch.cast("string")), F.lit(" dstport="), F.col("dst_port").cast("string"),
                F.lit(' msg="a=1 b" action=old action="'), "action", F.lit('"'))
    asa = cat(F.lit("%ASA-4-106023: Deny "), "proto", F.lit(" src outside:"), "src_ip", F.lit("/"), F.col("src_port").cast("string"), F.lit(" dst inside:192.0.2.3/"), F.col("dst_port").cast("string"), F.lit(" by group"))
    body = F.when(number % 20 == 0, cat(F.lit("noise "), k)).when(F.col("vendor") == "NGINX", web).when(F.col("vendor") == "Fortinet", pairs).otherwise(asa)
    return e.select("event_id", "ts", "ingested_at", "source_id", web.alias("web"), pairs.alias("pairs"), k.alias("k"), "action", "dst_port", body.alias("body"))


def _found(state, *names):
    return [F.try_element_at(state["fields"], F.lit(n)).alias(n.replace(".", "_")) for n in names]


@_query("grok_extract", _ev("""SELECT event_id, src_ip AS clientip, nullif(user_name, '') AS who, '/p/' || k AS path, CASE action WHEN 'error' THEN '404' ELSE '200' END AS response,
CASE WHEN k <> 7 THEN k::VARCHAR END AS bytes, 'agent (x) ' || k AS agent FROM ev"""))
def _grok(spark, folder):
    got = _lines(spark, folder).select("event_id", S.parse_state(F.col("web"), (WEB,)).alias("s"))
    auth = F.try_element_at(F.col("s.fields"), F.lit("auth"))
    return got.select("event_id", auth.alias("auth"), *_found(F.col("s"), "clientip", "path", "response", "bytes", "agent")).withColumn("who", F.nullif("auth", F.lit("-"))).drop("auth")


@_query("kv_extract", _ev("""SELECT event_id, src_ip AS srcip, CASE WHEN event_id::BIGINT % 20 = 1 THEN 'never' ELSE epoch_us(ts)::VARCHAR END AS eventtime, dst_port::VARCHAR AS dstport, 'a=1 b' AS msg, action, 6 AS n_fields FROM ev"""))
def _kv(spark, folder):
    got = _lines(spark, folder).select("event_id", S.parse_state(F.col("pairs"), (PAIRS,)).alias("s"))
    return got.select("event_id", *_found(F.col("s"), "srcip", "eventtime", "dstport", "msg", "action"), F.size("s.fields").alias("n_fields"))


@_query("csv_step", _ev("""SELECT event_id, k::VARCHAR AS k, 'say "' || action || '", ok' AS quoted, CASE WHEN k % 2 = 0 THEN 'last' END AS tail, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM ev WHERE k % 3 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, 'failed' FROM ev WHERE k % 3 = 0"""))
def _csv(spark, folder):
    k = F.col("k").cast("int")
    line = F.concat("k", F.lit(',"say ""'), "action", F.lit('"", ok",skip'), F.when(k % 3 == 0, "").when(k % 2 == 0, ",last").otherwise(","))
    got = _lines(spark, folder).select("event_id", S.parse_state(line, (S.Csv(columns=("k", "quoted", "_", "tail")),)).alias("s"))
    return got.select("event_id", *_found(F.col("s"), "k", "quoted", "tail"), F.col("s.status").alias("status"))


@_query("json_flatten", _ev("""SELECT event_id, k::VARCHAR AS a_b, '[1,2]' AS a_c, action AS d_e_f, NULL::VARCHAR AS none, 4 AS n_fields FROM ev"""))
def _json(spark, folder):
    text = F.concat(F.lit('{"a":{"b":'), "k", F.lit(',"c":[1,2]},"none":null,"d":{"e":{"f":"'), "action", F.lit('"}}}'))
    got = _lines(spark, folder).select("event_id", S.parse_state(text, (S.Json(),)).alias("s"))
    return got.select("event_id", *_found(F.col("s"), "a.b", "a.c", "d.e.f", "none"), F.size("s.fields").alias("n_fields"))


_FORMATS = ("UNIX_AUTO", "ISO8601", "SYSLOG", "dd.MM.yyyy HH:mm:ss")


@_query("date_formats", _ev("""SELECT event_id, CASE event_id::BIGINT % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN ts WHEN 3 THEN ts WHEN 4 THEN date_trunc('second', ts)
WHEN 5 THEN date_trunc('second', ts) - INTERVAL 3 HOUR END AS at, CASE WHEN event_id::BIGINT % 7 = 5 THEN '' WHEN k % 2 = 0 THEN '_tz_unresolved' ELSE '_tz_missing' END AS tags FROM ev WHERE event_id::BIGINT % 7 <> 6
UNION ALL SELECT event_id, NULL, '_failed' FROM ev WHERE event_id::BIGINT % 7 = 6"""))
def _dates(spark, folder):
    kind, at = F.col("event_id").cast("long") % 7, F.col("ts").cast("timestamp")
    micros = F.unix_micros(at)
    text = (
        F.when(kind == 0, F.unix_seconds(at).cast("string")).when(kind == 1, F.unix_millis(at).cast("string")).when(kind == 2, F.concat(micros.cast("string"), F.lit("321")))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(kind == 4, F.date_format("ts", "MMM d HH:mm:ss"))
        .when(kind == 5, F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).otherwise(F.lit("tomorrow"))
    )
    zone = F.when(kind == 5, F.when(F.col("k").cast("int") % 2 == 0, "+0300").otherwise("Europe/Istanbul")).when(F.col("k").cast("int") % 2 == 0, "+19")
    message = F.concat(F.lit('t="'), text, F.lit('"'), F.coalesce(F.concat(F.lit(" zone="), zone), F.lit("")))
    date = S.Date(field="t", formats=_FORMATS, zone_field="zone", now="2024-02-05 00:00:00", on_failure="tag")
    got = _lines(spark, folder).select("event_id", S.parse_state(message, (S.KeyValue(), date)).alias("s"))
    return got.select("event_id", F.try_element_at(F.col("s.fields"), F.lit(S.AT)).try_cast("timestamp_ntz").alias("at"), F.array_join("s.tags", ",").alias("tags"))


_PARSED = """pa AS (SELECT event_id, ts, ingested_at, source_id, CASE WHEN event_id::BIGINT % 20 = 0 THEN '' WHEN vendor = 'NGINX' THEN 'web' WHEN vendor = 'Fortinet' THEN 'traffic' ELSE 'firewall' END AS parser_id,
  event_id::BIGINT % 20 = 1 AND vendor = 'Fortinet' AS undated, src_ip AS ip, dst_port AS port, ev.action AS act, ev.proto AS pr FROM ev),
pb AS (SELECT event_id, ts, ingested_at, source_id, parser_id, CASE WHEN parser_id = '' THEN 'failed' WHEN undated THEN 'partial' ELSE 'ok' END AS parse_status, CASE WHEN undated THEN '_date_failure' ELSE '' END AS tags,
  CASE WHEN parser_id = 'web' THEN date_trunc('second', ts) WHEN parser_id = 'traffic' AND NOT undated THEN ts END AS parsed_at, CASE WHEN parser_id <> '' THEN ip END AS src_ip,
  CASE parser_id WHEN 'web' THEN '443' WHEN '' THEN NULL ELSE port::VARCHAR END AS dst_port, CASE parser_id WHEN 'web' THEN 'GET' WHEN 'traffic' THEN act WHEN 'firewall' THEN 'deny ' || pr END AS action,
  CASE WHEN parser_id = 'web' THEN CASE act WHEN 'error' THEN 'failure' ELSE 'success' END END AS outcome FROM pa)"""


@_query("parse_events", _ev(f", {_PARSED} SELECT event_id, parser_id, parse_status, tags, parsed_at, src_ip, dst_port, action, outcome FROM pb"))
def _parse(spark, folder):
    got = parse.parse_events(_lines(spark, folder).select("event_id", "body"), PARSERS)
    core = [F.try_element_at("core", F.lit(c)).alias(c) for c in ("src_ip", "dst_port", "action", "outcome")]
    return got.select("event_id", "parser_id", "parse_status", F.array_join("tags", ",").alias("tags"), "parsed_at", *core)


@_query("normalize_events", _ev(f""", {_PARSED} SELECT event_id, coalesce(parsed_at, CASE WHEN event_id::BIGINT % 3 > 0 THEN ts END, ingested_at) AS event_ts,
CASE WHEN parsed_at IS NOT NULL THEN 'parsed' WHEN event_id::BIGINT % 3 > 0 THEN 'observed' ELSE 'received' END AS time_source, CASE parser_id WHEN 'firewall' THEN 'fw' ELSE source_id END AS event_host,
'::ffff:' || src_ip AS src_address, coalesce(dst_port, '0')::BIGINT AS dst_port_number FROM pb"""))
def _normalize(spark, folder):
    lines = _lines(spark, folder).select("event_id", "body", "source_id", "ingested_at", F.when(F.col("event_id").cast("long") % 3 > 0, F.col("ts")).alias("observed"))
    out = parse.normalize(parse.parse_events(lines, PARSERS), "observed", "ingested_at", "source_id")
    return out.select("event_id", "event_ts", "time_source", "event_host", "src_address", "dst_port_number")


@_query("source_resolution", """WITH ks AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'SRC_' || user_id WHEN 1 THEN 'dev-' || user_id || '.EXAMPLE.net' WHEN 2 THEN '10.1.' || (user_id // 256 % 256) || '.' || (user_id % 256) || ':514' WHEN 3 THEN 'nowhere:1' ELSE ' ' END AS k FROM events),
known AS (SELECT event_id, k, event_id % 5 < 3 AND user_id IN (SELECT c_custkey FROM customer) AS is_known, user_id FROM ks)
SELECT event_id, CASE WHEN is_known THEN 'src_' || user_id WHEN trim(k) = '' THEN '_unknown' ELSE k END AS resolved_source, CASE WHEN is_known THEN 'grp_' || (user_id % 4) ELSE '_unassigned' END AS resolved_group, is_known FROM known""")
def _sources(spark, folder):
    e, user = adapt.table(spark, folder, "events"), F.col("user_id")
    kind = F.col("event_id") % 5
    key = (
        F.when(kind == 0, F.concat(F.lit("SRC_"), user)).when(kind == 1, F.concat(F.lit("dev-"), user, F.lit(".EXAMPLE.net")))
        .when(kind == 2, F.concat(F.lit("10.1."), F.floor(user / 256) % 256, F.lit("."), user % 256, F.lit(":514"))).when(kind == 3, "nowhere:1").otherwise(" ")
    )
    return parse.resolve_sources(e.select("event_id", key.alias("source_key")), adapt.inventory(spark, folder)).drop("source_key")


@_query("snapshot_dedupe", """WITH s AS (SELECT o_custkey AS connector, o_orderdate AS taken_at, o_orderkey AS id, sha256(o_orderpriority) AS sha FROM orders), p AS (SELECT *, lag(sha) OVER (PARTITION BY connector ORDER BY taken_at, id) AS b FROM s)
SELECT connector, id, CASE WHEN b IS NULL THEN 'baseline' WHEN b = sha THEN 'unchanged' ELSE 'changed' END AS state FROM p""")
def _snapshots(spark, folder):
    o = adapt.table(spark, folder, "orders").select(F.col("o_custkey").alias("connector"), F.col("o_orderdate").alias("taken_at"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return config.snapshot_states(o).select("connector", "id", "state")


@_query("config_diff", """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT id, CASE WHEN length(line) % 5 = 0 THEN line || '!' ELSE line END AS line FROM l WHERE length(line) % 7 <> 0)
SELECT id, sha256(line) AS line_sha, sum(b)::BIGINT AS before_more, sum(c)::BIGINT AS after_more FROM (
  SELECT id, line, greatest(sum(x) - sum(y), 0) AS b, greatest(sum(y) - sum(x), 0) AS c FROM (SELECT id, line, 1 AS x, 0 AS y FROM l UNION ALL SELECT id, line, 0, 1 FROM a) GROUP BY id, line HAVING sum(x) <> sum(y)) GROUP BY ALL""")
def _config(spark, folder):
    lines = adapt.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line")
    after = lines.where(n % 7 != 0).select("id", F.when(n % 5 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line"))
    return config.config_diff(lines, after).select("id", F.sha2("line", 256).alias("line_sha"), F.col("removed").alias("before_more"), F.col("added").alias("after_more"))
