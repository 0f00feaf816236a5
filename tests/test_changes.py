"""Changes, configuration texts, decoding, batches, health figures and streams on small hand-made rows."""

import datetime as dt
import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from logmeridian.operators import changes, health
from logmeridian.session import configure
from logmeridian.sources import decode, otlp
from logmeridian.streaming import live

AT = dt.datetime(2024, 2, 1)
PAYLOAD = "provider string, event string, delivery string, body string, default_kind string, received_at timestamp_ntz, outcome_of string"


def mapped(spark, provider, event, delivery, body):
    rows = [(provider, event, delivery, body if isinstance(body, str | None) else json.dumps(body), "deploy", AT, "x")]
    return changes.map_changes(spark.createDataFrame(rows, PAYLOAD)).first()


def test_payloads_that_do_not_map(spark):
    assert mapped(spark, "github", "push", "d", None).outcome == "invalid"
    assert mapped(spark, "github", "push", "d", '{"a":').outcome == "invalid"
    assert mapped(spark, "github", None, None, {}).outcome == "ignored"
    assert mapped(spark, "elsewhere", "push", "d", {}).outcome == "ignored"
    row = mapped(spark, "jenkins", "", "d", {"build": {"phase": "FINALIZED", "number": 3}})
    assert (row.outcome, row.reason, row.delivery_id, row.ts, row.outcome_of) == ("invalid", "no target", "", None, "x")


def test_payload_maps_with_first_target_and_fallback_time(spark):
    body = {"name": "j", "build": {"phase": "COMPLETED", "number": 3, "status": "OK", "timestamp": 5, "parameters": {"TARGET": "t"}, "scm": {"branch": ""}}}
    row = mapped(spark, "jenkins", None, "other", body)
    assert (row.target_id, row.delivery_id, row.ts, row.summary, row.change_kind) == ("t", "j#3:OK", AT, "j #3 → OK", "deploy")
    assert row.details == {"status": "OK", "phase": "COMPLETED", "job": "j", "build": "3"}


@pytest.mark.parametrize(
    "text, at",
    [("1704448800000", dt.datetime(2024, 1, 5, 10)), ("946684800000", None), ("1704448800", None), (" 2024-01-05 10:00:00 UTC ", dt.datetime(2024, 1, 5, 10)),
     ("2024-01-05T12:00:00+02:00", dt.datetime(2024, 1, 5, 10)), ("soon", None), ("", None), (None, None), ("9" * 30, None)],
)
def test_payload_time(spark, text, at):
    assert spark.createDataFrame([(text,)], "t string").select(changes.payload_time(F.col("t"))).first()[0] == at


def test_first_deliveries_keeps_rows_without_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4), ("", 5)], "k string, n int")
    assert sorted(r.n for r in changes.first_deliveries(df, ("k",), ("n",)).collect()) == [1, 3, 4, 5]


def test_secrets_keep_prefix_and_show_rotation(spark):
    lines = ['set password ENC "ab c"', "password=ab c", "set hostname x", "PassWord ab c", "password", ""]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(changes.masked_secret(F.col("l"))).collect()]
    mark = f"<gizli:{hashlib.sha256(b'ab c').hexdigest()[:8]}>"
    assert out == [f"set password ENC {mark}", f"password={mark}", "set hostname x", f"PassWord {mark}", "password", ""]


def test_sections_nest_and_close(spark):
    text = 'edit "early"\nconfig a\nconfig b\nedit "x y"\nend\nset z\nend\nend\n \nlast'
    rows = [(1, "fortinet.fortigate", text), (2, "fortinet.fortigate", None), (3, "other", "#\n ! \nplain\r"), (4, "fortinet.fortigate", "")]
    got = {(r.id, r.line_no): r.section for r in changes.config_lines(spark.createDataFrame(rows, "id int, vendor string, text string")).collect()}
    root = changes.ROOT_SECTION
    assert [got[1, i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == [root, "a", "a / b", "a / b / x y", "a", "a", root, root, root]
    assert {k: v for k, v in got.items() if k[0] > 1} == {(3, 2): root}


@pytest.mark.parametrize(
    "raw, said, expected",
    [(b"plain", None, ("utf-8", "plain", True)), (b"\xef\xbb\xbfx", "latin-1", ("utf-8", "x", True)), (b"\xfe\xff\x00x", None, ("utf-16BE", "x", True)),
     ("é".encode(), None, ("utf-8", "é", True)), (b"\xfd", None, ("windows-1254", "ı", True)), (b"\xfd", "utf-8", ("windows-1254", "ı", False)),
     (b"\x81\xfd", None, ("iso-8859-1", "\x81ý", True)), (b"\xe9", " ISO-8859-1 ", ("iso-8859-1", "é", True)), (b"", None, ("utf-8", "", True)), (None, "utf-8", (None, None, None))],
)
def test_decoding(spark, raw, said, expected):
    df = spark.createDataFrame([(raw, said, "old")], "raw binary, said string, text string")
    row = decode.decode_text(df, "raw", F.col("said")).first()
    assert (row.encoding, row.text, row.declared_honored) == expected
    assert row.text is None or unicodedata.is_normalized("NFC", row.text)


def test_batches_flatten_and_damaged_ones_give_nothing(spark):
    record = {"attributes": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {"key": "b"}], "severityNumber": -4}
    batch = {"resourceLogs": [{"resource": {"attributes": [{"key": "a", "value": {"boolValue": True}}]}, "scopeLogs": [{"logRecords": [record]}, {}]}, {}]}
    df = spark.createDataFrame([(1, json.dumps(batch)), (2, "{"), (3, None), (4, "{}")], "n int, payload string")
    configure(spark)
    [row] = otlp.log_records(df, source_keys=("resource.a",)).collect()
    assert (row.n, row.observed_at, row.severity_number, row.body, row.source_key) == (1, None, 0, "", "true")
    assert row.attributes == {"resource.a": "true", "a": '{"values":[{"intValue":"1"}]}', "b": ""}


def test_health_of_nothing(spark):
    parsed = spark.createDataFrame([], "parser_id string, bound string, parse_status string")
    row = health.dispatch_health(parsed, "bound").first()
    assert (row.total, row.bound_ratio, row.unmatched_ratio) == (0, 1.0, 0.0)
    reviews = health.review_quality(spark.createDataFrame([("unknown",)], "verdict string")).first()
    assert (reviews.total, reviews.decided, reviews.accuracy, reviews.unknown_ratio) == (1, 0, None, 1.0)


def test_stream_counts_final_buckets_once(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m),) for h, m in ((0, 5), (0, 6), (1, 0), (5, 30))]
    spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz").parquet(f"{tmp_path}/in")
    got = {r.bucket_start.hour: r.event_count for r in live.drain(live.histogram(stream, 3600), "t").collect()}
    assert got == {0: 2, 1: 1}
