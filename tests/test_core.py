"""Hand-computed values of the correlation, search, alert and replay operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logmeridian.functions import scores
from logmeridian.functions.exprs import decimal_text
from logmeridian.functions.signature import masked, with_signature
from logmeridian.operators import alerts, correlate, detect, replay, search
from logmeridian.scope import AccessScope, in_scope
from logmeridian.windows import CorrelationWindow, EventQuery

ALL = AccessScope.system()
T0 = datetime(2026, 8, 20, 14)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def events(spark, rows):
    schema = (
        "event_id string, ts timestamp_ntz, owner_group string, source_id string, signature_hash long, body string, "
        "parse_status string, severity_num int, time_source string"
    )
    full = [(str(i), ts, group, source, sig, f"body {sig}", "ok", 1, "parsed") for i, (ts, group, source, sig) in enumerate(rows)]
    return spark.createDataFrame(full, schema).withColumn("ingested_at", F.col("ts"))


def window():
    return CorrelationWindow(T0 - timedelta(minutes=45), T0, T0 - timedelta(days=7), T0 - timedelta(minutes=45))


@pytest.mark.parametrize("number, text", [(0.0, "0"), (100.0, "100"), (120.0, "120")])
def test_decimal_text_keeps_integer_zeros(spark, number, text):
    assert value(spark, decimal_text(F.lit(number), 0)) == text


def test_decimal_text_strips_fraction_zeros(spark):
    assert value(spark, decimal_text(F.lit(1.5), 3)) == "1.5"
    assert value(spark, decimal_text(F.lit(20.0), 3)) == "20"


def test_expected_z_and_lift(spark):
    week = 7 * 86400.0
    assert value(spark, scores.expected_in_window(F.lit(700), week, 2700.0)) == 3.125
    assert value(spark, scores.expected_in_window(F.lit(700), 0.0, 2700.0)) == 0
    assert [value(spark, scores.poisson_z(F.lit(o), F.lit(4.0))) for o in (12, 4, 2)] == [4.0, 0.0, -1.0]
    assert value(spark, scores.poisson_z(F.lit(5), F.lit(0.0))) == 0
    cases = [(50, 100, 100, 1000, 5.0), (200, 1000, 100, 500, 1.0), (50, 100, 0, 1000, 0.0)]
    for a, b, c, d, expected in cases:
        assert value(spark, scores.lift(F.lit(a), F.lit(b), F.lit(c), F.lit(d))) == pytest.approx(expected)


MASKED = [
    ("user 42 from 10.0.0.1 port 22", "user <NUMBER> from <IPV4> port <NUMBER>"),
    ("mail to a.b@example.com sent", "mail to <EMAILADDRESS> sent"),
    ("at 2024-01-02T03:04:05Z done", "at <TIMESTAMP_ISO8601> done"),
    ("kullanıcı1 girdi", "kullanıcı1 girdi"),
]


@pytest.mark.parametrize("body, expected", MASKED)
def test_masks(spark, body, expected):
    assert value(spark, masked(F.lit(body))) == expected


def test_long_bodies_get_a_signature_unless_limited(spark):
    body = "word " * 5000
    assert value(spark, F.length(masked(F.lit(body)))) == len(body)
    assert value(spark, masked(F.lit(body), max_chars=1000)) == ""


def test_signature_plan_grows_with_the_masks_and_not_with_their_power(spark):
    df = with_signature(spark.createDataFrame([("a 1",)], "body string")).where("signature_hash <> 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 40
    assert df.count() == 1


def test_first_seen_counts_sources_and_ignores_hash_zero(spark):
    rows = [
        (T0 - timedelta(days=3), "g", "a", 1), (T0 - timedelta(minutes=40), "g", "a", 1), (T0 - timedelta(minutes=35), "g", "a", 2),
        (T0 - timedelta(minutes=34), "g", "b", 2), (T0 - timedelta(minutes=30), "g", "a", 0), (T0 - timedelta(minutes=30), "h", "a", 3),
    ]
    found = correlate.first_seen(events(spark, rows), window(), AccessScope.groups("g")).collect()
    assert [(r["signature_hash"], r["event_count"], r["source_count"]) for r in found] == [(2, 2, 2)]


def test_overlapping_baseline_is_refused():
    with pytest.raises(ValueError):
        CorrelationWindow(T0, T0 + timedelta(hours=1), T0 - timedelta(days=1), T0 + timedelta(minutes=1))


def test_scope_never_widens(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "owner_group string")
    assert rows.filter(in_scope(AccessScope.groups("a"), ["b"])).count() == 0
    assert rows.filter(in_scope(AccessScope.nothing())).count() == 0
    assert rows.filter(in_scope(ALL, ["b"])).count() == 1


def test_pages_have_no_gap_and_no_duplicate(spark):
    data = events(spark, [(T0 + timedelta(seconds=i // 3), "g", "s", i) for i in range(53)])
    cursor, seen = None, []
    while True:
        page = search.page(data, EventQuery(T0, T0 + timedelta(hours=1), limit=10, ascending=True, cursor=cursor), ALL)
        seen += [r["event_id"] for r in page.rows]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert len(seen) == 53 and len(set(seen)) == 53


def test_buckets_of_an_unaligned_range_stay_within_the_limit():
    width = search.bucket_seconds("2024-01-01 00:30:00", "2024-02-01 00:30:00", 60, 720)
    first, last = (datetime(2024, m, 1, 0, 30).timestamp() for m in (1, 2))
    assert -(-last // width) - first // width <= 720
    assert search.bucket_seconds("2024-01-01", "2024-02-01", 60) == 60


def test_source_gaps_hold_the_ends(spark):
    data = events(spark, [(T0 + timedelta(seconds=150), "g", "s", 1), (T0 + timedelta(seconds=350), "g", "s", 1)])
    gaps = search.source_gaps(data, EventQuery(T0, T0 + timedelta(seconds=600)), ALL, 100).collect()
    assert sorted(r["gap_seconds"] for r in gaps) == [100, 100, 200]


def test_rules_in_one_pass(spark):
    data = events(spark, [(T0 - timedelta(minutes=m), "g", "s", 1) for m in (1, 2, 3, 61, 62)])
    rules = [alerts.Rule("t", "threshold", 3600, 3, ">="), alerts.Rule("r", "ratio", 3600, 1.5, ">="), alerts.Rule("q", "threshold", 3600, 3, ">")]
    assert {r["rule_id"]: (r["value"], r["fired"]) for r in alerts.evaluate(data, rules, T0).collect()} == {"t": (3.0, True), "r": (1.5, True), "q": (3.0, False)}


def test_maintenance_comes_before_repeat(spark):
    triggers = spark.createDataFrame([("1", "r", "g", T0), ("2", "r", "g", T0 + timedelta(seconds=30)), ("3", "x", "h", T0)], "id string, rule_id string, owner_group string, fired_at timestamp_ntz")
    windows = spark.createDataFrame([(None, "h", T0, T0 + timedelta(hours=1))], "rule_id string, owner_group string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    assert {r["id"]: r["reason"] for r in alerts.suppression(triggers, windows, 60).collect()} == {"1": "", "2": "repeat", "3": "maintenance"}


def test_detection_counts_a_missing_key_as_empty(spark):
    data = spark.createDataFrame([("a", {"k": "1"}), ("b", {})], "id string, attrs map<string,string>")
    rule = detect.DetectionRule("not-one", F.coalesce(F.element_at("attrs", F.lit("k")), F.lit("")) != "1")
    assert [r["id"] for r in detect.detections(data, [rule]).collect()] == ["b"]


def test_replay_diff_and_merge(spark):
    schema = "event_id string, parse_status string, action string"
    old = spark.createDataFrame([("1", "failed", "a"), ("2", "ok", "b")], schema)
    new = spark.createDataFrame([("1", "ok", "a"), ("3", "ok", "c")], schema)
    changed = replay.diff(old, new, ["parse_status", "action"])
    assert {r["event_id"]: r["state"] for r in changed.collect()} == {"1": "changed", "3": "new"}
    assert replay.report(changed).first().asDict() == {"replayed": 2, "added": 1, "changed": 1, "unchanged": 0, "failed_to_ok": 1, "ok_to_failed": 0}
    assert [r["n"] for r in replay.changes_per_field(changed).collect()] == [1]
    assert {r["event_id"]: r["parse_status"] for r in replay.merge(old, new).collect()} == {"1": "ok", "2": "ok", "3": "ok"}
