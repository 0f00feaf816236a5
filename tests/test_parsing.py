"""Parser steps, dispatch, normalising and configuration on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from logmeridian.functions import steps as S
from logmeridian.operators import config, parse


def run(spark, message, *steps):
    row = spark.createDataFrame([(message,)], "m string").select(S.parse_state(F.col("m"), steps).alias("s")).first()["s"]
    return {k: v for k, v in row["fields"].items() if k != "message"}, row["status"], row["tags"]


def test_grok_first_pattern_wins_and_types(spark):
    grok = S.Grok(patterns=(r"^a=%{INT:n:int} (b-)?%{WORD:w}$", r"%{WORD:w}"))
    assert run(spark, "a=007 b-xy", grok) == ({"n": "7", "w": "xy"}, "ok", [])
    assert run(spark, "-- zz", grok) == ({"w": "zz"}, "ok", [])
    assert run(spark, "--", grok)[1] == "failed"
    assert run(spark, None, grok)[1] == "failed"
    assert run(spark, "\u0001 zz \u0002", grok) == ({"w": "zz"}, "ok", [])
    with pytest.raises(ValueError):
        S.expand("%{A}", {"A": "%{A}"})


def test_key_value_quotes_repeats_and_prefix(spark):
    step = S.KeyValue(prefix="p.", exclude=("x",))
    assert run(spark, 'k=1 m="a b=c" x=9 k=2 =bad bare e=', step)[0] == {"p.k": "2", "p.m": "a b=c", "p.e": ""}
    assert run(spark, "none here", step)[1] == "failed"


def test_csv_and_json(spark):
    assert run(spark, ',"a ""b"",c",x', S.Csv(columns=("e", "q", "_"))) == ({"q": 'a "b",c'}, "ok", [])
    assert run(spark, "a", S.Csv(columns=("a", "b")))[1] == "failed"
    assert run(spark, '{"a":{"b":{"c":1}},"l":[{"x":1}],"n":null,"t":true}', S.Json())[0] == {"a.b.c": "1", "l": '[{"x":1}]', "t": "true"}
    assert run(spark, "[1]", S.Json())[1] == "failed"


@pytest.mark.parametrize(
    "text, zone, at",
    [
        ("1700000000", None, "2023-11-14 22:13:20.000000"),
        ("1700000000123", None, "2023-11-14 22:13:20.123000"),
        ("1700000000123456789", None, "2023-11-14 22:13:20.123456"),
        ("2024-05-01T12:00:00+0200", None, "2024-05-01 10:00:00.000000"),
        ("2024-05-01T12:00:00", "+0330", "2024-05-01 08:30:00.000000"),
        ("Dec 31 23:59:59", None, "2023-12-31 23:59:59.000000"),
        ("Jan  1 00:00:01", None, "2024-01-01 00:00:01.000000"),
    ],
)
def test_dates(spark, text, zone, at):
    date = S.Date(field="t", zone_field="z", formats=("UNIX_AUTO", "ISO8601", "SYSLOG"), now="2024-01-02")
    fields, status, tags = run(spark, f't="{text}"' + (f" z={zone}" if zone else ""), S.KeyValue(), date)
    assert (fields[S.AT], status, tags) == (at, "ok", [] if zone else ["_tz_missing"])


def test_failure_policies(spark):
    date = lambda how: S.Date(formats=("ISO8601",), on_failure=how, tag="_d")
    assert [run(spark, "x", date(h))[1:] for h in ("fail", "continue", "tag")] == [("failed", []), ("partial", []), ("partial", ["_d"])]


def test_dispatch_prefers_bound_then_ok_then_partial(spark):
    word = S.Grok(patterns=("%{WORD:w}",))
    late = S.Date(field="w", formats=("ISO8601",), on_failure="tag")
    parsers = [parse.Parser("b", (word,), ("yes",), 1, {"host": "{{ w }}"}), parse.Parser("a", (word, late), (), 9), parse.Parser("c", (word,), ("yes",), 5, {"host": "{{ none }}"})]
    rows = spark.createDataFrame([("yes", None), ("yes", "b"), ("no", None), ("!", None), (None, None)], "body string, bound string")
    got = [(r["parser_id"], r["parse_status"], r["core"]) for r in parse.parse_events(rows, parsers, bound="bound").collect()]
    assert got == [("c", "ok", {}), ("b", "ok", {"host": "yes"}), ("a", "partial", {}), ("", "failed", {}), ("", "failed", {})]
    assert parse.parse_events(rows.limit(0), parsers).count() == 0


def test_plan_grows_with_the_number_of_steps_only(spark):
    sizes = []
    for n in (4, 8):
        steps = [S.Grok(patterns=(rf"%{{WORD:w{i}}}",)) for i in range(n)]
        df = spark.range(1).select(S.parse_state(F.lit("a b").cast("string"), steps).alias("s")).where("s.status = 'ok'")
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 3 * sizes[0]


def test_sources_and_config(spark):
    inventory = spark.createDataFrame([("s1", "g", "10.0.0.1", "Host.A"), ("s0", "h", "10.0.0.1", "")], "source_id string, owner_group string, peer_address string, hostname string")
    keys = spark.createDataFrame([("10.0.0.1:99",), ("HOST.a",), ("?:1",), (" ",), (None,)], "source_key string")
    got = [tuple(r)[1:] for r in sorted(parse.resolve_sources(keys, inventory).collect(), key=str)]
    assert sorted(got, key=str) == sorted([("s0", "h", True), ("s1", "g", True), ("?:1", "_unassigned", False), ("_unknown", "_unassigned", False), ("_unknown", "_unassigned", False)], key=str)
    lines = lambda *xs: spark.createDataFrame([("i", x) for x in xs], "id string, line string")
    assert {tuple(r)[1:] for r in config.config_diff(lines("a", "a", "b"), lines("a", "c", "b")).collect()} == {("a", 1, 0), ("c", 0, 1)}
    assert parse.mapped_address(F.lit("1.2.3.256")) is not None
    assert spark.range(1).select(parse.mapped_address(F.lit("1.2.3.256")), parse.clamped(F.lit("70000"), 65535), parse.clamped(F.lit("x"), 9)).first() == (None, 65535, 0)
