"""Templates, suppression, silence, archives, replay, imports, addresses, fragments and numbering against brute force."""

import ipaddress
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logmeridian.functions import addresses, grok_library, steps
from logmeridian.operators import alerts, fragments, ordering, ranges, replay, templates
from logmeridian.plans import bundles, triggers
from logmeridian.scope import AccessScope
from logmeridian.session import configure
from logmeridian.sources import archive, inventory, store
from logmeridian.streaming import live
from logmeridian.windows import CorrelationWindow

T0 = datetime(2024, 1, 1)
ALL = AccessScope.system()


def minutes(*values):
    return [T0 + timedelta(minutes=v) for v in values]


def chain(times, gap):
    last, out = None, set()
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            out.add(t)
            last = t
    return out


NO_WINDOWS = "rule_id string, owner_group string, starts_at timestamp_ntz, ends_at timestamp_ntz"


@pytest.mark.parametrize("firings", [4, 4096])
def test_suppression_counts_from_what_went_out(spark, monkeypatch, firings):
    monkeypatch.setattr(alerts, "SPAN_FIRINGS", firings)
    rng = random.Random(5)
    rows = [("a", t) for t in minutes(0, 8, 16)] + [("hot", T0 + timedelta(seconds=rng.randrange(200_000))) for _ in range(600)] + [("rare", T0 + timedelta(days=rng.randrange(300))) for _ in range(30)]
    rows += [(None, T0), (None, T0 + timedelta(minutes=1)), ("tie", T0), ("tie", T0)]
    data = spark.createDataFrame([(str(i), r, "g", t) for i, (r, t) in enumerate(rows)] + [("x", "a", "g", None)], "id string, rule_id string, owner_group string, fired_at timestamp_ntz")
    got = {r["id"]: r["reason"] for r in alerts.suppression(data, spark.createDataFrame([], NO_WINDOWS), 600).collect()}
    kept = {rule: chain([t for r, t in rows if r == rule], timedelta(minutes=10)) for rule in {r for r, _ in rows}}
    assert got == {"x": ""} | {str(i): "" if t in kept[r] else "repeat" for i, (r, t) in enumerate(rows)}
    assert [got[str(i)] for i in range(3)] == ["", "repeat", ""]


def test_maintenance_holds_rules_with_several_groups_and_does_not_count(spark):
    rows = [("1", "r", "a, g ,b", minutes(0)[0]), ("2", "r", "a, g ,b", minutes(5)[0]), ("3", "r", "a, g ,b", minutes(11)[0]), ("4", "s", "gg", minutes(5)[0]), ("5", "r", "a", minutes(12)[0])]
    data = spark.createDataFrame(rows, "id string, rule_id string, owner_group string, fired_at timestamp_ntz")
    windows = spark.createDataFrame([(None, "g", *minutes(0, 3)), (None, "g", *minutes(3, 6)), (None, "g", *minutes(1, 2)), ("s", None, *minutes(0, 5))], NO_WINDOWS)
    got = {r["id"]: r["reason"] for r in alerts.suppression(data, windows, F.when(F.col("rule_id") == "r", 600).otherwise(0)).collect()}
    assert got == {"1": "maintenance", "2": "maintenance", "3": "", "4": "", "5": "repeat"}


def greedy(signatures, similarity=0.4):
    """Templates of one leaf, one signature after another."""
    found = []
    for tokens, size in sorted(signatures, key=lambda s: (-s[1], s[0])):
        best = max(found, key=lambda t: (sum(a == b != "<*>" for a, b in zip(t[0], tokens, strict=True)), t[0].count("<*>"), -found.index(t)), default=None)
        if best is not None and sum(a == b != "<*>" for a, b in zip(best[0], tokens, strict=True)) >= similarity * len(tokens):
            best[0][:] = [a if a == b else "<*>" for a, b in zip(best[0], tokens, strict=True)]
            best[1] += size
        else:
            found.append([list(tokens), size])
    return sorted((" ".join(t), n) for t, n in found)


def signatures(seed=2, n=250):
    rng = random.Random(seed)
    shapes = [["open", "<NUMBER>", "by", "u", "x"], ["open", "file", "f", "of", "u"], ["close", "<IP>", "port", "p", "q"]]
    out = {}
    for _ in range(n):
        shape = [f"{t}{rng.randrange(12)}" if len(t) == 1 else t for t in rng.choice(shapes)]
        out[tuple(shape)] = rng.randrange(1, 9)
    return out


def mined(spark, found, known=None, **options):
    rows = [("c", " ".join(t), n) for t, n in found.items()] + [("c", "  ", 3), (None, "a b", 1), ("c", None, 1)]
    return templates.mine_templates(spark.createDataFrame(rows, "source_class string, signature string, n long"), known, **options)


def test_templates_equal_one_by_one_grouping(spark):
    found = signatures()
    got = mined(spark, found).collect()
    expected = sorted(sum((greedy([(t, n) for t, n in found.items() if t[0] == first]) for first in ("open", "close")), []))
    assert sorted((r["template"], r["size"]) for r in got) == expected
    assert {r["template_id"] for r in got} == {f"c:{i}" for i in range(1, len(got) + 1)}
    assert {tuple(r["mask_names"]) for r in got if "<NUMBER>" in r["template"]} == {("NUMBER",)}


def test_parts_are_merged_and_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(templates, "PART", 10)
    monkeypatch.setattr(templates, "FAN_IN", 3)
    found = signatures(n=400)
    once = {(r["template_id"], r["template"], r["size"]) for r in mined(spark, found).collect()}
    rows = [("c", " ".join(t), n) for t, n in reversed(found.items())]
    again = templates.mine_templates(spark.createDataFrame(rows, "source_class string, signature string, n long").repartition(7))
    assert {(r["template_id"], r["template"], r["size"]) for r in again.collect()} == once
    assert sum(n for *_, n in once) == sum(found.values())
    assert len(once) < 12


def test_ids_stay_over_runs_and_sizes_add_up(spark):
    first = mined(spark, signatures(seed=2))
    second = mined(spark, signatures(seed=3) | {("new", "line"): 5}, first)
    before, after = ({r["template_id"]: r for r in df.collect()} for df in (first, second))
    assert set(before) < set(after)
    assert not any(after[i]["is_new"] for i in before)
    assert sum(r["size"] for r in after.values()) == sum(r["size"] for r in before.values()) + sum(signatures(seed=3).values()) + 5
    for i, r in before.items():
        assert all(b in (a, "<*>") for a, b in zip(r["template"].split(" "), after[i]["template"].split(" "), strict=True))
    assert {(r["template_id"], r["size"]) for r in mined(spark, {}, first).collect()} == {(i, r["size"]) for i, r in before.items()}


def test_children_beyond_the_most_share_a_leaf_and_are_matched(spark):
    found = {(f"w{i}", "failed", "for", "host"): 10 - i for i in range(8)}
    got = mined(spark, found, max_children=3)
    assert {r["template"] for r in got.collect()} == {"w0 failed for host", "w1 failed for host", "<*> failed for host"}
    events = spark.createDataFrame([("c", "w1 failed for host"), ("c", "w6 failed for host"), ("c", "never seen at all"), ("d", "w1 failed for host")], "vendor string, signature_text string").withColumn("template_id", F.lit(""))
    names = {r["template_id"]: r["template"] for r in got.collect()}
    assert [names.get(r["template_id"], "") for r in templates.annotate(events, got).orderBy("vendor", F.desc("signature_text")).collect()] == ["<*> failed for host", "w1 failed for host", "", ""]


def test_numbers_follow_a_global_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = ordering.numbered(df, "n", F.col("a").desc(), F.col("b")).orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["n"] for r in got] == list(range(1, 501))
    assert ordering.numbered(df.limit(0), "n", F.col("a")).count() == 0


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(4)

    def spans(n, key):
        out = []
        for i in range(n):
            start = T0 + timedelta(seconds=rng.randrange(100_000))
            long = rng.choice([0, 0, 1, 30, 4000, 3_000_000])
            out.append((i, rng.choice("xyz"), start, start + timedelta(seconds=long) if i % 17 else (None if i % 2 else start - timedelta(seconds=1))))
        return spark.createDataFrame(out, f"{key} int, k string, {key}_a timestamp_ntz, {key}_b timestamp_ntz"), out

    (left, ls), (right, rs) = spans(120, "l"), spans(90, "r")
    got = ranges.overlap_join(left, right, (F.col("l_a"), F.col("l_b")), (F.col("r_a"), F.col("r_b")), on=("k",))
    expected = [(i, j) for i, k, a, b in ls for j, m, c, d in rs if k == m and b is not None and d is not None and a <= b and c <= d and a <= d and c <= b]
    pairs = [(r["l"], r["r"]) for r in got.collect()]
    assert sorted(pairs) == sorted(expected)
    assert ranges.overlap_join(left.limit(0), right, (F.col("l_a"), F.col("l_b")), (F.col("r_a"), F.col("r_b")), on=("k",)).count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def raw_records(spark, n=120):
    rows = [(f"e{i}", i, f"/net/core+x {i % 2}" if i % 5 else None, ["a", "b c", None][i % 3], bytes([i % 256, 0, 255])) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, i int, owner_group string, source_class string, body binary")
    return df.select(
        "event_id", F.expr("timestamp'2024-01-01 22:30:00' + make_dt_interval(0, 0, i, 0)").alias("received_at"),
        F.expr("case when i % 7 = 0 then timestamp'2024-01-01 22:30:00.123456' + make_dt_interval(0, 0, i, 0) end").alias("observed_at"), F.lit("k").alias("source_key"), F.lit("s").alias("source_id"), "owner_group",
        F.struct(F.lit("udp").alias("proto"), F.lit("192.0.2.1").alias("peer")).alias("transport"), F.lit("").alias("encoding_declared"), F.lit(0).alias("severity_number"),
        F.create_map(F.lit("a"), F.lit("b")).alias("attrs"), "source_class", "body",
    )


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    configure(spark)
    root = f"file://{tmp_path_factory.mktemp('archive')}"
    records = raw_records(spark)
    return root, records, archive.commit(records, root, object_bytes=1500)


def test_archive_round_trip_scope_and_manifest(spark, archived):
    root, records, manifest = archived
    got = {r["event_id"]: (bytes(r["body"]), r["received_at"], r["observed_at"], r["attrs"]) for r in archive.read_records(spark, root, ALL).collect()}
    assert got == {r["event_id"]: (bytes(r["body"]), r["received_at"], r["observed_at"], r["attrs"]) for r in records.collect()}
    one = AccessScope.groups("net/core+x 1")
    assert {r["event_id"] for r in archive.read_records(spark, root, one).collect()} == {f"e{i}" for i in range(120) if i % 5 and i % 2}
    assert {r["owner_group"] for r in archive.readable(manifest, one).collect()} == {"net/core+x 1"}
    assert archive.read_records(spark, root, AccessScope.nothing()).count() == 0
    assert archive.readable(spark.createDataFrame([("raw/x/y",)], "object_key string"), ALL).count() == 0
    assert manifest.agg(F.sum("event_count")).first()[0] == 120
    late = archive.read_records(spark, root, ALL, start="2024-01-01T23:00:00.5", end="2024-01-02")
    assert late.count() == sum(1 for i in range(120) if 30 <= i < 90 and not (i == 30))
    again = archive.commit(records.limit(3), root)
    assert again.agg(F.sum("event_count")).first()[0] == 123
    uncommitted = archive.write_batch(records, root)
    assert archive.read_records(spark, root, ALL).count() == 123
    assert archive.batch_manifest(spark, root, uncommitted).count() > 0


def test_scrub_tells_changed_and_lost_objects(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    manifest = archive.commit(raw_records(spark, 60), root, object_bytes=1500)
    files = sorted((tmp_path / "r" / "objects").rglob("part-*"))
    files[0].write_bytes(files[0].read_bytes() + b"x")
    files[1].unlink()
    once = archive.scrub(spark, root, manifest, "2024-02-01", most=10_000)
    states = {r["state"]: r["n"] for r in once.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert states == {"ChecksumMismatch": 1, "Missing": 1, "Verified": len(files) - 2}
    first = archive.scrub(spark, root, manifest, "2024-02-01", most=3)
    second = archive.scrub(spark, root, first, "2024-02-02", most=3)
    assert second.filter("last_scrubbed_at IS NOT NULL").count() == 6
    assert not archive.archive_states(once).first()["all_verified"]
    assert not archive.archive_states(once.limit(0)).first()["all_verified"]


def test_raw_lookup_looks_into_the_first_objects_only(spark, archived):
    root, records, _ = archived
    manifest = archive.manifest(spark, root)
    batch = manifest.groupBy("batch").agg(F.sum("event_count").alias("n")).orderBy(F.desc("n")).first()[0]
    at, owner = F.coalesce("observed_at", "received_at"), F.regexp_replace(F.coalesce("owner_group", F.lit("_unassigned")), "^/", "")
    events = records.select("event_id", F.date_trunc("millisecond", at).alias("ts"), archive.raw_ref(F.lit(batch), owner, at, F.coalesce("source_class", F.lit("default"))).alias("raw_ref"))
    found = archive.locate(spark, root, events, manifest, ALL)
    assert {r["event_id"]: bytes(r["body"]) for r in found.collect()} == {r["event_id"]: bytes(r["body"]) for r in records.collect()}
    few = archive.locate(spark, root, events, manifest, ALL, most=1).count()
    assert 0 < few <= 120
    assert archive.locate(spark, root, events, manifest, AccessScope.nothing()).count() == 0


def test_replay_skips_open_days_and_stops_at_missing_objects(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    manifest = archive.commit(raw_records(spark, 120), root)  # 22:30 to 00:29 of the next day
    table = raw_records(spark, 110).select("event_id", F.coalesce("observed_at", "received_at").cast("timestamp_ntz").alias("ts"), "owner_group", "source_id", F.lit("failed").alias("parse_status"), F.create_map(F.lit("a"), F.lit("b")).alias("attrs"))
    rebuild = lambda r: r.select("event_id", F.coalesce("observed_at", "received_at").cast("timestamp_ntz").alias("ts"), "owner_group", "source_id", F.lit("partial").alias("parse_status"), "attrs")
    run = lambda **k: replay.prepare(replay.ReplayPlan("2024-01-01", "2024-01-03", **k), root, manifest, table, rebuild, "2024-01-02T00:10:00", fields=["parse_status"])
    dry = run()
    assert ([r["day"] for r in dry.days.collect()], [r["day"] for r in dry.skipped.collect()]) == (["20240101"], ["20240102"])
    assert replay.report(dry.changed).first().asDict() == {"replayed": 90, "added": 0, "changed": 90, "unchanged": 0, "failed_to_ok": 90, "ok_to_failed": 0}
    assert {r["parse_status"] for r in dry.merged.collect()} == {"partial"}
    assert replay.samples(dry.changed).count() == replay.SAMPLES
    whole = replay.report(run(allow_open=True).changed).first()
    assert (whole["replayed"], whole["added"]) == (120, 10)
    next(iter((tmp_path / "r" / "objects").rglob("part-*"))).unlink()
    stopped = run()
    assert stopped.changed is None
    assert stopped.missing.count() == 1
    assert run(continue_on_missing=True, allow_open=True).changed.count() < 120


def test_report_counts_partial_as_not_failed(spark):
    schema = "event_id string, parse_status string, attrs map<string,string>"
    old = spark.createDataFrame([("1", "failed", None), ("2", "partial", {"a": "1", "b": "2"}), ("3", "ok", {}), ("4", "failed", {})], schema)
    new = spark.createDataFrame([("1", "partial", {"x": "9"}), ("2", "failed", {"b": "2", "c": "3"}), ("3", "ok", None), ("4", "failed", {"a": "1"})], schema)
    changed = replay.diff(old, new, ["parse_status"], attrs="attrs")
    got = {r["event_id"]: [(c["field"], c["before"], c["after"]) for c in r["changes"]] for r in changed.collect()}
    assert got["2"] == [("parse_status", "partial", "failed"), ("attrs.a", "1", ""), ("attrs.c", "", "3")]
    assert got["3"] == []
    report = replay.report(changed).first()
    assert (report["changed"], report["unchanged"], report["failed_to_ok"], report["ok_to_failed"]) == (3, 1, 1, 1)


def test_inventory_lines_are_numbered_over_many_tasks(spark, tmp_path, monkeypatch):
    lines = ["# c", "source_id,owner_group,hostname", ""] + [f"s{i},g{i % 2},h{i}\r" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["line"]: r["value"] for r in inventory.read_lines(spark, str(tmp_path / "a.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {1: lines[1]} | {i + 2: f"s{i},g{i % 2},h{i}" for i in range(3000)}


def test_inventory_import_is_all_or_nothing(spark):
    text = lambda *values: spark.createDataFrame(list(enumerate(values, 1)), "line long, value string")
    problems = lambda found: [(r["line"], r["problem"], r["detail"]) for r in found.errors.orderBy("line").collect()]
    assert problems(inventory.check(text(), ALL))[0][:2] == (0, "empty")
    assert problems(inventory.check(text("source_id,owner_group"), ALL))[0][:2] == (0, "empty")
    assert problems(inventory.check(text("source_id,group", "a,b"), ALL)) == [(0, "column", "owner_group")]
    bad = inventory.check(text("source_id, owner_group,x", "a,g,1", "a,h,2", "b,h,", " ,g,", "c,g", "a,g,3"), AccessScope.groups("g"))
    assert problems(bad) == [(3, "repeated", "a in line 2"), (4, "scope", "h"), (5, "blank", ""), (6, "cells", "2 of 3"), (7, "repeated", "a in line 2")]
    assert bad.rows.count() == 0
    good = inventory.check(text("source_id,owner_group,encoding,source_id", "a, g ,,z", "b,g,utf-8,z"), ALL)
    assert [(r["source_id"], r["owner_group"], r["encoding"], r["source_class"]) for r in good.rows.orderBy("source_id").collect()] == [("a", "g", "auto", "default"), ("b", "g", "utf-8", "default")]
    assert problems(good) == []


def test_addresses_equal_the_library(spark):
    rng = random.Random(9)
    texts = ["", "::", "::1", "1::", "0:0:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:0:2:0:3:0:4:0", "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::192.0.2.33", "1.2.3.4", "1.2.3.256", "01.2.3.4", "1.2.3", "g::1", ":::", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "FE80::A", None]
    for _ in range(300):
        number = rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF << 64 | 0xFF, 0xFFFFFFFF, (2**128 - 1) ^ (0xFFFFFFFF << 32)])
        address = ipaddress.IPv6Address(number)
        texts += [str(address), address.exploded.upper()]

    def expected(text):
        try:
            found = ipaddress.ip_address(text)
        except ValueError:
            return None
        found = getattr(found, "ipv4_mapped", None) or found
        return None if int(found) == 0 and found.version == 6 else str(found) if found.version == 4 else ":".join(str(found).split(":"))

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["a"] for r in rows.select("i", addresses.canonical_address(F.col("t")).alias("a")).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    net = rows.select("i", addresses.within(F.col("t"), "1.2.0.0/16").alias("w")).filter("w").collect()
    assert {texts[r["i"]] for r in net} == {"::ffff:1.2.3.4", "1.2.3.4"}


def brute_fragments(body, values, keys):
    values = {v for v in values if v and len(v) >= 2}
    single = {v for v in values if not any(len(o) < len(v) and o in v for o in values)}
    covered = [False] * len(body)
    for v in single | {k for k in keys if len(k) >= 2}:
        for i in range(len(body) - len(v) + 1):
            if body[i : i + len(v)] == v:
                covered[i : i + len(v)] = [True] * len(v)
    text = "".join("\0" if c else x for x, c in zip(body, covered, strict=True))
    return [p.strip() for p in text.split("\0") if len(p.strip()) >= 4]


def test_fragments_are_the_complement_of_what_is_covered(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        body = "".join(rng.choice("ab c1") for _ in range(rng.randrange(0, 40)))
        cut = lambda: body[(a := rng.randrange(len(body) + 1)) : a + rng.randrange(6)]  # noqa: B023, E731
        rows.append((i, body, cut(), cut(), {f"k{i % 3}": cut(), "ab": None}, body))
    rows.append((999, None, "a", "b", None, "x"))
    df = spark.createDataFrame(rows, "i int, body string, action string, host string, attrs map<string,string>, raw_ref string")
    got = {r["i"]: r["fragments"] for r in fragments.uncaptured(df, ("action", "host", "raw_ref")).collect()}
    assert got == {i: brute_fragments(body or "", [a, h, *(m or {}).values()], (m or {}).keys()) for i, body, a, h, m, _ in rows}


def stream_of(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    files = sorted(folder.glob("*/part-*.parquet"))
    for i, f in enumerate(files):  # one file a batch, in order
        f.rename(folder / f"{i:03d}.parquet")
        import os

        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))


def test_silence_fires_without_an_arriving_row(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    arrivals = stream_of(spark, tmp_path / "a", "source_id string, ingested_at timestamp_ntz", [
        [("a", at(1)), ("b", at(2)), ("off", at(2)), ("unlisted", at(2))], [("a", at(30))], [("a", at(100))], [("c", at(400)), ("ahead", at(9_000_000)), (None, at(1))],
    ])
    listed = [(s, "g", s != "off", at(0)) for s in ("a", "b", "c", "off", "quiet", "ahead")]
    inventory_stream = stream_of(spark, tmp_path / "i", "source_id string, owner_group string, enabled boolean, created_at timestamp_ntz", [listed])
    found = live.drain(live.silences(arrivals, inventory_stream, 3600, late="10 minutes", now=F.lit(at(400))), "silences").collect()
    got = {(r["source_id"], r["never_seen"], r["fired_at"]) for r in found}
    assert got == {("a", False, at(90)), ("a", False, at(160)), ("b", False, at(62)), ("c", True, at(60)), ("quiet", True, at(60)), ("ahead", True, at(60))}
    assert len(found) == len(got)


def test_sources_of_one_group_keep_their_own_silences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SOURCE_GROUPS", 1)
    at = lambda minute: minutes(minute)[0]
    rng = random.Random(2)
    batches = [[(f"s{i}", at(rng.randint(0, 80))) for i in range(30) for _ in range(3)], [(f"s{i}", at(rng.randint(60, 600))) for i in range(10, 40) for _ in range(4)]]
    arrivals = stream_of(spark, tmp_path / "a", "source_id string, ingested_at timestamp_ntz", [*batches, [("s0", at(1000)), ("late", at(5))]])
    listed = stream_of(spark, tmp_path / "i", "source_id string, owner_group string, enabled boolean, created_at timestamp_ntz", [[(f"s{i}", "g", i % 7 != 0, at(0)) for i in range(50)]])
    found = live.drain(live.silences(arrivals, listed, 3600, late="10 minutes", now=F.lit(at(2000))), "silences").collect()
    got = sorted((r["source_id"], r["never_seen"], r["fired_at"]) for r in found)
    wanted, last = [], {f"s{i}": (at(0), True, False) for i in range(50) if i % 7}
    for rows in [*batches, []]:
        for source, when in sorted(rows, key=lambda r: r[1]):
            if source in last:
                since, never, told = last[source]
                if when - since >= timedelta(hours=1) and not told:
                    wanted.append((source, never, since + timedelta(hours=1)))
                if never or when > since:
                    last[source] = (when, False, False)
        # Time passes each batch; what is due by then and was not told before is told once.
        newest = max((r[1] for r in rows), default=at(1000)) - timedelta(minutes=10)
        for source, (since, never, told) in last.items():
            if not told and since + timedelta(hours=1) < newest:
                wanted.append((source, never, since + timedelta(hours=1)))
                last[source] = (since, never, True)
    assert got == sorted(wanted)


def test_ingest_deals_a_single_file_over_all_cores(spark, tmp_path):
    from logmeridian.functions.exprs import TEXT_MAP
    from logmeridian.parsing_queries import PARSERS
    from logmeridian.streaming import ingest

    rows = spark.range(200).select(
        F.col("id").cast("string").alias("event_id"), F.lit(T0).alias("received_at"), F.lit(T0).alias("observed_at"), F.lit("key").alias("source_key"), F.lit("s").alias("source_id"),
        F.lit("g").alias("owner_group"), F.encode(F.concat(F.lit("noise "), "id"), "UTF-8").alias("body"), F.create_map().cast(TEXT_MAP).alias("given"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), PARSERS, f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True).awaitTermination()
    out = store.scan_events(spark, f"{tmp_path}/out")
    assert out.count() == 200
    assert len(out.inputFiles()) == spark.sparkContext.defaultParallelism


def test_repeats_over_batches_of_a_stream(spark, tmp_path):
    rows = [[("1", "r", T0), ("2", "r", minutes(8)[0])], [("3", "r", minutes(16)[0]), ("4", "x", minutes(16)[0]), ("5", None, T0)], [("6", "r", minutes(25)[0]), ("7", "r", minutes(26)[0])]]
    stream = stream_of(spark, tmp_path / "s", "id string, rule_id string, fired_at timestamp_ntz", rows)
    got = {r["id"]: r["reason"] for r in live.drain(live.repeats(stream, 600), "repeats").collect()}
    assert got == {"1": "", "2": "repeat", "3": "", "4": "", "6": "repeat", "7": ""}


def test_trigger_counts_need_no_plan_for_each_trigger(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("s", "g", at(1), 7, "old"), ("s", "g", at(200), 7, "old"), ("s", "g", at(200), 7, "old"), ("s", "g", at(201), 8, "new"), ("t", "g", at(200), 9, "other"), ("u", "h", at(200), 5, "far"), ("s", "g", at(200), 0, "")]
    events = spark.createDataFrame(rows, "source_id string, owner_group string, ts timestamp_ntz, signature_hash long, signature_text string")
    asked = spark.createDataFrame([(1, "g", "s", at(200), at(202)), (2, "g", " ", at(199), at(201)), (3, "g", "s", at(5), at(5)), (4, "g", "s", at(160), at(300))], "trigger_id int, owner_group string, source_id string, window_from timestamp_ntz, window_to timestamp_ntz")
    got = {(r["trigger_id"], r["signature_text"]): (r["window_count"], r["baseline_count"]) for r in triggers.signature_counts(asked, events, ALL).collect()}
    assert got == {(1, "old"): (2, 0), (1, "new"): (1, 0), (2, "old"): (2, 0), (2, "other"): (1, 0), (4, "old"): (2, 1), (4, "new"): (1, 0)}
    slices = {(r["trigger_id"], r["provider_id"]): r["status"] for r in triggers.trigger_slices(asked, triggers.trigger_findings(asked, events, ALL)).collect()}
    assert slices[(1, "logs.first-seen")] == "gathered"
    assert slices[(4, "logs.volume")] == "empty"


@pytest.mark.parametrize("tile", [5, 1 << 19])
def test_trigger_counts_equal_brute_force_in_tiles_of_any_size(spark, monkeypatch, tile):
    monkeypatch.setattr(triggers, "TILE_EVENTS", tile)
    monkeypatch.setattr(triggers, "TILE_TRIGGERS", tile)
    rng = random.Random(3)
    at = lambda: T0 + timedelta(minutes=rng.randint(0, 30_000), microseconds=rng.choice([0, 1]))
    rows = [(rng.choice(["s", "t", None]), rng.choice(["g", "h", None]), rng.choice([at(), None]) if i % 9 == 0 else at(), rng.randint(0, 6)) for i in range(400)]
    events = spark.createDataFrame([(s, g, t, n, f"text {n}" if n else "") for s, g, t, n in rows], "source_id string, owner_group string, ts timestamp_ntz, signature_hash long, signature_text string")
    asked = []
    for i in range(60):
        start = at()
        asked.append((rng.choice([i, 3, None]) if i % 4 == 0 else i, rng.choice(["g", "h", None]), rng.choice(["s", "t", " ", None]), start, start + timedelta(minutes=rng.choice([-5, 1, 600, 20_000]))))
    wanted = {}
    for trigger, group, source, start, end in asked:
        for s, g, t, n in rows:
            mine = s == source if (source or "").strip() else g is not None and g == group
            if start < end and mine and n and t is not None and start - timedelta(days=7) <= t < end:
                seen = wanted.setdefault((trigger, n), [0, 0, None, timedelta(0)])
                seen[t < start] += 1
                seen[3] = max(seen[3], end - start)
                if t >= start:
                    seen[2] = min(seen[2] or t, t)
    got = triggers.signature_counts(spark.createDataFrame(asked, "trigger_id int, owner_group string, source_id string, window_from timestamp_ntz, window_to timestamp_ntz"), events, ALL).collect()
    told = {(r["trigger_id"], r["signature_hash"]): (r["window_count"], r["baseline_count"], r["first_seen_at"], round(r["expected"], 9)) for r in got}
    assert len(told) == len(got)
    assert told == {k: (w, b, first, round(b * (span / timedelta(days=7)), 9)) for k, (w, b, first, span) in wanted.items() if w}


def test_trigger_findings_pass_over_the_counts_once(spark):
    events = spark.createDataFrame([("s", "g", T0, 7, "old")], "source_id string, owner_group string, ts timestamp_ntz, signature_hash long, signature_text string")
    asked = spark.createDataFrame([(1, "g", "s", T0, T0 + timedelta(hours=1))], "trigger_id int, owner_group string, source_id string, window_from timestamp_ntz, window_to timestamp_ntz")
    plans = [f(asked, events, ALL)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") for f in (triggers.signature_counts, triggers.trigger_findings)]
    assert plans[0] == plans[1] > 0


def test_store_fills_what_is_missing_and_refuses_foreign_changes(spark, tmp_path):
    events = spark.createDataFrame([("1", T0, None)], "event_id string, ts timestamp_ntz, host string")
    store.append_events(events, f"{tmp_path}/e")
    row = store.scan_events(spark, f"{tmp_path}/e").first()
    assert (row["event_id"], row["host"], row["dst_port"], row["attrs"], str(row["event_date"])) == ("1", "", 0, {}, "2024-01-01")
    changes = spark.createDataFrame([("a", T0), ("b", T0), (None, T0)], "owner_group string, ts timestamp_ntz")
    refused = store.write_changes(changes, f"{tmp_path}/c", AccessScope.groups("a"))
    assert sorted(str(r["owner_group"]) for r in refused.collect()) == ["None", "b"]
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1


def test_masks_and_parsers_stand_once_in_each_scan(spark):
    import __spark_entry__ as contract

    def copies(name, mark):
        return contract.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count(mark)

    assert {n: copies(n, "<UUID>") for n in ("masked_signatures", "signature_volume", "signature_volume_zscore")} == {"masked_signatures": 1, "signature_volume": 1, "signature_volume_zscore": 1}
    assert copies("first_seen_signatures", "<UUID>") == 2  # the window and the baseline
    assert copies("parser_wins", "%ASA-") == copies("parse_events", "%ASA-")


def test_json_opens_every_level(spark):
    import json

    deep = "x"
    for i in reversed(range(12)):
        deep = {f"k{i}": deep, "n": None, "a": [1, {"b": 2}]}
    rows = [(json.dumps(deep),), ('{"a": {}, "b": "{no json", "c": "{\\"d\\": {\\"e\\": 1}}"}',), ("[1]",), ("{broken",)]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").select(steps.Json().read(F.col("t")).alias("f")).collect()]
    assert got[0][".".join(f"k{i}" for i in range(12))] == "x"
    assert got[0]["k0.k1.k2.k3.k4.k5.k6.k7.k8.a"] == '[1,{"b":2}]'
    assert (got[1]["b"], got[1]["c.d.e"], got[2]) == ("{no json", "1", None)


def test_grok_syntax_is_rewritten_and_files_are_loaded(spark, tmp_path):
    assert grok_library.rewritten(r"\h+ [[:alpha:]_&[]+ []x]+ (?<[a][b]>y) (?P<c>z) %{DATA:[d][e]}") == r"[0-9a-fA-F]+ [\p{Alpha}_\&\[]+ [\]x]+ (?<a.b>y) (?<c>z) %{DATA:[d][e]}"
    (tmp_path / "one").write_text("# comment\nHEX \\h+\nTHING [[:digit:]]+(?<[own][part]>[a-z]*)\n\n")
    (tmp_path / "two").write_text("HEX \\h+\n")
    (tmp_path / "LICENSE").write_text("not a pattern")
    (tmp_path / "over").mkdir()
    (tmp_path / "over" / "x").write_text("WORD [A-Z]+\n")
    loaded = grok_library.load_patterns(str(tmp_path))
    assert (loaded["HEX"], loaded["WORD"]) == ("[0-9a-fA-F]+", "[A-Z]+")  # the overlay lies below the folder here
    assert grok_library.load_patterns(str(tmp_path / "over"), str(tmp_path / "nowhere"))["INT"] == grok_library.PATTERNS["INT"]
    with pytest.raises(ValueError, match="two patterns"):
        grok_library.parse_patterns([("a", "X 1"), ("b", "X 2")])
    step = steps.Grok(patterns=(r"^%{HEX:id} %{THING:[a][thing]} (?<rest_of_it>.*)$",), definitions=loaded)
    got = spark.createDataFrame([("00ff 12ab the rest",), ("zz",)], "t string").select(step.read(F.col("t")).alias("f")).collect()
    assert got[0]["f"] == {"id": "00ff", "a.thing": "12ab", "own.part": "ab", "rest_of_it": "the rest"}
    assert got[1]["f"] is None


def test_every_library_pattern_compiles_and_takes_an_example(spark):
    examples = {
        "EMAILADDRESS": "a.b+c@example.org", "QS": '"a \\" b"', "UUID": "123e4567-e89b-12d3-a456-426614174000", "MAC": "00:1a:2B:3c:4d:5e", "IP": "2001:db8::1", "HOSTPORT": "h.example:80", "UNIXPATH": "/a/b.c",
        "WINPATH": "C:\\a\\b", "URI": "http://u@example.org:80/p/q?x=1", "DATESTAMP": "01/02/2024 10:11:12", "TIMESTAMP_ISO8601": "2024-01-02T03:04:05.678+03:00", "DATESTAMP_RFC2822": "Mon, 01 Jan 2024 10:11:12 +0000",
        "SYSLOGBASE": "Jan  1 10:11:12 host sshd[42]:", "LOGLEVEL": "WARN", "TTY": "/dev/pts/3", "URN": "urn:isbn:12", "DATESTAMP_EVENTLOG": "20240102030405",
        "COMBINEDAPACHELOG": '192.0.2.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326 "http://x/" "Mozilla/4.08"',
    }
    regexes = {name: steps.expand(f"^%{{{name}}}$", grok_library.PATTERNS)[0] for name in grok_library.PATTERNS}
    row = spark.range(1).select(*[F.lit(examples.get(n, "x")).rlike(r).alias(n) for n, r in regexes.items()]).first()
    assert [n for n in examples if not row[n]] == []


def test_bundles_are_kept_and_shown_to_those_who_may_read_them(spark, tmp_path):
    window = CorrelationWindow("2024-01-29", "2024-01-30", "2024-01-22", "2024-01-29")
    rows, slices = spark.createDataFrame([("a", 1.0)], "item_id string, weight double"), spark.createDataFrame([("p", "gathered")], "provider_id string, status string")
    for name, scope in (("one", AccessScope.groups("g", "h")), ("two", AccessScope.groups("g")), ("system", AccessScope.system())):
        bundles.save_bundle(rows, slices, str(tmp_path), name, "2024-02-01", window, scope)
    stored = bundles.stored_bundles(spark, str(tmp_path))
    assert [r["bundle_id"] for r in bundles.recent_bundles(stored, AccessScope.groups("g")).collect()] == ["two"]
    assert [r["bundle_id"] for r in bundles.recent_bundles(stored, ALL, 0).collect()] == ["one"]
    assert stored.count() == 3
    found, parts = bundles.load_bundle(spark, str(tmp_path), "two", AccessScope.groups("g"))
    assert (found.first()["item_id"], parts.first()["status"]) == ("a", "gathered")
    assert bundles.load_bundle(spark, str(tmp_path), "one", AccessScope.groups("g")) is None
    stored.limit(1).withColumn("schema_version", F.lit(9)).withColumn("bundle_id", F.lit("new")).write.mode("append").parquet(f"{tmp_path}/bundles")
    with pytest.raises(ValueError, match="schema version 9"):
        bundles.load_bundle(spark, str(tmp_path), "new", ALL)
