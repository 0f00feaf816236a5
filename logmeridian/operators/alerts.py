"""Alert rules over the event table: threshold, ratio, silence, and what suppresses a trigger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.functions.exprs import count_true
from logmeridian.functions.scores import compare, seconds_between
from logmeridian.windows import Instant, instant, to_instant


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``threshold`` (count of the trailing window) or ``ratio`` (over the window before it, at least 1)."""

    id: str
    kind: str
    window_seconds: int
    threshold: float
    comparison: str
    owner_groups: tuple[str, ...] = ()
    predicate: str = "true"

    def rows(self) -> Column:
        chosen = F.expr(self.predicate)
        return chosen & F.col("owner_group").isin(list(self.owner_groups)) if self.owner_groups else chosen


def evaluate(events: DataFrame, rules: Sequence[Rule], now: Instant) -> DataFrame:
    """``rule_id, value, fired`` for every rule, from one scan of the longest span any rule needs."""
    at = to_instant(now)
    span = max(r.window_seconds * (2 if r.kind == "ratio" else 1) for r in rules)

    def count(rule: Rule, first: int, last: int) -> Column:
        a, b = (instant(at - timedelta(seconds=rule.window_seconds * n)) for n in (first, last))
        return count_true(rule.rows() & (F.col("ts") >= a) & (F.col("ts") < b))

    rows = events.filter((F.col("ts") >= instant(at - timedelta(seconds=span))) & (F.col("ts") < instant(at)))
    counted = rows.agg(*[c for i, r in enumerate(rules) for c in (count(r, 1, 0).alias(f"w{i}"), count(r, 2, 1).alias(f"p{i}"))])
    found = []
    for i, rule in enumerate(rules):
        value = F.col(f"w{i}").cast("double")
        if rule.kind == "ratio":
            value = value / F.greatest(F.col(f"p{i}"), F.lit(1))
        elif rule.kind != "threshold":
            raise ValueError(f"unknown rule kind {rule.kind!r}")
        fired = compare(value, F.lit(rule.threshold), F.lit(rule.comparison))
        found.append(F.struct(F.lit(rule.id).alias("rule_id"), value.alias("value"), fired.alias("fired")))
    return counted.select(F.inline(F.array(*found)))


def silent_inventory(inventory: DataFrame, events: DataFrame, now: Instant, silence_seconds: int) -> DataFrame:
    """Enabled sources that sent nothing for so long; never-seen ones count from their creation.

    Time is that of ingest; a clock ahead of ``now`` counts as no silence.
    """
    last = events.filter(F.col("ts") < instant(now)).groupBy("source_id").agg(F.max("ingested_at").alias("last_at"))
    joined = inventory.filter("enabled").select("owner_group", "source_id", "created_at").join(last, "source_id", "left")
    quiet = seconds_between(instant(now), F.coalesce("last_at", "created_at"))
    return joined.select(
        "owner_group", "source_id", F.col("last_at").isNull().alias("never_seen"), F.greatest(F.lit(0), F.floor(quiet)).cast("long").alias("silent_seconds")
    ).filter(F.col("silent_seconds") >= silence_seconds)


def hits(events: DataFrame, inventory: DataFrame, rules: Sequence[Rule], now: Instant, silence_lookback: int = 86_400) -> DataFrame:
    """``rule_id, state, owner_group, source_id, value, threshold, window_from, window_to, summary``: what ``rules`` find at ``now``.

    A counting rule that fires is one hit of all its groups; one of kind ``silence`` is a hit for each source that has sent nothing for its
    ``window_seconds``, from when it was last heard or ``silence_lookback`` ago. A rule without hits has one row in the state ``quiet``.
    """
    at = to_instant(now)
    counting, silent = [r for r in rules if r.kind != "silence"], [r for r in rules if r.kind == "silence"]
    found = []
    if counting:
        known = F.create_map(*[x for r in counting for x in (F.lit(r.id), F.struct(F.lit(",".join(r.owner_groups)).alias("groups"), F.lit(float(r.threshold)).alias("threshold"), F.lit(r.window_seconds).alias("span"), F.lit(r.comparison).alias("sign")))])
        rule = known[F.col("rule_id")]
        found.append(evaluate(events, counting, now).filter("fired").select(
            "rule_id", rule["groups"].alias("owner_group"), F.lit("").alias("source_id"), "value", rule["threshold"].alias("threshold"),
            (instant(at) - F.make_dt_interval(secs=rule["span"])).alias("window_from"),
            F.concat(F.round("value", 2).cast("string"), F.lit(" in "), rule["span"], F.lit(" s, limit "), rule["sign"], F.lit(" "), rule["threshold"]).alias("summary"),
        ))
    for r in silent:
        mine = inventory.filter(F.col("owner_group").isin(list(r.owner_groups))) if r.owner_groups else inventory
        seconds = F.col("silent_seconds")
        found.append(silent_inventory(mine, events, now, r.window_seconds).select(
            F.lit(r.id).alias("rule_id"), "owner_group", "source_id", seconds.cast("double").alias("value"), F.lit(float(r.window_seconds)).alias("threshold"),
            (instant(at) - F.make_dt_interval(secs=F.least(seconds, F.lit(silence_lookback)))).alias("window_from"),
            F.concat(F.col("source_id"), F.when(F.col("never_seen"), " never sent anything in ").otherwise(" silent for "), seconds, F.lit(" s, limit "), F.lit(r.window_seconds), F.lit(" s")).alias("summary"),
        ))
    fired = reduce(DataFrame.unionByName, found)
    named = events.sparkSession.createDataFrame([(r.id,) for r in rules], "rule_id string")
    joined = named.join(fired, "rule_id", "left")
    return joined.select(
        "rule_id", F.when(F.col("value").isNull(), "quiet").otherwise("fired").alias("state"), "owner_group", "source_id", "value", "threshold", "window_from",
        F.when(F.col("value").isNotNull(), instant(at)).alias("window_to"), "summary",
    )


def groups_of(owner_group: Column) -> Column:
    """The owner groups of a comma-separated list, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(owner_group, F.lit("")), ","), lambda g: F.trim(g)), lambda g: g != "")


def disjoint(intervals: DataFrame, key: str) -> DataFrame:
    """``key, starts_at, ends_at``: half-open intervals of a key, those that touch or overlap made one."""
    order = Window.partitionBy(key).orderBy("starts_at")
    reach = F.max("ends_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("starts_at") > reach), 1).otherwise(0)
    numbered = intervals.filter("starts_at < ends_at").withColumn("fresh_", fresh).withColumn("run_", F.sum("fresh_").over(order))
    return numbered.groupBy(key, "run_").agg(F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at")).drop("run_")


def held_by_maintenance(triggers: DataFrame, windows: DataFrame) -> DataFrame:
    """``id`` of the triggers that fire inside a window of their rule or, for windows without a rule, of one of their groups."""

    def under(key: str, rows: DataFrame, some: DataFrame) -> DataFrame:
        spans = disjoint(some.filter(F.col(key).isNotNull()).select(key, "starts_at", "ends_at"), key).withColumnRenamed(key, "key_")
        inside = (F.col(key) == F.col("key_")) & (F.col("starts_at") <= F.col("fired_at")) & (F.col("fired_at") < F.col("ends_at"))
        return rows.join(spans, inside, "left_semi").select("id")

    by_group = triggers.select("id", "fired_at", F.explode(groups_of(F.col("owner_group"))).alias("owner_group"))
    return under("rule_id", triggers.select("id", "fired_at", "rule_id"), windows).unionByName(under("owner_group", by_group, windows.filter("rule_id IS NULL"))).distinct()


#: A rule's time is cut into spans of at least so many repeat intervals, longer ones while they hold few firings.
SPAN_INTERVALS, SPAN_FIRINGS = 4, 4096
_NEVER = -(2**63)
_SPAN = ["rule_id", "gap", "width", "span"]


def _followers(at: np.ndarray, gap: int) -> np.ndarray:
    """For each firing (sorted) the first that is ``gap`` or more after it; their number where there is none."""
    return np.searchsorted(at, at + gap, "left")


def _leaves(rows: pa.Table) -> pa.Table:
    """How a span maps the instant from which a firing may go out, as it comes in, to the one it leaves behind.

    An instant up to ``bounds[i]`` (and above the bound before) becomes ``exits[i]``; a later one stays.
    """
    at = np.sort(rows.column("at").to_numpy())
    gap, start = rows.column("gap")[0].as_py(), rows.column("width")[0].as_py() * rows.column("span")[0].as_py()
    after = _followers(at, gap)
    last = np.where(after < len(at), after, np.arange(len(at)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # Nothing kept before the span forbids firings beyond its first interval.
    used = min(len(at), int(np.searchsorted(at, start + gap, "left")) + 1)
    bounds, exits = at[:used], at[last[:used]] + gap
    ends = np.append(exits[1:] != exits[:-1], True)
    return pa.table({**{c: rows.column(c).slice(0, 1) for c in _SPAN}, "bounds": pa.array([bounds[ends]], pa.list_(pa.int64())), "exits": pa.array([exits[ends]], pa.list_(pa.int64()))})


def _enters(rows: pa.Table) -> pa.Table:
    """The instant from which a firing may go out at the start of every span of one rule."""
    rows = rows.sort_by("span")
    free, found = _NEVER, []
    for bounds, exits in zip(rows.column("bounds"), rows.column("exits"), strict=True):
        found.append(free)
        i = int(np.searchsorted(bounds.values.to_numpy(), free, "left"))
        free = exits.values[i].as_py() if i < len(exits) else free
    return rows.select(_SPAN).append_column("free", pa.array(found, pa.int64()))


def _goes_out(rows: pa.Table) -> pa.Table:
    at = np.sort(rows.column("at").to_numpy())
    after = _followers(at, rows.column("gap")[0].as_py())
    i, kept = int(np.searchsorted(at, rows.column("free")[0].as_py(), "left")), []
    while i < len(at):
        kept.append(i)
        i = int(after[i])
    rule = pa.chunked_array([rows.column("rule_id").slice(0, 1)]).combine_chunks()
    return pa.table({"rule_id": rule.take(pa.array([0] * len(kept), pa.int64())), "at": pa.array(at[kept], pa.int64())})


def kept_firings(firings: DataFrame) -> DataFrame:
    """``rule_id, at`` of the firings that go out, from distinct ``rule_id, gap, at`` (microseconds).

    The first firing of a rule goes out, and then each first one that comes ``gap`` or more after the last that did. A
    rule's time is cut into spans. Each span tells, without knowing what came before, how it maps the instant from
    which a firing may go out; a rule's spans, as many as its time holds intervals and not rows, are then followed in
    order, and every span marks its firings from where the chain enters it. No task holds all firings of a rule.
    """
    rules = firings.filter("gap > 0").groupBy("rule_id", "gap").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    intervals = F.greatest(F.lit(SPAN_INTERVALS), F.ceil(SPAN_FIRINGS * ((F.col("last") - F.col("first")) / F.col("gap") + 1) / F.col("n"))).cast("long")
    widths = rules.select(F.col("rule_id").alias("r_"), F.col("gap").alias("g_"), (intervals * F.col("gap")).alias("width"))
    spans = firings.join(widths, F.col("rule_id").eqNullSafe(F.col("r_")) & (F.col("gap") == F.col("g_"))).select("rule_id", "gap", "width", F.floor(F.col("at") / F.col("width")).alias("span"), "at")
    keys = "rule_id string, gap long, width long, span long"
    leaves = spans.groupBy(*_SPAN).applyInArrow(_leaves, f"{keys}, bounds array<long>, exits array<long>")
    enters = leaves.groupBy("rule_id", "gap").applyInArrow(_enters, f"{keys}, free long").select(F.col("rule_id").alias("r_"), F.col("gap").alias("g_"), F.col("span").alias("s_"), "free")
    entered = spans.join(enters, F.col("rule_id").eqNullSafe(F.col("r_")) & (F.col("gap") == F.col("g_")) & (F.col("span") == F.col("s_")))
    marked = entered.select(*_SPAN, "at", "free").groupBy(*_SPAN).applyInArrow(_goes_out, "rule_id string, at long")
    return marked.unionByName(firings.filter("gap <= 0").select("rule_id", "at"))


def suppression(triggers: DataFrame, windows: DataFrame, repeat_seconds: int | Column) -> DataFrame:
    """``id, reason``: ``maintenance`` before ``repeat``, empty for a trigger that goes out.

    A maintenance window names a rule or, without one, an owner group; ``owner_group`` of a trigger may list several, separated by
    commas. A trigger repeats when less than ``repeat_seconds`` (a number, or a column of the rule's own) have passed
    since the rule's last firing that went out; what is held does not count, and triggers of one instant are one firing. Intervals
    of 0 or less, or null, hold nothing. Triggers without an instant go out; null rules are one rule.
    """
    gap = F.coalesce((F.lit(repeat_seconds) if isinstance(repeat_seconds, int) else repeat_seconds).cast("long"), F.lit(0)) * 1_000_000
    held = held_by_maintenance(triggers, windows).withColumn("held", F.lit(True))
    timed = triggers.select("id", F.col("rule_id").cast("string").alias("rule_id"), gap.alias("gap"), F.unix_micros(F.col("fired_at").cast("timestamp")).alias("at")).join(held, "id", "left")
    free = timed.filter("held IS NULL AND at IS NOT NULL")
    out = kept_firings(free.select("rule_id", "gap", "at").distinct()).select(F.col("rule_id").alias("r_"), F.col("at").alias("a_")).distinct().withColumn("out", F.lit(True))
    joined = timed.join(out, F.col("rule_id").eqNullSafe(F.col("r_")) & (F.col("at") == F.col("a_")), "left")
    return joined.select("id", F.when(F.col("held"), "maintenance").when(F.col("out") | F.col("at").isNull(), "").otherwise("repeat").alias("reason"))
