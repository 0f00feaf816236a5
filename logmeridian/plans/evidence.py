"""Evidence for an incident window: providers, slices, ranking, timeline, report flags, content hash.

Every provider returns at most ``budget + 1`` findings, so all that follows (ranking, timeline, hash)
works on a few thousand rows whatever the event table holds. Providers that group the same way share
one exchange, since their subplans are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.functions import scores
from logmeridian.functions.exprs import decimal_text, ellipsis, text_map, utc_text
from logmeridian.functions.signature import unsigned_text
from logmeridian.operators.ordering import numbered
from logmeridian.operators import correlate
from logmeridian.operators.search import change_criteria, count_events_out_of_scope
from logmeridian.schemas import LIFT_FIELDS
from logmeridian.scope import AccessScope, in_scope, out_of_scope
from logmeridian.session import cut_lineage
from logmeridian.windows import ChangeQuery, CorrelationWindow, EventQuery, instant

CHANGE_LEAD = timedelta(minutes=30)
EVER_PROBE = timedelta(days=365)
EVIDENCE_KINDS = ("log", "change", "metric", "trace", "topology")

#: Ranking classes (fixed values); providers without an entry rank below all of them.
CLASS_RANKS = {
    "change.feed": 6,
    "logs.first-seen": 5,
    "logs.propagation": 4,
    "logs.silence": 3,
    "logs.volume": 2,
    "logs.attribute-lift": 1,
    "logs.window": 0,
}
UNRANKED = -1

FINDING_COLUMNS = ("item_id", "provider_id", "kind", "ts", "weight", "summary", "payload", "order_in_slice")


@dataclass(frozen=True)
class Inputs:
    """What a provider may read, and the report's thresholds."""

    events: DataFrame
    changes: DataFrame
    window: CorrelationWindow
    scope: AccessScope
    #: Findings kept per provider; all of them if not given.
    budget: int | None = None
    min_z: float = 3.0
    min_count: int = 5
    min_lift: float = 2.0
    min_expected: float = 5.0
    lift_limit: int | None = None
    severity_mode: str = "ge"
    severity: int = 4
    #: How a signature is labelled in item ids; the label must be a function of the hash.
    label: str | None = None
    #: The moment "has the change feed ever been fed" is asked at.
    now: datetime | None = None

    @property
    def signature_keys(self) -> list[str]:
        return ["signature_hash"] + ([self.label] if self.label else [])

    @property
    def signature_label(self) -> Column:
        return F.col(self.label) if self.label else unsigned_text(F.col("signature_hash"))


@dataclass(frozen=True)
class Slice:
    """A provider's findings (budget + 1 at most) and, where it has any, its out-of-scope count."""

    findings: DataFrame
    out_of_scope: DataFrame | None = None
    #: One-row frame whose boolean ``fed`` tells "looked, found nothing" from "never fed".
    fed: DataFrame | None = None


@dataclass(frozen=True)
class Provider:
    id: str
    kind: str
    gather: Callable[[Inputs], Slice]
    available: bool = True


@dataclass(frozen=True)
class Report:
    findings: DataFrame
    slices: DataFrame
    failures: dict[str, str] = field(default_factory=dict)


def _top(df: DataFrame, budget: int | None, *order: Column) -> DataFrame:
    """Rows with their position; with a budget the best ``budget + 1``, the extra row telling that more exist."""
    if budget is None:
        return numbered(df, "order_in_slice", *order, start=0)
    few = df.orderBy(*order).limit(budget + 1)
    return few.withColumn("order_in_slice", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def _findings(
    top: DataFrame, provider: str, kind: str, item_id: Column, ts: Column, weight: Column, summary: Column, payload
) -> DataFrame:
    return top.select(
        item_id.alias("item_id"),
        F.lit(provider).alias("provider_id"),
        F.lit(kind).alias("kind"),
        ts.cast("timestamp_ntz").alias("ts"),
        weight.cast("double").alias("weight"),
        summary.alias("summary"),
        text_map(payload).alias("payload"),
        F.col("order_in_slice").cast("int").alias("order_in_slice"),
    )


def _first_seen(x: Inputs) -> Slice:
    new = correlate.first_seen(x.events, x.window, x.scope, x.signature_keys)
    top = _top(new, x.budget, F.col("event_count").desc(), x.signature_label)
    top = correlate.with_sample_bodies(top, x.events, x.window, x.scope)
    summary = F.concat(
        F.lit("first seen · "),
        F.col("source_count"),
        F.lit(" sources · "),
        F.col("event_count"),
        F.lit(" events · "),
        ellipsis(F.col("sample_body")),
    )
    payload = {
        "signature_hash": unsigned_text(F.col("signature_hash")),
        "event_count": F.col("event_count"),
        "source_count": F.col("source_count"),
        "sample_body": F.col("sample_body"),
    }
    return Slice(
        _findings(
            top,
            "logs.first-seen",
            "log",
            F.concat(F.lit("first-seen:"), x.signature_label),
            F.col("first_seen_at"),
            F.col("source_count"),
            summary,
            payload,
        )
    )


def _volume(x: Inputs) -> Slice:
    high = correlate.volume_deviation(x.events, x.window, x.scope, x.min_z, x.min_count, x.signature_keys)
    top = _top(high, x.budget, F.col("z_score").desc(), x.signature_label)
    top = correlate.with_sample_bodies(top, x.events, x.window, x.scope)
    summary = F.concat(
        F.lit("volume "),
        F.col("window_count"),
        F.lit(" events, expected "),
        decimal_text(F.col("expected"), 1),
        F.lit(" (z="),
        decimal_text(F.col("z_score"), 1),
        F.lit(") · "),
        ellipsis(F.col("sample_body")),
    )
    payload = {
        "signature_hash": unsigned_text(F.col("signature_hash")),
        "window_count": F.col("window_count"),
        "baseline_count": F.col("baseline_count"),
        "expected": decimal_text(F.col("expected")),
        "z_score": decimal_text(F.col("z_score")),
    }
    return Slice(
        _findings(
            top,
            "logs.volume",
            "log",
            F.concat(F.lit("volume:"), x.signature_label),
            instant(x.window.start),
            F.col("z_score"),
            summary,
            payload,
        )
    )


def _lift(x: Inputs) -> Slice:
    shared = correlate.attribute_lift(
        x.events, x.window, x.scope, LIFT_FIELDS, x.min_lift, x.min_count, x.lift_limit
    )
    top = _top(shared, x.budget, F.col("lift").desc(), F.col("field"), F.col("value"))
    name = F.concat(F.col("field"), F.lit("="), F.col("value"))
    summary = F.concat(
        name,
        F.lit(" · lift "),
        decimal_text(F.col("lift"), 1),
        F.lit("× · "),
        F.col("window_count"),
        F.lit(" events (baseline "),
        F.col("baseline_count"),
        F.lit(")"),
    )
    payload = {
        "field": F.col("field"),
        "value": F.col("value"),
        "window_count": F.col("window_count"),
        "baseline_count": F.col("baseline_count"),
        "lift": decimal_text(F.col("lift")),
    }
    return Slice(
        _findings(
            top,
            "logs.attribute-lift",
            "log",
            F.concat(F.lit("lift:"), name),
            instant(x.window.start),
            F.col("lift"),
            summary,
            payload,
        )
    )


def _propagation(x: Inputs) -> Slice:
    onsets = correlate.propagation(x.events, x.window, x.scope, x.severity_mode, x.severity)
    top = _top(onsets, x.budget, F.col("first_degraded_at"), F.col("source_id"), F.col("owner_group"))
    top = top.crossJoin(top.agg(F.min("first_degraded_at").alias("earliest")))  # one row
    top = top.withColumn("lag_seconds", scores.seconds_between(F.col("first_degraded_at"), F.col("earliest")))
    warning = F.when(
        F.col("unreliable_time_count") > 0,
        F.concat(F.lit(" · "), F.col("unreliable_time_count"), F.lit(" events with unreliable time")),
    ).otherwise("")
    summary = F.concat(
        F.col("source_id"),
        F.lit(" · first degraded +"),
        decimal_text(F.col("lag_seconds"), 0),
        F.lit("s · "),
        F.col("degraded_count"),
        F.lit(" events"),
        warning,
    )
    payload = {
        "owner_group": F.col("owner_group"),
        "source_id": F.col("source_id"),
        "lag_seconds": decimal_text(F.col("lag_seconds")),
        "degraded_count": F.col("degraded_count"),
        "unreliable_time_count": F.col("unreliable_time_count"),
    }
    return Slice(
        _findings(
            top,
            "logs.propagation",
            "log",
            F.concat(F.lit("propagation:"), F.col("source_id")),
            F.col("first_degraded_at"),
            1.0 / (1.0 + F.col("lag_seconds")),
            summary,
            payload,
        )
    )


def _silence(x: Inputs) -> Slice:
    silent = correlate.silent_sources(x.events, x.window, x.scope, x.min_expected)
    top = _top(silent, x.budget, F.col("expected").desc(), F.col("source_id"), F.col("owner_group"))
    summary = F.concat(
        F.col("source_id"),
        F.lit(" fell silent · about "),
        decimal_text(F.col("expected"), 1),
        F.lit(" events expected · last heard "),
        F.date_format("last_ingested_at", "yyyy-MM-dd HH:mm"),
    )
    payload = {
        "owner_group": F.col("owner_group"),
        "source_id": F.col("source_id"),
        "baseline_count": F.col("event_count"),
        "expected_in_window": decimal_text(F.col("expected")),
        "last_ingested_at": utc_text(F.col("last_ingested_at")),
    }
    return Slice(
        _findings(
            top,
            "logs.silence",
            "log",
            F.concat(F.lit("silence:"), F.col("source_id")),
            F.col("last_ingested_at"),
            F.col("expected"),
            summary,
            payload,
        )
    )


def _changes(x: Inputs) -> Slice:
    query = ChangeQuery(x.window.start - CHANGE_LEAD, x.window.end, x.window.owner_groups)
    visible = x.changes.filter(change_criteria(query) & in_scope(x.scope, query.owner_groups))
    top = _top(visible, x.budget, F.col("ts").desc(), F.col("change_id").desc())
    proximity = scores.change_proximity(F.col("ts"), instant(x.window.start), int(CHANGE_LEAD.total_seconds()))

    def suffix(prefix: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(prefix), F.col(column))).otherwise("")

    summary = F.concat(
        F.col("change_kind"), F.lit(" · "), F.col("target_id"), suffix(" · by ", "actor"), suffix(" — ", "summary")
    )
    payload = {
        name: F.col(name)
        for name in ("owner_group", "target_kind", "target_id", "change_kind", "actor", "source", "external_ref")
    }
    now = x.now or x.window.end
    ever = (
        x.changes.filter(
            (F.col("ts") >= instant(now - EVER_PROBE)) & (F.col("ts") < instant(now)) & in_scope(x.scope, query.owner_groups)
        )
        .limit(1)
        .agg((F.count(F.lit(1)) > 0).alias("fed"))
    )
    hidden = x.changes.filter(change_criteria(query) & out_of_scope(x.scope)).agg(F.count(F.lit(1)).alias("n"))
    return Slice(
        _findings(
            top, "change.feed", "change", F.col("change_id"), F.col("ts"), proximity, summary, payload
        ),
        hidden,
        ever,
    )


def _parse_problems(x: Inputs) -> Slice:
    query = EventQuery(x.window.start, x.window.end)
    problems = correlate.window_rows(x.events, x.window, x.scope).filter(
        F.col("parse_status").isin("failed", "partial")
    )
    top = _top(problems, x.budget, F.col("ts"), F.col("event_id"))
    summary = F.concat(
        F.col("source_id"), F.lit(" · "), F.col("parse_status"), F.lit(" · "), ellipsis(F.col("body"))
    )
    payload = {
        name: F.col(name) for name in ("owner_group", "source_id", "host", "parser_id", "parse_status", "time_source")
    }
    payload["signature_hash"] = unsigned_text(F.col("signature_hash"))
    hidden = count_events_out_of_scope(x.events, query, x.scope)
    return Slice(
        _findings(
            top,
            "logs.window",
            "log",
            F.col("event_id"),
            F.col("ts"),
            F.when(F.col("parse_status") == "failed", 1.0).otherwise(0.5),
            summary,
            payload,
        ),
        hidden,
    )


PROVIDERS: tuple[Provider, ...] = (
    Provider("change.feed", "change", _changes),
    Provider("logs.first-seen", "log", _first_seen),
    Provider("logs.propagation", "log", _propagation),
    Provider("logs.silence", "log", _silence),
    Provider("logs.volume", "log", _volume),
    Provider("logs.attribute-lift", "log", _lift),
    Provider("logs.window", "log", _parse_problems),
)


def _status_rows(x: Inputs, provider: Provider, part: Slice) -> DataFrame:
    counted = part.findings.agg(F.count(F.lit(1)).alias("found"))
    hidden = part.out_of_scope.scalar() if part.out_of_scope is not None else F.lit(0)
    fed = part.fed.scalar() if part.fed is not None else F.lit(True)
    return counted.select(
        F.lit(provider.id).alias("provider_id"),
        F.lit(provider.kind).alias("kind"),
        F.when(F.col("found") > 0, "gathered").when(fed, "empty").otherwise("never_fed").alias("status"),
        F.lit("").alias("detail"),
        F.coalesce(hidden, F.lit(0)).cast("bigint").alias("out_of_scope_count"),
        (F.col("found") > x.budget if x.budget is not None else F.lit(False)).alias("truncated"),
        (F.least(F.col("found"), F.lit(x.budget)) if x.budget is not None else F.col("found")).cast("bigint").alias("items"),
    )


_NO_SLICE = "provider_id STRING, kind STRING, status STRING, detail STRING, out_of_scope_count BIGINT, truncated BOOLEAN, items BIGINT"


def gather(x: Inputs, providers: Sequence[Provider] = PROVIDERS, materialize: bool = False) -> Report:
    """Run every provider; one that fails becomes a ``failed`` slice and stops nobody else.

    Lazily, only failures while building a plan can be caught. With ``materialize`` each provider's
    (bounded) findings are checkpointed on their own, which also isolates failures at run time.
    """
    spark = x.events.sparkSession
    findings: list[DataFrame] = []
    slices: list[DataFrame] = []
    static: list[tuple] = []
    failures: dict[str, str] = {}
    for provider in providers:
        if not provider.available:
            static.append((provider.id, provider.kind, "unavailable", "provider is not available", 0, False, 0))
            continue
        try:
            part = provider.gather(x)
            if materialize:
                part = Slice(cut_lineage(part.findings), part.out_of_scope, part.fed)
            status = _status_rows(x, provider, part)
            if materialize:
                status = cut_lineage(status)
        except Exception as error:  # noqa: BLE001 - one bad provider must not hide the others
            failures[provider.id] = str(error)
            static.append((provider.id, provider.kind, "failed", str(error), 0, False, 0))
            continue
        findings.append(part.findings if x.budget is None else part.findings.filter(F.col("order_in_slice") < x.budget))
        slices.append(status)
    covered = {p.kind for p in providers}
    for kind in EVIDENCE_KINDS:
        if kind not in covered:
            static.append((f"({kind})", kind, "not_registered", "no provider for this kind", 0, False, 0))
    if static:
        slices.append(spark.createDataFrame(static, _NO_SLICE))
    if not findings:
        findings.append(spark.createDataFrame([], _EMPTY_FINDINGS))
    return Report(_union(findings), _union(slices), failures)


_EMPTY_FINDINGS = (
    "item_id STRING, provider_id STRING, kind STRING, ts TIMESTAMP_NTZ, weight DOUBLE, summary STRING, "
    "payload MAP<STRING,STRING>, order_in_slice INT"
)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame)
    return total


def class_rank(provider: Column) -> Column:
    rank = F.lit(UNRANKED)
    for name, value in CLASS_RANKS.items():
        rank = F.when(provider == name, value).otherwise(rank)
    return rank


def rank(findings: DataFrame) -> DataFrame:
    """Score = class rank + weight relative to the slice's heaviest item; position 1 is the best."""
    heaviest = findings.groupBy(F.col("provider_id").alias("provider_")).agg(F.max("weight").alias("slice_max"))
    scored = findings.join(F.broadcast(heaviest), F.col("provider_id").eqNullSafe(F.col("provider_"))).drop("provider_").withColumn(
        "score",
        class_rank(F.col("provider_id"))
        + F.when(F.col("slice_max") > 0, F.col("weight") / F.col("slice_max")).otherwise(0.0),
    )
    return numbered(scored.drop("slice_max"), "position", F.col("score").desc(), F.col("order_in_slice"), F.col("item_id"))


def timeline(ranked: DataFrame) -> DataFrame:
    """The same findings in time order, better scores first within an instant."""
    return numbered(ranked.drop("position"), "position", F.col("ts"), F.col("score").desc(), F.col("item_id"))


def report_flags(slices: DataFrame) -> DataFrame:
    """Out-of-scope total, whether anything is missing, and how many slices were not consulted."""
    incomplete = F.col("status").isin("failed", "unavailable") | F.col("truncated")
    return slices.agg(
        F.sum("out_of_scope_count").alias("out_of_scope_count"),
        F.coalesce(F.bool_or(incomplete), F.lit(False)).alias("is_partial"),
        F.count(F.when(~F.col("status").isin("gathered", "empty"), 1)).alias("not_consulted"),
    )


def content_hash(
    findings: DataFrame,
    slices: DataFrame,
    trust: DataFrame,
    window: CorrelationWindow,
    scope: AccessScope,
    schema_version: int = 1,
) -> DataFrame:
    """SHA-256 over the canonical text of a bundle: equal inputs give equal hashes.

    Aggregates bounded findings only: items keep slice order, slices and payload keys are sorted.
    """
    entries = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("payload")),
            lambda e: F.concat(F.lit("  "), e["key"], F.lit("="), e["value"], F.lit("\n")),
        ),
        "",
    )
    item_text = F.concat(
        F.lit("- "),
        F.concat_ws("|", "item_id", utc_text(F.col("ts")), F.col("weight").cast("string"), "summary"),
        F.lit("\n"),
        entries,
    )
    items = (
        findings.select("provider_id", F.struct("order_in_slice", item_text.alias("text")).alias("entry"))
        .groupBy("provider_id")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select("provider_id", F.array_join(F.transform("entries", lambda e: e["text"]), "").alias("items_text"))
    )
    slice_text = F.concat(
        F.lit("# "),
        F.concat_ws(
            "|",
            "provider_id",
            "kind",
            "status",
            F.col("out_of_scope_count").cast("string"),
            F.col("truncated").cast("string"),
            "detail",
        ),
        F.lit("\n"),
        F.coalesce("items_text", F.lit("")),
    )
    body = (
        slices.join(items, "provider_id", "left")
        .select(F.struct("provider_id", slice_text.alias("text")).alias("entry"))
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select(F.array_join(F.transform("entries", lambda e: e["text"]), "").alias("body"))
    )
    head = "\n".join(
        [
            f"v{schema_version}",
            f"{window.start.isoformat()}|{window.end.isoformat()}",
            f"{window.baseline_start.isoformat()}|{window.baseline_end.isoformat()}",
            "groups:" + ",".join(sorted(scope.owner_groups)),
            f"system:{scope.unrestricted}",
            "narrow:" + ",".join(sorted(window.owner_groups)),
            "sources:" + ",".join(sorted(window.source_ids)),
            "",
        ]
    )
    trusted = trust.select(F.concat_ws("|", F.lit("trust:true"), "total_events", "unreliable_events")).scalar()
    return body.select(
        F.sha2(F.concat(F.lit(head), trusted, F.lit("\n"), F.col("body")).cast("binary"), 256).alias("content_hash")
    )


def drilldown_events(events: DataFrame, findings: DataFrame, window: CorrelationWindow, scope: AccessScope) -> DataFrame:
    """Events of the window that carry a signature some finding points at."""
    wanted = findings.select(F.col("payload")["signature_hash"].alias("label")).filter(F.col("label").isNotNull())
    number = F.col("label").cast("decimal(20,0)")
    half, whole = (F.lit(str(v)).cast("decimal(20,0)") for v in (2**63, 2**64))
    signed = F.when(number >= half, (number - whole).cast("decimal(20,0)")).otherwise(number).cast("bigint")
    keys = wanted.select(signed.alias("signature_hash")).distinct()
    return correlate.window_rows(events, window, scope).join(keys, "signature_hash", "left_semi")
