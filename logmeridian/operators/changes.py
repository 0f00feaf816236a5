"""Change events from the payloads of build servers, and configuration texts made comparable."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from logmeridian.functions.exprs import let, nonblank, text_map

# States, paths and summary texts of the payloads, and the range of plausible epoch milliseconds.
EPOCH_MILLIS = (946_684_800_000, 4_102_444_800_000)


@dataclass(frozen=True)
class PayloadRule:
    """How one kind of payload becomes a change.

    Strings that begin with ``$.`` are paths into the payload, others are literal. Of several targets,
    actors or references the first that is not empty counts. ``derived`` is the delivery id where the
    request named none, or always if ``always_derived``.
    """

    provider: str
    target: Sequence[str]
    kind_path: str = ""
    kind: str = ""
    state: str = ""
    final: Sequence[str] = ()
    pending: Sequence[str] = ()
    actor: Sequence[str] = ()
    summary: Sequence[str] = ()
    at: str = ""
    reference: Sequence[str] = ()
    details: Mapping[str, str] = field(default_factory=dict)
    change_kind: str = ""
    derived: Sequence[str] = ()
    ignored_delivery: Sequence[str] = ()
    always_derived: bool = False


_RUN, _DEPLOY, _ATTR = "$.workflow_run.", "$.deployment_status.", "$.object_attributes."
RULES = (
    PayloadRule(
        "github", ("$.repository.full_name",), kind="workflow_run", state="$.action", final=("completed",), actor=(_RUN + "actor.login", "$.sender.login"),
        summary=(_RUN + "name", " #", _RUN + "run_number", " → ", _RUN + "conclusion"), at=_RUN + "updated_at", reference=(_RUN + "html_url",),
        details={"event": "workflow_run", "conclusion": _RUN + "conclusion", "workflow": _RUN + "name", "run_id": _RUN + "id", "head_branch": _RUN + "head_branch", "head_sha": _RUN + "head_sha"},
    ),
    PayloadRule(
        "github", ("$.repository.full_name",), kind="deployment_status", state=_DEPLOY + "state", pending=("pending", "queued", "in_progress", ""),
        actor=(_DEPLOY + "creator.login", "$.sender.login"), summary=(_DEPLOY + "environment", " dağıtımı → ", _DEPLOY + "state"), at=_DEPLOY + "updated_at",
        reference=(_DEPLOY + "target_url", "$.deployment.url"),
        details={"event": "deployment_status", "state": _DEPLOY + "state", "environment": _DEPLOY + "environment", "ref": "$.deployment.ref", "sha": "$.deployment.sha"},
    ),
    PayloadRule(
        "github", ("$.repository.full_name",), kind="push", state="$.head_commit.id", pending=("",), actor=("$.pusher.name", "$.sender.login"),
        summary=("$.head_commit.message",), at="$.head_commit.timestamp", reference=("$.compare", "$.head_commit.url"),
        details={"event": "push", "ref": "$.ref", "before": "$.before", "after": "$.after"}, change_kind="config_push",
    ),
    PayloadRule(
        "jenkins", ("$.build.parameters.TARGET", "$.name"), state="$.build.phase", final=("COMPLETED", "FINALIZED"), actor=("$.build.parameters.BUILD_USER_ID",),
        summary=("$.name", " #", "$.build.number", " → ", "$.build.status"), at="$.build.timestamp", reference=("$.build.full_url",),
        details={"status": "$.build.status", "phase": "$.build.phase", "job": "$.name", "build": "$.build.number", "branch": "$.build.scm.branch", "commit": "$.build.scm.commit"},
        derived=("$.name", "#", "$.build.number", ":", "$.build.status"), ignored_delivery=("$.name", "#", "$.build.number"), always_derived=True,
    ),
    PayloadRule(
        "gitlab", ("$.project.path_with_namespace",), kind_path="$.object_kind", kind="pipeline", state=_ATTR + "status", final=("success", "failed"), actor=("$.user.username",),
        summary=("Pipeline #", _ATTR + "id", " (", _ATTR + "ref", ") → ", _ATTR + "status"), at=_ATTR + "finished_at", reference=(_ATTR + "url", "$.project.web_url"),
        details={"object_kind": "pipeline", "status": _ATTR + "status", "ref": _ATTR + "ref", "sha": _ATTR + "sha", "pipeline_id": _ATTR + "id"},
        derived=("pipeline:", _ATTR + "id", ":", _ATTR + "status"),
    ),
    PayloadRule(
        "gitlab", ("$.project.path_with_namespace",), kind_path="$.object_kind", kind="deployment", state="$.status", final=("success", "failed"), actor=("$.user.username",),
        summary=("$.environment", " dağıtımı → ", "$.status"), at="$.status_changed_at", reference=("$.deployable_url", "$.project.web_url"),
        details={"object_kind": "deployment", "status": "$.status", "environment": "$.environment", "ref": "$.ref", "commit_url": "$.commit_url"},
        derived=("deployment:", "$.deployment_id", ":", "$.status"),
    ),
)


def payload_time(text: Column) -> Column:
    """An instant from epoch milliseconds in a plausible range, or from ISO text with or without `` UTC``; else NULL."""

    def read(value: Column) -> Column:
        millis = value.try_cast("bigint")
        iso = F.regexp_replace(value, " UTC$", "").try_cast("timestamp").cast("timestamp_ntz")
        inside = (millis > EPOCH_MILLIS[0]) & (millis < EPOCH_MILLIS[1])
        return F.when(value.rlike("^[0-9]+$"), F.when(inside, F.timestamp_millis(millis).cast("timestamp_ntz"))).otherwise(iso)

    return let(F.trim(text), read)


def _schema(paths: Sequence[str]) -> str:
    """One nested schema of text leaves for all paths, so that a payload is parsed once."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.removeprefix("$.").split("."):
            node = node.setdefault(part, {})
    ddl = lambda node: "STRUCT<" + ", ".join(f"`{k}`: {ddl(v) if v else 'STRING'}" for k, v in sorted(node.items())) + ">"
    return ddl(tree)


def map_changes(payloads: DataFrame, rules: Sequence[PayloadRule] = RULES) -> DataFrame:
    """``payloads`` without ``body``, with ``outcome``, ``reason``, ``delivery_id`` and the columns of a change added.

    Needs ``provider, event, delivery, body, default_kind, received_at``. Bodies that are no JSON object,
    and changes without a target, are ``invalid``; unknown kinds and states that are not final are
    ``ignored``; the others are ``mapped``. Columns of a change are NULL unless mapped. The time falls
    back to ``received_at``.
    """
    named = [
        x for r in rules for x in (*r.target, r.kind_path, r.state, *r.actor, *r.summary, r.at, *r.reference, *r.details.values(), *r.derived, *r.ignored_delivery) if x.startswith("$.")
    ]
    event = F.trim(F.coalesce("event", F.lit("")))
    given = F.trim(F.coalesce("delivery", F.lit("")))

    def value(text: str) -> Column:
        return F.coalesce(F.col(f"json_.{text[2:]}"), F.lit("")) if text.startswith("$.") else F.lit(text)

    def first(options: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(value(x), F.lit("")) for x in options], F.lit("")) if options else F.lit("")

    def joined(parts: Sequence[str]) -> Column:
        return F.concat(*[value(x) for x in parts]) if parts else F.lit("")

    def result(rule: PayloadRule) -> Column:
        state = value(rule.state)
        final = state.isin(*rule.final) if rule.final else ~state.isin(*rule.pending)
        derived = joined(rule.derived)
        delivery = derived if rule.always_derived else F.coalesce(F.nullif(given, F.lit("")), derived)
        target = first(rule.target)
        mapped = final & (F.trim(target) != "")
        kind = F.lit(rule.change_kind) if rule.change_kind else F.col("default_kind")
        return F.struct(
            F.when(~final, "ignored").when(mapped, "mapped").otherwise("invalid").alias("outcome"),
            F.when(~final, F.concat(F.lit("not final: "), state)).when(mapped, "").otherwise("no target").alias("reason"),
            F.when(~final, joined(rule.ignored_delivery) if rule.ignored_delivery else given).when(mapped, delivery).otherwise("").alias("delivery_id"),
            F.when(mapped, F.coalesce(payload_time(value(rule.at)), F.col("received_at"))).alias("ts"),
            F.when(mapped, target).alias("target_id"),
            F.when(mapped, kind).alias("change_kind"),
            F.when(mapped, first(rule.actor)).alias("actor"),
            F.when(mapped, F.regexp_extract(joined(rule.summary), r"^[^\r\n]*", 0)).alias("summary"),
            F.when(mapped, F.map_filter(text_map({k: value(v) for k, v in rule.details.items()}), lambda _, v: v != "")).alias("details"),
            F.when(mapped, first(rule.reference)).alias("external_ref"),
        )

    def refused(outcome: str, reason: str, delivery: Column) -> Column:
        return F.struct(
            F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"), delivery.alias("delivery_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            *[F.lit(None).cast("string").alias(c) for c in ("target_id", "change_kind", "actor", "summary")], F.lit(None).cast("map<string,string>").alias("details"),
            F.lit(None).cast("string").alias("external_ref"),
        )

    def applies(rule: PayloadRule) -> Column:
        kind = value(rule.kind_path) if rule.kind_path else event
        return (F.col("provider") == rule.provider) & ((kind == rule.kind) if rule.kind else F.lit(True))

    parsed = payloads.withColumn("valid_", F.json_object_keys("body").isNotNull()).withColumn("json_", F.from_json("body", _schema(named)))
    chosen = F.when(~F.col("valid_"), refused("invalid", "not a JSON object", F.lit("")))
    chosen = reduce(lambda whens, rule: whens.when(applies(rule), result(rule)), rules, chosen).otherwise(refused("ignored", "unknown kind", given))
    return parsed.withColumn("change_", chosen).select(*[F.col(c) for c in payloads.columns if c != "body"], "change_.*")


def first_deliveries(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``. Rows whose key holds a NULL or an empty text all stay."""
    known = F.coalesce(reduce(lambda a, b: a & b, [nonblank(F.col(k).cast("string")).isNotNull() for k in key]), F.lit(False))
    row = F.min_by(F.struct(*changes.columns), F.struct(*order)).alias("row_")
    once = changes.where(known).groupBy(*[F.col(k).alias(f"key_{k}") for k in key]).agg(row)
    return once.select("row_.*").unionByName(changes.where(~known))


# Words that announce a secret, lines that differ on every export, and section headers.
SECRET = (
    r"(?i)^(\s*(?:[\w./-]+[\s=]+)?(?:password|passwd|psksecret|secret|pre-shared-key|wpa2-pre-shared-key|snmp-community|community|auth-key|key-string)"
    r"[\s=]+(?:ENC[\s=]+|encrypted[\s=]+|[78][\s=]+)?)(\S.*)$"
)
NOISE = {
    "fortinet.fortigate": (r"^#conf_file_ver=", r"^#buildno=", r"^#global_vdom="),
    "cisco.asa": (
        r"^:\s*Written by ", r"^:\s*Saved", r"^Cryptochecksum:", r"^ntp clock-period ", r"^:\s*(Hardware|Serial Number|Device Manager Version):",
    ),
    "mikrotik.routeros": (
        r"^#\s+\w{3}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}\s+by\s+RouterOS", r"^#\s+software id\s*=", r"^#\s+(model|serial number)\s*=",
    ),
}
ROOT_SECTION = "(kök)"


def masked_secret(line: Column) -> Column:
    """A line whose secret is replaced by eight digits of its digest: a rotation shows, the value does not."""

    def mask(text: Column) -> Column:
        secret = F.btrim(F.trim(F.regexp_extract(text, SECRET, 2)), F.lit('"'))
        hidden = F.concat(F.regexp_extract(text, SECRET, 1), F.lit("<gizli:"), F.substring(F.sha2(secret, 256), 1, 8), F.lit(">"))
        return F.when(text.rlike(SECRET), hidden).otherwise(text)

    return let(line, mask)


@F.pandas_udf(ArrayType(StringType()))
def _stacked_sections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per line the names of the open blocks, joined; NULL outside of all."""
    import re

    opened, entry = re.compile(r"config\s+(.+?)\s*$"), re.compile(r"\s*edit\s+(.+?)\s*$")

    def sections(text: str | None) -> list[str | None] | None:
        if text is None:
            return None
        blocks: list[str] = []
        now, out = None, []
        for line in text.split("\n"):
            if m := opened.match(line):
                blocks.append(m[1])
                now = " / ".join(blocks)
            elif blocks and (m := entry.match(line)):
                now = " / ".join([*blocks, m[1].strip('"')])
            elif blocks and line.strip() == "end":
                blocks.pop()
                now = " / ".join(blocks) or None
            out.append(now)
        return out

    for batch in texts:
        yield batch.map(sections)


def config_lines(snapshots: DataFrame) -> DataFrame:
    """``id, line_no, section, line`` of snapshots ``(id, vendor, text)``: secrets masked, noise and empty lines gone.

    ``vendor`` is a key of :data:`NOISE`; other vendors lose only bare comment marks and have one section.
    Sections are read before noise goes. Line numbers are those of the text, from 0.
    """
    stacked = _stacked_sections(F.when(F.col("vendor") == "fortinet.fortigate", F.col("text")))
    split = snapshots.withColumn("blocks_", stacked).select("id", "vendor", "blocks_", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = split.select("id", "vendor", "line_no", F.rtrim("raw", F.lit("\r \t")).alias("raw"), F.get("blocks_", F.col("line_no")).alias("block")).where("raw <> ''")
    lines = lines.withColumn("line", masked_secret(F.btrim("raw", F.lit(" \t\r"))))
    vendor = F.col("vendor")
    header = (
        F.when(vendor == "mikrotik.routeros", F.nullif(F.regexp_extract("raw", r"^/(\S.*?)\s*$", 1), F.lit("")))
        .when((vendor == "cisco.asa") & ~F.col("raw").rlike(r"^[ \t]"), F.col("line"))
    )
    above = F.last(header, ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    section = F.coalesce(F.when(vendor == "fortinet.fortigate", F.col("block")).otherwise(above), F.lit(ROOT_SECTION))
    noisy = reduce(lambda a, b: a | b, [(vendor == v) & F.col("raw").rlike("|".join(f"(?:{p})" for p in patterns)) for v, patterns in NOISE.items()])
    bare = F.ltrim("raw").isin("#", "!", ":")
    return lines.withColumn("section", section).where(~(F.coalesce(noisy, F.lit(False)) | bare)).select("id", "line_no", "section", "line")


def retained(snapshots: DataFrame, cutoff: Column, group: str = "connector", order: Sequence[str] = ("taken_at", "id")) -> DataFrame:
    """Snapshots of ``cutoff`` or later, and the newest of each group whatever its age."""
    newest = snapshots.groupBy(group).agg(F.max(F.struct(*order)).alias("newest_")).withColumnRenamed(group, "group_")
    marked = snapshots.join(newest, F.col(group).eqNullSafe(F.col("group_")), "left")
    return marked.where((F.col(order[0]) >= cutoff) | (F.struct(*order) == F.col("newest_"))).select(*snapshots.columns)
