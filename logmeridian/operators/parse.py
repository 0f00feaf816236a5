"""Parsing of log messages: parser definitions, dispatch, normalising, source resolution."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.addresses import mapped_text
from logmeridian.functions.exprs import let, literal_map, nonblank
from logmeridian.functions.steps import AT, Step, fields_of, merged, parse_state

UNASSIGNED = "_unassigned"
UNKNOWN = "_unknown"


@dataclass(frozen=True)
class Lookup:
    """The mapped value of a field; without an entry the default, or nothing."""

    field: str
    table: Mapping[str, str]
    default: str | None = None


@dataclass(frozen=True)
class Parser:
    """Steps, the literals one of which a message must hold, and output columns as templates or lookups."""

    id: str
    steps: Sequence[Step]
    contains: Sequence[str] = ()
    specificity: int = 0
    core: Mapping[str, str | Lookup] = field(default_factory=dict)
    ocsf: Mapping[str, str | Lookup] = field(default_factory=dict)
    otel: Mapping[str, str | Lookup] = field(default_factory=dict)


#: How a message found its parser.
FORCED, BOUND, CANDIDATE, UNMATCHED = "forced", "bound", "candidate", "unmatched"
MAPS = ("core", "ocsf", "otel")


def rendered(value: str | Lookup, fields: Column) -> Column:
    """A template's text; NULL when a field it names is missing."""
    if isinstance(value, Lookup):
        key = F.try_element_at(fields, F.lit(value.field))
        return F.coalesce(F.try_element_at(literal_map(value.table), key), F.when(key.isNotNull(), F.lit(value.default)))
    parts = [F.lit(p) if i % 2 == 0 else F.try_element_at(fields, F.lit(p)) for i, p in enumerate(re.split(r"\{\{\s*([\w.@]+)\s*\}\}", value)) if p]
    return F.concat(*parts) if parts else F.lit("")


def parse_events(df: DataFrame, parsers: Sequence[Parser], body: str = "body", bound: str | None = None, forced: str | None = None) -> DataFrame:
    """``df`` with ``parser_id``, ``parse_status``, ``tags``, ``fields``, ``core``, ``ocsf``, ``otel``, ``tier``, ``attempts`` and ``parsed_at`` added.

    The parser named in the column ``bound`` takes a message that it does not fail on (tier ``bound``). Else parsers go in the order of
    specificity (highest first), then id, those that have a literal only on messages that hold one of theirs; the first whose result
    is ok wins, else the first partial one (``candidate``). A message no parser takes is ``unmatched``, failed, with an empty
    id and empty maps. ``attempts`` counts the parsers tried for the result: one for a bound one, candidates up to the first
    that is ok, else all. With ``forced`` only that parser is tried, whatever the message holds; naming none of ``parsers`` is an error.
    """
    ordered = sorted(parsers, key=lambda p: (-p.specificity, p.id))
    if forced is not None:
        ordered = [p for p in ordered if p.id == forced]
        if not ordered:
            raise ValueError(f"no parser is named {forced!r}")
    tied = F.col(bound) if bound and forced is None else F.lit(None).cast("string")

    def attempt(parser: Parser, text: Column) -> Column:
        could = F.lit(True) if forced is not None or not parser.contains else reduce(or_, [text.contains(x) for x in parser.contains])
        could, own = F.coalesce(could, F.lit(False)), F.coalesce(tied == parser.id, F.lit(False))

        def result(state: Column) -> Column:
            maps = [fields_of({name: rendered(value, state["fields"]) for name, value in getattr(parser, m).items()}).alias(m) for m in MAPS]
            return F.struct(
                F.lit(parser.id).alias("parser_id"), state["status"].alias("parse_status"), state["tags"].alias("tags"), F.map_filter(state["fields"], lambda k, _: k != "message").alias("fields"), *maps,
                could.alias("could"), own.alias("own"),
            )

        return F.when(could | own, let(parse_state(text, parser.steps), result))

    none = F.struct(
        F.lit("").alias("parser_id"), F.lit("failed").alias("parse_status"), F.array().cast("array<string>").alias("tags"), fields_of({}).alias("fields"), *[fields_of({}).alias(m) for m in MAPS],
        F.lit(False).alias("could"), F.lit(False).alias("own"),
    )

    def choose(tries: Column) -> Column:
        candidates = lambda: F.filter(tries, lambda t: t["could"])
        first = lambda rows, fits: F.get(F.filter(rows, fits), F.lit(0))
        mine = first(tries, lambda t: t["own"] & (t["parse_status"] != "failed"))
        whole = first(tries, lambda t: t["could"] & (t["parse_status"] == "ok"))
        part = first(tries, lambda t: t["could"] & (t["parse_status"] == "partial"))
        best = F.coalesce(mine, whole, part, none)
        until = F.array_position(F.transform(candidates(), lambda t: t["parse_status"]), "ok")
        tier = F.lit(FORCED) if forced is not None else F.when(mine.isNotNull(), BOUND).when(whole.isNotNull() | part.isNotNull(), CANDIDATE).otherwise(UNMATCHED)
        attempts = F.when(mine.isNotNull(), F.lit(1)).when(until > 0, until.cast("int")).otherwise(F.size(candidates()))
        return F.struct(best.alias("best"), tier.alias("tier"), attempts.alias("attempts"))

    found = let(F.col(body), lambda text: let(F.array_compact(F.array(*[attempt(p, text) for p in ordered])), choose))
    parsed = df.withColumn("parsed_", found)
    best = F.col("parsed_.best")
    at = F.try_element_at(best["fields"], F.lit(AT)).try_cast("timestamp_ntz")
    names = ("parser_id", "parse_status", "tags", "fields", *MAPS)
    return parsed.select(*df.columns, *[best[n].alias(n) for n in names], "parsed_.tier", "parsed_.attempts", at.alias("parsed_at"))


def mapped_address(text: Column) -> Column:
    """An address in one spelling, IPv4 in its IPv6-mapped form; NULL for anything else."""
    return mapped_text(text)


def clamped(text: Column, most: int) -> Column:
    """A whole number between 0 and ``most``; text that is no number counts as 0."""
    return F.greatest(F.least(F.coalesce(text.try_cast("decimal(38,0)"), F.lit(0)), F.lit(most)), F.lit(0)).cast("bigint")


def normalize(parsed: DataFrame, observed: str, received: str, source_key: str) -> DataFrame:
    """Canonical columns of parsed events, added to the given ones.

    The time is that of the message, else when it was observed, else when it was received, and
    ``time_source`` says which. The host falls back to the source key. ``attributes`` holds the parser's fields, its ``ocsf.`` and
    ``otel.`` values, how the message found its parser, its tags, and the source key where ``is_known`` says that no source has it.
    """
    nonempty = lambda m: F.map_filter(m, lambda _, v: v != "")
    prefixed = lambda m: nonempty(F.transform_keys(m, lambda k, _: F.concat(F.lit(f"{m}."), k)))
    stranger = F.when(~F.col("is_known"), F.col(source_key)) if "is_known" in parsed.columns else F.lit(None).cast("string")
    engine = fields_of({"logmeridian.dispatch_tier": F.col("tier"), "logmeridian.tags": F.array_join("tags", ","), "logmeridian.unassigned_source_key": stranger})
    core = lambda name: F.try_element_at(F.col("core"), F.lit(name))
    at, seen = F.col("parsed_at"), F.col(observed)
    return parsed.withColumns({
        "event_ts": F.coalesce(at, seen, F.col(received)),
        "time_source": F.when(at.isNotNull(), "parsed").when(seen.isNotNull(), "observed").otherwise("received"),
        "event_host": F.coalesce(nonblank(core("host")), F.col(source_key)),
        "src_address": mapped_address(core("src_ip")),
        "dst_port_number": clamped(core("dst_port"), 65535),
        "attributes": reduce(merged, [nonempty("fields"), prefixed("ocsf"), prefixed("otel"), engine]),
    })


def resolve_sources(df: DataFrame, inventory: DataFrame, key: str = "source_key") -> DataFrame:
    """``df`` with ``resolved_source``, ``resolved_group`` and ``is_known`` from the inventory.

    A key matches a peer address, a host name or a source id in any case; without a match its last
    ``:port`` is cut off and it is tried again. Unknown keys stay as they are, in the group of the
    unassigned; blank ones are ``_unknown``. Where sources share a key the smallest id counts.
    """
    keys = (
        inventory.select("source_id", "owner_group", F.explode(F.array("peer_address", "hostname", "source_id")).alias("k")).where(F.trim("k") != "")
        .groupBy(F.lower("k").alias("k")).agg(F.min(F.struct("source_id", "owner_group")).alias("s"))
    )
    side = lambda n: keys.select(F.col("k").alias(f"k{n}_"), F.col("s").alias(f"s{n}_"))
    lower = F.lower(F.col(key))
    bare = F.when(lower.rlike("^.+:[^:]*$"), F.regexp_replace(lower, ":[^:]*$", ""))
    joined = df.join(side(1), lower == F.col("k1_"), "left").join(side(2), bare == F.col("k2_"), "left")
    found = F.coalesce("s1_", "s2_")
    return joined.select(
        *[joined[c] for c in df.columns],
        F.coalesce(found["source_id"], nonblank(F.col(key)), F.lit(UNKNOWN)).alias("resolved_source"),
        F.coalesce(found["owner_group"], F.lit(UNASSIGNED)).alias("resolved_group"),
        found.isNotNull().alias("is_known"),
    )
