"""Parser steps as column expressions.

The state of a parse is one struct: ``fields`` (a text map), ``status`` and ``tags``. Every step reads
its predecessor's state once (:func:`let`), so a parser of many steps stays a linear expression.
A step's :meth:`read` gives the fields it found, or NULL when it failed; ``on_failure`` decides what
follows: ``fail`` ends the parse, ``continue`` and ``tag`` make it partial, the latter with a tag.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmeridian.functions.exprs import TEXT_MAP, let
from logmeridian.functions.grok_library import PATTERNS, field_name, rewritten

TYPES = {"int": "int", "long": "bigint", "double": "double", "float": "double", "bool": "boolean"}
ZONES = sorted(z for z in available_timezones() if re.match(r"(Africa|America|Asia|Atlantic|Australia|Europe|Indian|Pacific)/", z)) + ["UTC"]
AT = "@timestamp"
_REFERENCE = re.compile(r"%\{(\w+)(?::([\w.@\[\]-]+))?(?::(\w+))?\}")
_NAMED = re.compile(r"\(\?<(?![=!])([^>]+)>")
_CUT, _HIT = "\u0001", "\u0002"


def expand(pattern: str, definitions: Mapping[str, str]) -> tuple[str, list[tuple[int, str, str | None]]]:
    """One JVM regex for a grok pattern, and ``(group, field, type)`` of its captures in order."""
    named: list[tuple[str, str | None]] = []

    def mark(target: str, kind: str | None) -> str:
        # The JVM's group names take no underscores or dots, so groups are numbered.
        named.append((field_name(target), kind))
        return f"(?<f{len(named) - 1}>"

    def fill(text: str, open_: tuple[str, ...]) -> str:
        def one(m: re.Match) -> str:
            name, target, kind = m.groups()
            if name in open_:
                raise ValueError(f"pattern {name} refers to itself")
            if name not in definitions:
                raise ValueError(f"unknown pattern {name}")
            if target is None:
                return f"(?:{fill(definitions[name], (*open_, name))})"
            return f"{mark(target, kind)}{fill(definitions[name], (*open_, name))})"

        own = lambda part: _NAMED.sub(lambda m: mark(m[1], None), part)
        out, at = [], 0
        for m in _REFERENCE.finditer(text):  # marks are numbered in the order of the text
            out += [own(text[at : m.start()]), one(m)]
            at = m.end()
        return "".join([*out, own(text[at:])])

    regex, groups, count, i, inside = fill(rewritten(pattern), ()), [], 0, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif c in "[]":
            inside = c == "["
        elif c == "(" and not inside:
            label = re.match(r"\(\?<([A-Za-z]\w*)>", regex[i:])
            if label or regex[i + 1 : i + 2] != "?":
                count += 1
            if label:
                groups.append((count, *named[int(label[1][1:])]))
        i += 1
    return regex, groups


def typed_text(value: Column, kind: str | None) -> Column:
    """The text of the value read as ``kind``; text that cannot be read so stays as it is."""
    return value if kind not in TYPES else F.coalesce(value.try_cast(TYPES[kind]).cast("string"), value)


def fields_of(values: Mapping[str, Column]) -> Column:
    """A text map of the values that are neither NULL nor empty."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs).cast(TEXT_MAP), lambda _, v: v != "") if pairs else F.create_map().cast(TEXT_MAP)


def merged(first: Column, second: Column) -> Column:
    """Both maps; where both have a key the second's value stays."""
    return let(second, lambda b: F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(b, k)), b))


@dataclass(frozen=True, kw_only=True)
class Step:
    field: str = "message"
    on_failure: str = "fail"
    tag: str = "_failed"

    def read(self, text: Column) -> Column:
        raise NotImplementedError

    def extra_tags(self, fields: Column) -> Column:
        return F.array().cast("array<string>")

    def found(self, fields: Column) -> Column:
        return let(F.try_element_at(fields, F.lit(self.field)), self.read)

    def run(self, state: Column) -> Column:
        def then(found: Column) -> Column:
            missed = F.array(F.lit(self.tag)) if self.on_failure == "tag" else F.array().cast("array<string>")
            status = F.lit("failed") if self.on_failure == "fail" else F.lit("partial")
            good = F.struct(
                merged(state["fields"], found).alias("fields"), state["status"].alias("status"), F.array_union(state["tags"], self.extra_tags(state["fields"])).alias("tags")
            )
            bad = F.struct(state["fields"].alias("fields"), status.alias("status"), F.array_union(state["tags"], missed).alias("tags"))
            return F.when(state["status"] == "failed", state).when(found.isNull(), bad).otherwise(good)

        return let(self.found(state["fields"]), then)


@dataclass(frozen=True, kw_only=True)
class Grok(Step):
    """The first pattern that matches wins; its empty captures are skipped.

    All captures come from one run of the regex, written out between control characters; only a text
    that holds such characters itself is matched once for every capture.
    """

    patterns: Sequence[str]
    definitions: Mapping[str, str] = field(default_factory=dict)

    def read(self, text: Column) -> Column:
        return F.coalesce(*[self._match(text, *expand(p, PATTERNS | self.definitions)) for p in self.patterns])

    def _match(self, text: Column, regex: str, groups: list[tuple[int, str, str | None]]) -> Column:
        names = list(dict.fromkeys(name for _, name, _ in groups))

        def collect(at) -> Column:
            values = {n: F.coalesce(*[typed_text(F.nullif(at(i, g), F.lit("")), kind) for i, (g, name, kind) in enumerate(groups) if name == n]) for n in names}
            return fields_of(values)

        once = F.regexp_replace(text, F.lit(rf"(?s)\A.*?(?-s:{regex})(?s:.*)\z"), F.lit(_HIT + _CUT.join(f"${g}" for g, _, _ in groups)))
        fast = let(once, lambda hit: F.when(hit.startswith(_HIT), let(F.split(F.substr(hit, F.lit(2)), _CUT), lambda parts: collect(lambda i, _: F.get(parts, F.lit(i))))))
        slow = F.when(text.rlike(regex), collect(lambda _, g: F.regexp_extract(text, regex, g)))
        return F.when(text.contains(_CUT) | text.contains(_HIT), slow).otherwise(fast)


@dataclass(frozen=True, kw_only=True)
class KeyValue(Step):
    """``key=value`` pairs; separators inside double quotes do not count, a later pair wins, no pair fails."""

    separator: str = " "
    assign: str = "="
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    prefix: str = ""

    def read(self, text: Column) -> Column:
        cut = re.escape(self.separator)
        tokens = F.regexp_extract_all(text, F.lit(rf'(?:[^{cut}"]++|"[^"]*+(?:"|\z))++'), F.lit(0))
        width = len(self.assign)

        def pair(token: Column) -> Column:
            at = F.instr(token, self.assign)
            value = F.substr(token, at + width)
            plain = let(value, lambda v: F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
            return F.struct(F.substr(token, F.lit(1), at - 1).alias("key"), plain.alias("value"))

        def wanted(token: Column) -> Column:
            key = F.substring_index(token, self.assign, 1)
            ok = F.instr(token, self.assign) > 1
            ok = ok & key.isin(*self.include) if self.include else ok
            return ok & ~key.isin(*self.exclude) if self.exclude else ok

        def last(pairs: Column) -> Column:
            later = F.reverse(pairs)
            keys = F.transform(later, lambda p: p["key"])
            first = let(keys, lambda ks: F.filter(later, lambda p, i: F.array_position(ks, p["key"]) == i + 1))
            named = F.transform(first, lambda p: F.struct(F.concat(F.lit(self.prefix), p["key"]), p["value"]))
            return F.when(F.size(pairs) > 0, F.map_from_entries(named))

        return let(F.transform(F.filter(tokens, wanted), pair), last)


@dataclass(frozen=True, kw_only=True)
class Json(Step):
    """An object with dotted keys of all its levels; arrays stay text, nulls go.

    Levels are opened one after another while a value is an object; a text has at most as many as opening braces.
    """

    def read(self, text: Column) -> Column:
        as_map = lambda t: F.from_json(t, "map<string,string>")

        def deeper(entries: Column) -> Column:
            def open_(e: Column) -> Column:
                inner = let(as_map(e["value"]), lambda m: F.transform(F.map_entries(m), lambda f: F.struct(F.concat(e["key"], F.lit("."), f["key"]).alias("key"), f["value"].alias("value"))))
                return F.when(e["value"].startswith("{"), F.coalesce(inner, F.array(e))).otherwise(F.array(e))

            return F.flatten(F.transform(entries, open_))

        closed = lambda entries: F.exists(entries, lambda e: e["value"].startswith("{"))
        levels = F.greatest(F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))), F.lit(1))
        entries = F.aggregate(F.sequence(F.lit(1), levels), F.map_entries(as_map(text)), lambda found, _: F.when(closed(found), deeper(found)).otherwise(found))
        flat = F.map_filter(F.map_from_entries(entries), lambda _, v: v.isNotNull())
        return F.when(F.ltrim(text).startswith("{"), flat)


@dataclass(frozen=True, kw_only=True)
class Csv(Step):
    """Named columns of one CSV line; ``_`` skips one, doubled quotes stand for one, too few columns fail."""

    columns: Sequence[str]
    separator: str = ","

    def read(self, text: Column) -> Column:
        cut = re.escape(self.separator)
        cells = F.regexp_extract_all(F.concat(F.lit(self.separator), text), F.lit(rf'{cut}("(?:[^"]++|"")*+"|[^{cut}]*+)'), F.lit(1))
        plain = lambda c: F.when(c.startswith('"') & (F.length(c) >= 2), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
        named = lambda got: fields_of({n: plain(F.get(got, F.lit(i))) for i, n in enumerate(self.columns) if n != "_"})
        return let(cells, lambda got: F.when(F.size(got) >= len(self.columns), named(got)))


def zone_text(zone: Column) -> Column:
    """A zone name, or an offset of at most 14 hours as ``+HH:MM``; NULL for anything else."""
    parts = F.regexp_replace(zone, r"^([+-])([0-9]{2}):?([0-9]{2})?$", "$1$2:$3")
    offset = F.when(zone.rlike(r"^[+-]([0-9]{2})(:?[0-9]{2})?$"), F.when(parts.endswith(":"), F.concat(parts, F.lit("00"))).otherwise(parts))
    return F.coalesce(F.when(offset.rlike(r"^[+-](0[0-9]|1[0-3]):[0-5][0-9]$|^[+-]14:00$"), offset), F.when(zone.isin(ZONES), zone))


@dataclass(frozen=True, kw_only=True)
class Date(Step):
    """An instant from the first format that fits, as UTC text in ``@timestamp``.

    Formats: ``UNIX``, ``UNIX_MS``, ``UNIX_US``, ``UNIX_NS``, ``UNIX_AUTO`` (by the number of digits),
    ``ISO8601``, ``SYSLOG`` (the year is that of ``now``, or the one before if that lies more than a day
    ahead), or a date pattern. Texts without a zone are read in ``zone_field``'s zone, else the default.
    """

    formats: Sequence[str]
    zone_field: str | None = None
    default_zone: str = "UTC"
    now: str | None = None

    def found(self, fields: Column) -> Column:
        zone = F.lit(self.default_zone)
        if self.zone_field:
            zone = F.coalesce(zone_text(F.try_element_at(fields, F.lit(self.zone_field))), zone)
        return let(F.try_element_at(fields, F.lit(self.field)), lambda text: let(zone, lambda z: self._read(text, z)))

    def extra_tags(self, fields: Column) -> Column:
        none = F.array().cast("array<string>")
        if not self.zone_field:
            return none
        named = F.try_element_at(fields, F.lit(self.zone_field))
        return F.when(named.isNull(), F.array(F.lit("_tz_missing"))).when(zone_text(named).isNull(), F.array(F.lit("_tz_unresolved"))).otherwise(none)

    def _read(self, text: Column, zone: Column) -> Column:
        instant = F.coalesce(*[self._one(f, text, zone) for f in self.formats])
        return let(instant, lambda at: F.when(at.isNotNull(), F.create_map(F.lit(AT), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))))

    def _one(self, name: str, text: Column, zone: Column) -> Column:
        digits = text.try_cast("decimal(30,9)")
        micros = lambda scale: F.timestamp_micros(F.floor(digits * scale).try_cast("bigint"))
        if name == "UNIX":
            return micros(1_000_000)
        if name == "UNIX_MS":
            return micros(1_000)
        if name == "UNIX_US":
            return micros(1)
        if name == "UNIX_NS":
            return F.timestamp_micros(F.floor(digits / 1000).try_cast("bigint"))
        if name == "UNIX_AUTO":
            n = F.length(F.regexp_extract(text, "^[0-9]+", 0))
            kinds = ((11, "UNIX"), (14, "UNIX_MS"), (17, "UNIX_US"))
            out = F.when(n == 0, F.lit(None).cast("timestamp"))
            for most, kind in kinds:
                out = out.when(n <= most, self._one(kind, text, zone))
            return out.otherwise(self._one("UNIX_NS", text, zone))
        if name == "ISO8601":
            local = F.to_utc_timestamp(text.try_cast("timestamp"), zone)
            return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp")).when(text.rlike("^[0-9]{4}-"), local)
        if name == "SYSLOG":
            now = F.lit(self.now).cast("timestamp") if self.now else F.current_timestamp()
            of = lambda year: F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), F.regexp_replace(text, " +", " ")), F.lit("yyyy MMM d HH:mm:ss")), zone)
            this = of(F.year(now))
            return F.when(this > now + F.expr("INTERVAL 1 DAY"), of(F.year(now) - 1)).otherwise(this)
        read = F.try_to_timestamp(text, F.lit(name))
        return read if re.search("[xXzZVO]", re.sub("'[^']*'", "", name)) else F.to_utc_timestamp(read, zone)


@dataclass(frozen=True, kw_only=True)
class Drop(Step):
    names: Sequence[str] = ()

    def run(self, state: Column) -> Column:
        return state.withField("fields", F.map_filter(state["fields"], lambda k, _: ~k.isin(*self.names)))


def parse_state(message: Column, steps: Sequence[Step]) -> Column:
    """``struct(fields, status, tags)`` after all steps; a NULL message fails at the first one that reads it."""
    state = F.struct(fields_of({"message": message}).alias("fields"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("tags"))
    for step in steps:
        state = let(state, step.run)
    return state
