"""Personal data: generators propose overlapping spans, boosted trees score them, thresholds select.

The base rules find e-mail addresses, IP addresses, card numbers and phone numbers of fixed form;
their spans are always kept. Wider generators propose further spans, which may overlap: addresses with
a written-out "at", numbers grouped or bracketed in other ways. Boosted trees learn from the format and
the context which ones look like personal data. Their labels do not come from the form of the base rules: confirmed
spans, rewritten in place into the wider forms, are positive; the same spans made false (a failing checksum, a part out of
range, a date, a sum, a sentence) and proposals that such a check refutes are negative; all other proposals have no label.
On a held-out half of the texts each kind gets the lowest
threshold at which the share of confirmed proposals reaches ``PRECISION``; proposals above it, apart
from base spans, are added best first. Fitting, calibrating, proposing, scoring and selecting cover every whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm import boosting
from logmeridian.llm import words as W
from logmeridian.llm.storage import arrow_ready, stash, table

SAMPLE = 20_000
"""Examples that the driver fits by itself; of more, Spark jobs count the histograms of all of them."""
GRID = 1 << 16
"""Steps between 0 and 1 of the scores at which many examples are calibrated."""
PRECISION = 0.98
LEAST_CALIBRATION = 50
"""A kind with fewer held-out examples above a threshold than this adds none."""
CONTEXT = 24

# The kinds, in the order in which spans are listed, and the forms of the base rules.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CLUSTER = re.compile(r"[+(]?[0-9](?:[\x20().,/_\[\]-]{0,3}[0-9])*")
_WRITTEN_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\x20?(?:\[at\]|\(at\)|@)\x20?([A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,63}){1,8})")
_DIGITS = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"(?<=[0-9])[^0-9]+(?=[0-9])")
_LABEL = re.compile(r"[A-Za-z]*\Z")
_SENTENCE = re.compile(r"\.\x20[A-Z]")
_NUMBER = re.compile(r"(?:19|20)[0-9]{2}([-./])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[01]?[0-9]\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}\x20?[-/]\x20?(?:19|20)[0-9]{2}|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+")
"""Dates, spans of years, and sums."""
_HINTS = (("mail", "contact"), ("ip", "host", "addr"), ("card", "visa", "pay"), ("tel", "phone", "call", "fax"))

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the base rules, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def proposals(text: str) -> list[Span]:
    """Wider, overlapping candidates; those of the base rules are among them."""
    out = set(base_spans(text))
    if "@" in text or "at]" in text or "at)" in text:
        out.update((0, *m.span()) for m in _WRITTEN_AT.finditer(text))
    for m in _CLUSTER.finditer(text):
        if text[max(0, m.start() - 1) : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum():
            continue
        count = sum(c in "0123456789" for c in m[0])
        groups = _DIGITS.findall(m[0])
        if 4 <= len(groups) <= 6 and count <= 15 and max(map(len, groups)) <= 3:
            out.add((1, *m.span()))
        if 13 <= count <= 19:
            out.add((2, *m.span()))
        if 7 <= count <= 16 and (len(groups) > 1 or m[0][0] in "+("):
            out.add((3, *m.span()))
    return sorted(out)


def _features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    inner, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = _DIGITS.findall(inner)
    count = sum(map(len, groups))
    before, after = left[-1:], right[:1]
    return [
        kind,
        end - start,
        count,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(luhn("".join(groups))) if count else -1.0,
        max((float(g[-6:]) for g in groups), default=-1.0),
        sum(not c.isalnum() for c in inner),
        len(set(_BETWEEN.findall(inner))),
        inner.count(","),
        sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        sum(c.isalpha() for c in inner),
        float(len(_LABEL.search(inner)[0])),
        float(_SENTENCE.search(inner) is not None),
        float(before.isalnum()) - float(before == ""),
        float(after.isalnum()) - float(after == ""),
        float(before in ".-/_=") if before else 0.0,
        float(after in ".-/_=") if after else 0.0,
        sum(c in "0123456789" for c in left) + sum(c in "0123456789" for c in right),
        float(any(h in left.lower() for h in _HINTS[kind])),
    ]


def _suspects(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Texts that could hold any span: with an at sign, a bracketed "at", or four digits."""
    for first, last, data, offs in W.pieces(column):
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        signs = np.concatenate([[0], np.cumsum((data == 64) | (data == 91) | (data == 40))])
        able = (digits[offs[1:]] - digits[offs[:-1]] >= 4) | (signs[offs[1:]] > signs[offs[:-1]])
        for i in np.flatnonzero(able).tolist():
            yield first + i, column[first + i].as_py()


def _rewritten(kind: int, inner: str, draw: random.Random) -> list[tuple[str, bool]]:
    """A confirmed span in wider forms, and in the same forms made false."""
    digits, pick = "".join(_DIGITS.findall(inner)), draw.choice
    if kind == 0:
        local, _, host = inner.rpartition("@")
        labels = host.split(".")
        price = f"{draw.randint(1, 99)}.{draw.randint(10, 99)}"
        return [
            (local + pick((" [at] ", "[at]", " (at) ", "(at)", " @ ")) + pick((" [dot] ", "[dot]", " (dot) ", "(dot)", ".")).join(labels), True),
            (f"{local} @ {pick((f'{labels[0]}. {labels[-1].capitalize()}', price))}", False),
        ]
    if kind == 1:
        parts, between = inner.split("."), pick(("[.]", "(.)", " . ", "-", "_"))
        wrong = list(parts)
        wrong[draw.randrange(4)] = str(draw.randint(256, 999))
        return [(between.join(parts), True), (between.join(pick((wrong, [*parts, str(draw.randint(0, 99))]))), False)]
    if kind == 2:
        between = pick((".", "/", "_", "  ", " - "))
        forms = lambda d: between.join(d[i : i + 4] for i in range(0, len(d), 4))
        return [(forms(digits), True), (forms(digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)), False)]
    d, year = digits, draw.randint(1900, 2029)
    wide = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:4]}/{d[4:]}", f"00{d[:2]} {d[2:5]} {d[5:]}", f"{d[:2]} {d[2:5]} {d[5:]}", f"+{d[:2]}/{d[2:]}")
    false = (f"{int(d):,}", f"{d[:5]}.{d[5:]}", f"{year}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", f"{draw.randint(1, 28)}.{draw.randint(1, 12):02}.{year}", f"{year}-{year + draw.randint(1, 9)}")
    return [(pick(wide), True), (pick(false), False)]


def _refuted(text: str, span: Span, base: list[Span]) -> bool:
    """Whether a check that does not depend on the separators shows that a proposal is no personal data."""
    kind, start, end = span
    inner = text[start:end]
    groups = _DIGITS.findall(inner)
    if kind == 0:
        return len(_LABEL.search(inner)[0]) < 2 or _SENTENCE.search(inner) is not None
    if kind == 1:
        return len(groups) != 4 or any(int(g) > 255 for g in groups)
    if kind == 2:
        return not luhn("".join(groups))
    return _NUMBER.fullmatch(inner) is not None or sum(map(len, groups)) > 15 or any(k != 3 and a < end and start < b for k, a, b in base)


def _examples(text: str, mark: bytes) -> Iterator[tuple[str, bool, list[float]]]:
    """``(key, label, features)``; all examples of one text end in the same digit, so they are held out together."""
    key = lambda *of: hashlib.blake2b(mark + repr(of).encode(), digest_size=8).hexdigest()[:-1] + mark.hex()[-1]
    base = base_spans(text)
    known = set(base)
    for kind, start, end in base:
        left, right = text[max(0, start - 2 * CONTEXT) : start], text[end : end + 2 * CONTEXT]
        draw = random.Random(key("draw", kind, start, end))
        for form, label in _rewritten(kind, text[start:end], draw):
            around, span = left + form + right, (kind, len(left), len(left) + len(form))
            if span in proposals(around) and span not in base_spans(around):
                yield key(form, kind, start, end), label, _features(around, span)
    for span in proposals(text):
        if span not in known and _refuted(text, span, base):
            yield key(span), False, _features(text, span)


def fit_selector(texts: DataFrame) -> tuple[boosting.Boosted, list[float]]:
    """The trees and a threshold for each kind, from the examples of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels, rows = [], [], []
            for _, text in _suspects(batch.column(0)):
                mark = hashlib.blake2b(text.encode(), digest_size=8).digest()
                for key, label, x in _examples(text, mark):
                    keys.append(key)
                    labels.append(label)
                    rows.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(labels, pa.bool_()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "label", "x"])

    examples = stash(texts.select("text").mapInArrow(run, "key string, label boolean, x array<double>"), "examples")
    if examples.count() > SAMPLE:
        return _fit_spread(examples)
    rows = examples.orderBy("key", "label", "x").collect()
    if not rows:
        return boosting.Boosted([], [], 0.0), [2.0] * len(KINDS)
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    held = np.array([int(r["key"][-1], 16) % 2 == 1 for r in rows])
    model = boosting.fit(x[~held], y[~held])
    scores = model.score(x[held])
    return model, [_threshold(scores[x[held][:, 0] == k], y[held][x[held][:, 0] == k]) for k in range(len(KINDS))]


def _fit_spread(examples: DataFrame) -> tuple[boosting.Boosted, list[float]]:
    """Of any number of examples: histograms and calibration are counted by Spark jobs; scores are rounded down to a grid."""
    held = F.substring("key", -1, 1).isin(*"13579bdf")
    learned = examples.filter(~held)
    model = boosting.fit(boosting.Spread(learned, "x"), boosting.Spread(learned, "label"))
    if not model.cuts:
        return model, [2.0] * len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(np.floor(model.score(x) * GRID).astype(np.int64)), batch.column(1)], names=["kind", "at", "label"])

    scored = examples.filter(held).select("x", "label").mapInArrow(run, "kind long, at long, label boolean")
    found = scored.groupBy("kind", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("confirmed")).collect()  # at most GRID + 1 a kind
    of = lambda k, c: np.array([r[c] for r in found if r["kind"] == k], float)
    return model, [_threshold(of(k, "at") / GRID, of(k, "confirmed"), of(k, "n")) for k in range(len(KINDS))]


def _threshold(scores: np.ndarray, confirmed: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Lowest score at which the proposals from it upwards are confirmed often enough; 2 if there is none. ``counts`` of proposals stand behind each score."""
    order = np.argsort(-scores, kind="stable")
    number = np.cumsum(np.ones(len(order)) if counts is None else counts[order])
    share = np.cumsum(confirmed[order]) / number
    last_of_tie = np.append(np.diff(scores[order]) != 0, True)
    able = np.flatnonzero((share >= PRECISION) & last_of_tie[: len(order)] & (number >= LEAST_CALIBRATION))
    return float(scores[order][able[-1]]) if len(able) else 2.0


def select(text: str, model: boosting.Boosted, thresholds: list[float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and the best proposals that overlap nothing chosen before."""
    base = base_spans(text)
    rest = [s for s in proposals(text) if s not in set(base)]
    chosen = list(base)
    if rest and model.cuts:
        scores = model.score(np.array([_features(text, s) for s in rest]))
        for i in sorted(range(len(rest)), key=lambda i: (-scores[i], rest[i])):
            if scores[i] >= thresholds[rest[i][0]] and all(rest[i][2] <= a or b <= rest[i][1] for _, a, b in chosen):
                chosen.append(rest[i])
    return base, sorted(chosen)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlaps merged, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base counts by kind, ``base_spans``, ``spans``, ``redacted``.

    Offsets are code points, ends exclusive. A null or empty text has no spans and is redacted to the
    empty text. Null ids and repeated rows keep their rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    model, thresholds = fit_selector(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            base_text, all_text, clean = [""] * n, [""] * n, batch.column(1).to_pylist()
            for i, text in _suspects(batch.column(1)):
                base, spans = select(text, model, thresholds)
                for kind, _, _ in base:
                    counts[kind, i] += 1
                base_text[i], all_text[i] = spans_text(base), spans_text(spans)
                clean[i] = redact(text, spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(clean, pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, spans string, redacted string").withColumnRenamed("id", id_column)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
