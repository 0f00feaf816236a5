"""Evidence of many alert triggers in one plan: their windows and baselines meet the events in tiles of source, time and signature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from logmeridian.functions import scores
from logmeridian.functions.exprs import count_true
from logmeridian.operators.ranges import WIDTHS, level_of, micros
from logmeridian.scope import AccessScope, in_scope

BASELINE_SECONDS = 7 * 86_400
TILE_EVENTS = 1 << 19
"""More rows of one source and stretch of time are dealt over tiles by signature."""
TILE_TRIGGERS = 1 << 20
"""More triggers of one source and stretch of time are dealt over tiles by id."""
BATCH_ROWS = 1 << 16
_TILE = ("whom", "level_", "block_", "slot_", "part_")


def trigger_spans(triggers: DataFrame) -> DataFrame:
    """Triggers (``trigger_id, window_from, window_to, source_id``) with ``baseline_from``, seven days before their window; reversed windows are left out."""
    return triggers.filter("window_from < window_to").withColumn("baseline_from", F.expr(f"window_from - make_dt_interval(0, 0, 0, {BASELINE_SECONDS})"))


def _tile_counts(signature: tuple[str, ...], out: pa.Schema):
    """Of one tile: every trigger with every signature that its window holds, by look-ups in the signature's running counts.

    Triggers whose id is repeated are told for the signatures of their baseline too, since their rows are added up later.
    """

    def found(at: np.ndarray, counts: np.ndarray, classes: list[tuple], b0: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> Iterator[tuple]:
        running = np.concatenate([[0], np.cumsum(counts)])
        for order, start, longest in classes:
            low, high = np.searchsorted(start, at - longest, "right"), np.searchsorted(start, at, "right")
            if (high - low).sum() < len(start):
                # Few events: only the triggers that begin within the class's length before one of them.
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)
                order = order[np.flatnonzero(np.cumsum(edge[:-1]) > 0)]
            for cut in range(0, len(order), BATCH_ROWS):
                rows = order[cut : cut + BATCH_ROWS]
                a, b, c = (np.searchsorted(at, x[rows], "left") for x in (b0, w0, w1))
                yield rows, a, b, c, running

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asked = table.filter(table["is_trigger_"])
        events = table.filter(pc.invert(table["is_trigger_"]))
        del table
        if not len(asked) or not len(events):
            return
        ids = asked["trigger_id"].combine_chunks()
        w0, w1, b0 = (asked[c].to_numpy() for c in ("w0_", "w1_", "b0_"))
        start = np.where(asked["again_"].to_numpy(zero_copy_only=False), b0, w0)
        rank = np.frexp((w1 - start).astype(float))[1] // 2
        classes = []
        for r in np.unique(rank):
            member = np.flatnonzero(rank == r)
            member = member[np.argsort(start[member], kind="stable")]
            classes.append((member, start[member], int((w1 - start)[member].max())))
        code = np.zeros(len(events), np.int64)
        for name in signature:
            values = events[name].combine_chunks().dictionary_encode("encode")
            code = np.unique(code * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
        at, counts = events["at_"].to_numpy(), events["n"].to_numpy()
        order = np.lexsort((at, code))
        code, at, counts = code[order], at[order], counts[order]
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        texts = [events[name].combine_chunks().take(pa.array(order[heads])) for name in signature]
        kept: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            rows, which, *numbers = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *(t.take(pa.array(which)) for t in texts), *(pa.array(x) for x in numbers)], schema=out)

        for which, (first, last) in enumerate(zip(heads, np.append(heads[1:], len(code)), strict=True)):
            when = at[first:last]
            for rows, a, b, c, running in found(when, counts[first:last], classes, b0, w0, w1):
                inside, before = running[c] - running[b], running[b] - running[a]
                told = np.flatnonzero((inside > 0) | ((start[rows] < w0[rows]) & (before > 0)))
                if len(told):
                    rows, b, inside, before = rows[told], b[told], inside[told], before[told]
                    seen = np.where(inside > 0, when[np.minimum(b, len(when) - 1)], np.iinfo(np.int64).max)
                    kept.append((rows, np.full(len(rows), which), inside, before, seen, w1[rows] - w0[rows]))
                    size += len(rows)
                if size >= BATCH_ROWS:
                    yield batch()
                    size = 0
        if kept:
            yield batch()

    return run


def _met(spans: DataFrame, events: DataFrame, signature: tuple[str, ...]) -> DataFrame:
    """``trigger_id``, the signature, ``inside_``, ``before_``, ``seen_`` (microseconds) and ``span_``, once for each span and signature.

    A span lies in the block of its baseline's start, as wide as the next of ``WIDTHS``, and its events in that block or the next one.
    So each span is in one block and events are in two for each width in use. Blocks with many events are split by signature.
    """
    width = F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), F.col("level_") + 1)
    placed = spans.withColumn("level_", level_of(F.col("b0_"), F.col("w1_"))).withColumn("block_", F.floor(F.col("b0_") / width))
    levels = placed.select("whom", "level_").distinct()

    def dealt(rows: DataFrame) -> DataFrame:
        either = rows.withColumn("whom", F.explode(F.array(F.concat(F.lit("s:"), "source_id"), F.concat(F.lit("g:"), "owner_group")))).drop("owner_group", "source_id")
        number = F.floor(F.col("at_") / width)
        return either.join(levels, "whom").withColumn("block_", F.explode(F.array(number - 1, number)))

    timed = events.withColumn("at_", micros(F.col("ts")))
    counted = timed.filter("at_ IS NOT NULL").groupBy("owner_group", "source_id", "at_", *signature).agg(F.count(F.lit(1)).alias("n"))
    place = ["whom", "level_", "block_"]
    full = lambda rows, most, name: F.broadcast(rows.groupBy(*place).count().filter(F.col("count") > most).select(*place, F.ceil(F.col("count") / most).cast("int").alias(name)))
    slots = full(dealt(timed.select("owner_group", "source_id", "at_").filter("at_ IS NOT NULL")), TILE_EVENTS, "slots_")
    parts = full(placed, TILE_TRIGGERS, "parts_")
    split = lambda rows: rows.join(slots, place, "left").join(parts, place, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("slots_", "parts_")})
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    asked = split(placed).withColumn("part_", one_of("parts_", "trigger_id", "w0_")).withColumn("slot_", all_of("slots_"))
    shown = split(dealt(counted)).withColumn("slot_", one_of("slots_", *signature)).withColumn("part_", all_of("parts_"))
    both = asked.select(*_TILE, F.lit(True).alias("is_trigger_"), "trigger_id", "again_", "w0_", "w1_", "b0_").unionByName(
        shown.select(*_TILE, F.lit(False).alias("is_trigger_"), "at_", "n", *signature), allowMissingColumns=True
    )
    schema = StructType([
        StructField("trigger_id", spans.schema["trigger_id"].dataType), *(StructField(c, events.schema[c].dataType) for c in signature),
        *(StructField(c, LongType()) for c in ("inside_", "before_", "seen_", "span_")),
    ])
    return both.groupBy(*_TILE).applyInArrow(_tile_counts(signature, to_arrow_schema(schema)), schema)


def signature_counts(triggers: DataFrame, events: DataFrame, scope: AccessScope, signature: tuple[str, ...] = ("signature_hash", "signature_text")) -> DataFrame:
    """Per trigger and signature of its source: ``window_count``, ``baseline_count``, ``first_seen_at`` in the window, ``expected`` and ``z_score``.

    A blank or null source of a trigger stands for all sources of its ``owner_group``. Events are counted per source, signature and
    instant before they meet the triggers, so repeated lines travel once. Counts are differences of a signature's running count, so no
    pair of a trigger and an event is ever made. Signatures that the window does not hold, and hash 0, are left out.
    """
    spans = trigger_spans(triggers).select(
        F.col("trigger_id"), micros(F.col("window_from")).alias("w0_"), micros(F.col("window_to")).alias("w1_"), micros(F.col("baseline_from")).alias("b0_"),
        F.when(F.trim(F.coalesce("source_id", F.lit(""))) != "", F.concat(F.lit("s:"), "source_id")).otherwise(F.concat(F.lit("g:"), "owner_group")).alias("whom"),
        (F.count(F.lit(1)).over(Window.partitionBy("trigger_id")) > 1).alias("again_"),
    ).filter("whom IS NOT NULL")
    readable = events.filter(in_scope(scope))
    once = _met(spans.filter("NOT again_"), readable, signature)
    # Rows of triggers with one id are added up; an id that stands alone has nothing to add.
    added = _met(spans.filter("again_"), readable, signature).groupBy("trigger_id", *signature).agg(
        F.sum("inside_").alias("inside_"), F.sum("before_").alias("before_"), F.min("seen_").alias("seen_"), F.max("span_").alias("span_")
    )
    found = once.unionByName(added).filter("inside_ > 0").select(
        "trigger_id", *signature, F.col("inside_").alias("window_count"), F.col("before_").alias("baseline_count"),
        F.timestamp_micros("seen_").cast(events.schema["ts"].dataType).alias("first_seen_at"), "span_",
    )
    kept = found.filter(F.col("signature_hash") != 0) if "signature_hash" in signature else found
    expected = F.col("baseline_count") * F.col("span_") / F.lit(BASELINE_SECONDS * 1_000_000.0)
    return kept.withColumn("expected", expected).withColumn("z_score", scores.poisson_z(F.col("window_count"), F.col("expected"))).drop("span_")


def trigger_findings(triggers: DataFrame, events: DataFrame, scope: AccessScope, min_z: float = 3.0, min_count: int = 5) -> DataFrame:
    """``trigger_id, provider_id, signature_text, ts, weight``: signatures first seen in a trigger's window, and those far above their baseline's rate."""
    counts = signature_counts(triggers, events, scope)
    high = (F.col("window_count") >= min_count) & (F.col("expected") > 0) & (F.col("z_score") >= min_z)
    # A count is one or the other, for what has no baseline has no rate: one pass tells both.
    provider = F.when(F.col("baseline_count") == 0, "logs.first-seen").when(high, "logs.volume")
    weight = F.when(F.col("baseline_count") == 0, F.col("window_count").cast("double")).otherwise(F.col("z_score"))
    return counts.select("trigger_id", provider.alias("provider_id"), "signature_text", F.col("first_seen_at").alias("ts"), weight.alias("weight")).filter("provider_id IS NOT NULL")


def trigger_slices(triggers: DataFrame, findings: DataFrame) -> DataFrame:
    """Per trigger and provider: ``gathered`` or ``empty``, and the number of findings."""
    providers = F.explode(F.array(F.lit("logs.first-seen"), F.lit("logs.volume"))).alias("provider_id")
    counts = findings.groupBy("trigger_id", "provider_id").agg(count_true(F.lit(True)).alias("findings"))
    joined = trigger_spans(triggers).select("trigger_id", providers).join(counts, ["trigger_id", "provider_id"], "left")
    return joined.select("trigger_id", "provider_id", F.when(F.col("findings") > 0, "gathered").otherwise("empty").alias("status"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))
