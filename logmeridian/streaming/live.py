"""Arriving events: counts per bucket and suppression of repeated deliveries, with bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logmeridian.session import checkpoint_dir


def histogram(stream: DataFrame, seconds: int, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """``bucket_start, event_count`` of epoch-aligned buckets; one is final once the newest event is ``late`` past its end.

    Events that come later than that are not counted; the state holds open buckets only.
    """
    timed = stream.select(F.col(at).cast("timestamp").alias("at_")).withWatermark("at_", late)
    counted = timed.groupBy(F.window("at_", f"{seconds} seconds").alias("w_")).agg(F.count(F.lit(1)).alias("event_count"))
    return counted.select(F.col("w_.start").cast("timestamp_ntz").alias("bucket_start"), "event_count")


def without_repeats(stream: DataFrame, key: Sequence[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """``stream`` without rows whose key came before and is at most ``late`` old."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


_SILENCE = "source_id string, owner_group string, never_seen boolean, last_at timestamp, fired_at timestamp"
_NOTHING = -(2**63)
SOURCE_GROUPS = 1024
"""Groups of sources with a state each; the number stays for the life of a stream."""


def _watch(silence: int):
    """Of the sources of one group: each stretch of ``silence`` microseconds without an arrival, told once it is over or time has passed it.

    The state holds, for each source, its name, the owner group (null before the source is known), the creation, the last arrival,
    and whether its silence was told. All sources of a group are handled at once, for a call of Python costs more than a source does.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, owners, created, last, told = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        found: list[pd.DataFrame] = []
        known, came = [], []
        for rows in () if state.hasTimedOut else chunks:
            listed = rows["owner_group"].notna()
            known.append(_newest(rows.loc[listed, ["source_id", "owner_group", "enabled", "micros"]]))
            at = rows.loc[~listed, ["source_id", "micros"]]
            # Two arrivals of one interval of that length leave no silence between them but at its ends.
            ends = at.groupby(["source_id", at["micros"] // silence], sort=False)["micros"].agg(["min", "max"])
            came.append(pd.DataFrame({"source_id": [*ends.index.get_level_values(0)] * 2, "at": np.concatenate([ends["min"], ends["max"]]).astype(np.int64)}))
        if known:
            seen = pd.Index(names, dtype=object)
            seen = seen.append(pd.Index(pd.unique(np.concatenate([x["source_id"].to_numpy(object) for x in (*known, *came)]))).difference(seen, sort=False))
            fresh = len(seen) - len(names)
            names, owners = list(seen), owners + [None] * fresh
            created, last, told = created + [_NOTHING] * fresh, last + [_NOTHING] * fresh, told + [False] * fresh
        owner, created, last, told = np.array(owners, object), np.array(created, np.int64), np.array(last, np.int64), np.array(told, bool)
        if known:
            newest = _newest(pd.concat(known))
            at = seen.get_indexer(newest["source_id"])
            owner[at] = np.where(newest["enabled"].to_numpy(bool), newest["owner_group"].to_numpy(object), None)
            created[at] = newest["micros"].to_numpy(np.int64)
            points = pd.concat(came).drop_duplicates().sort_values(["source_id", "at"])
            who, at = seen.get_indexer(points["source_id"]), points["at"].to_numpy(np.int64)
            later = at > last[who]
            who, at = who[later], at[later]
            first = np.append(True, who[1:] != who[:-1])[: len(who)]
            never = first & (last[who] == _NOTHING)
            since = np.where(never, created[who], np.where(first, last[who], np.roll(at, 1)))
            over = (since != _NOTHING) & ~(first & told[who])
            over[over] = at[over] - since[over] >= silence
            found.append(pd.DataFrame({"who": who[over], "never": never[over], "since": since[over]}))
            final = np.append(first[1:], True)[: len(who)]
            last[who[final]], told[who[final]] = at[final], False
        never = last == _NOTHING
        since = np.where(never, created, last)
        open_ = (since != _NOTHING) & ~told & pd.notna(owner)
        due = np.flatnonzero(open_ & (since + silence < state.getCurrentWatermarkMs() * 1000))
        found.append(pd.DataFrame({"who": due, "never": never[due], "since": since[due]}))
        told[due] = True
        state.update((names, owner.tolist(), created.tolist(), last.tolist(), told.tolist()))
        left = since[open_ & ~told]
        if len(left):
            state.setTimeoutTimestamp(max((int(left.min()) + silence) // 1000, state.getCurrentWatermarkMs() + 1))
        out = pd.concat(found)
        out = out[pd.notna(owner[out["who"].to_numpy(np.int64)])]
        if len(out):
            who, never, since = out["who"].to_numpy(np.int64), out["never"].to_numpy(bool), out["since"].to_numpy(np.int64)
            yield pd.DataFrame({
                "source_id": np.array(names, object)[who], "owner_group": owner[who], "never_seen": never, "last_at": pd.to_datetime(np.where(never, pd.NaT.value, since * 1000), utc=True).tz_localize(None),
                "fired_at": pd.to_datetime((since + silence) * 1000),
            })

    return run


def _newest(listed: pd.DataFrame) -> pd.DataFrame:
    return listed.sort_values(["micros", "owner_group", "enabled"]).drop_duplicates("source_id", keep="last")


def silences(arrivals: DataFrame, inventory: DataFrame, silence_seconds: int, late: str = "1 hour", now: Column | None = None) -> DataFrame:
    """``source_id, owner_group, never_seen, last_at, fired_at``: every silence of an enabled source, also while nothing arrives from it.

    ``arrivals`` (``source_id, ingested_at``) and ``inventory`` (``source_id, owner_group, enabled, created_at``) are streams; the inventory's
    newest row of a source counts. A source that never sent anything is silent since its creation. A silence is told when the
    next arrival ends it, or by a timer when the newest ingest time is ``late`` past it; the state of a source is five values, kept with those of its group. An
    ingest clock that is ahead of ``now`` (default: the time of processing) counts as now, so it silences no other source.
    Unlisted and disabled sources, null sources and null times are left out.
    """
    clock = F.current_timestamp() if now is None else now.cast("timestamp")
    none = F.lit(None)
    came = arrivals.select("source_id", none.cast("string").alias("owner_group"), F.lit(True).alias("enabled"), F.least(F.col("ingested_at").cast("timestamp"), clock).alias("at"))
    listed = inventory.select("source_id", F.coalesce("owner_group", F.lit("")).alias("owner_group"), F.coalesce("enabled", F.lit(False)).alias("enabled"), F.least(F.col("created_at").cast("timestamp"), clock).alias("at"))
    both = came.unionByName(listed).filter("source_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = both.withColumn("micros", F.unix_micros("at")).withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(SOURCE_GROUPS)).cast("int"))
    return rows.groupBy("part").applyInPandasWithState(
        _watch(silence_seconds * 1_000_000), _SILENCE, "names array<string>, owner_groups array<string>, created array<long>, last array<long>, told array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _released(gap: int):
    """Of one rule: its firings in order, the first that goes out, and the next that comes ``gap`` microseconds after it."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (_NOTHING,)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["micros", "id"])
        reasons = []
        for at in rows["micros"].tolist():
            out = last == _NOTHING or at - last >= gap or at == last
            reasons.append("" if out else "repeat")
            last = at if out else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "rule_id": key[0], "reason": reasons})

    return run


def repeats(triggers: DataFrame, repeat_seconds: int, late: str = "1 hour") -> DataFrame:
    """``id, rule_id, reason`` of arriving triggers (``id, rule_id, fired_at``) in the order of their batches: ``repeat`` when the rule's last one that went out is less than ``repeat_seconds`` before.

    A rule's state is the instant of that one; it is dropped when the newest instant is an interval and ``late`` past it.
    """
    rows = triggers.select("id", "rule_id", F.col("fired_at").cast("timestamp").alias("at")).filter("rule_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    timed = rows.withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("rule_id").applyInPandasWithState(
        _released(repeat_seconds * 1_000_000), "id string, rule_id string, reason string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all there is to read, append to a table in the shared folder, and read that back.

    State and progress lie in the shared folder too, so a lost executor costs a repeated task only.
    """
    folder = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
