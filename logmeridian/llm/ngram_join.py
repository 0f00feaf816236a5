"""Near-duplicate join of documents on word shingles: a size-aware heavy-light set join.

Documents link when the Jaccard similarity of their sets of 5-word shingles is 75 % or more. The join
is exact and runs in these steps.

1. Documents with equal sets form a class; only classes are joined from here on.
2. One shuffle of all shingle hashes, cut into key ranges and packed into byte columns, finds each
   shingle's document frequency. A shingle of one class can link nothing and goes no further. For a
   shingle that is frequent within one batch of a task only a mark is sent to its range, while its
   postings travel apart, dealt by hash, so no task receives a hot shingle whole; a mark puts the
   shingle last in the order of all batches alike.
3. Light sets (small ones) enumerate all their subsets of the size that a link requires; two light
   sets that link have one in common. Heavy sets are entered in, and scan, inverted lists of their
   rarest shingles: a set of n needs n - ceil(0.75 n) + 1 of them to meet every partner. The size
   that separates light from heavy is the one with the least total cost, counted over all sets.
4. Lists are verified in rounds. A round compares each list's members with one pivot only and merges
   what links; then all remaining pairs of one list in different components, under the bounds on
   size and position, are compared. Pairs inside one component are never formed, so a list of many
   near copies costs its length, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm import words as W
from logmeridian.llm.components import components
from logmeridian.llm.storage import arrow_ready, shuffle_width, stash

BATCH_SHINGLES = 1_200_000
"""Shingles gathered in a task before they are sorted and sent."""
LOCALLY_HOT = 64
"""Classes of one batch that share a shingle, from which on it is marked as frequent."""
FREQUENT = 1 << 40
"""Stands for the frequency of a marked shingle: such shingles come last in the common order."""
LIGHT_LIMIT = 14
"""Largest size considered for subset enumeration; the cost picks the boundary at or below it."""
PIVOT_ROUNDS = 2

PLAIN, MARK, HOT = 0, 1, 2


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value per set, equal for equal sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sizes.sum() else np.empty(0, np.uint64)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(flat + np.uint64(0x51ED27)))])
    return W.mix((total[cut[1:]] - total[cut[:-1]]) ^ (sizes.astype(np.uint64) << np.uint64(40))).view(np.int64)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in W.pieces(batch.column(1)):
                sets = W.shingle_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_digests(sets), pa.int64()),
                    ],
                    names=["id", "n", "cls"],
                )

    return run


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values byte plane by byte plane: equal high bytes lie together and compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


_SENT = pa.schema([("range", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("idx", pa.binary()), ("cls", pa.binary()), ("size", pa.binary())])


def _send(k: int, ranges: int):
    width = (1 << 64) // ranges + 1
    edges = np.array([i * width for i in range(1, ranges)], np.uint64)

    def flush(keys: np.ndarray, own: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(heads, len(keys)))
        hot = np.repeat(counts >= LOCALLY_HOT, counts)
        rows: list[tuple] = []

        def add(kind: int, at: int, part: np.ndarray, who: np.ndarray) -> None:
            present, idx = np.unique(who, return_inverse=True)
            rows.append((at, kind, _planes(part), idx.astype("<u2").tobytes(), cls[present].tobytes(), size[present].astype("<i4").tobytes()))

        plain, whose = keys[~hot], own[~hot]
        cuts = np.concatenate([[0], np.searchsorted(plain, edges), [len(plain)]])
        for r in np.flatnonzero(np.diff(cuts)):
            add(PLAIN, int(r), plain[cuts[r] : cuts[r + 1]], whose[cuts[r] : cuts[r + 1]])
        marked = keys[heads][counts >= LOCALLY_HOT]
        cuts = np.concatenate([[0], np.searchsorted(marked, edges), [len(marked)]])
        for r in np.flatnonzero(np.diff(cuts)):
            rows.append((int(r), MARK, _planes(marked[cuts[r] : cuts[r + 1]]), b"", b"", b""))
        if len(marked):
            lot = (own[hot] % 16).astype(np.int64)
            deal = int(cls[0]) % ranges
            for j in np.unique(lot):
                add(HOT, ranges + (deal + int(j)) % ranges, keys[hot][lot == j], own[hot][lot == j])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()
        total = 0
        for batch in batches:
            for _, _, data, offs in W.pieces(batch.column(0)):
                sets = W.shingle_sets(data, offs, k)
                for one, name in zip(sets, _digests(sets).tolist(), strict=True):
                    if len(one) and name not in seen:
                        seen.add(name)
                        kept.append(one)
                        names.append(name)
                        total += len(one)
                if total >= BATCH_SHINGLES or len(kept) >= 30_000:
                    size = np.array([len(s) for s in kept], np.int64)
                    yield flush(np.concatenate(kept), np.repeat(np.arange(len(kept)), size), np.array(names, np.int64), size)
                    kept, names, seen, total = [], [], set(), 0
        if kept:
            size = np.array([len(s) for s in kept], np.int64)
            yield flush(np.concatenate(kept), np.repeat(np.arange(len(kept)), size), np.array(names, np.int64), size)

    return run


_SHARED = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("df", pa.int64())])


def _open(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, cls, size = [], [], []
    for row in rows:
        idx = np.frombuffer(row["idx"], "<u2")
        keys.append(_unplanes(row["keys"]))
        cls.append(np.frombuffer(row["cls"], "<i8")[idx])
        size.append(np.frombuffer(row["size"], "<i4")[idx])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(keys), np.concatenate(cls), np.concatenate(size)


def _meet(group: pa.Table) -> pa.Table:
    """Postings of one key range whose shingle more than one class has, with its frequency."""
    rows = group.select(["kind", "keys", "idx", "cls", "size"]).to_pylist()
    keys, cls, size = _open([r for r in rows if r["kind"] == PLAIN])
    marks = [r for r in rows if r["kind"] == MARK]
    marked = np.unique(np.concatenate([_unplanes(r["keys"]) for r in marks])) if marks else np.empty(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, cls, size = keys[order], cls[order], size[order]
    same = keys[1:] == keys[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.empty(0, bool)
    if len(marked) and len(keys):
        at = np.minimum(np.searchsorted(marked, keys), len(marked) - 1)
        several |= marked[at] == keys
    keys, cls, size = keys[several], cls[several], size[several]
    order = np.lexsort((cls, keys))
    keys, cls, size = keys[order], cls[order], size[order]
    if len(keys):
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])])
        keys, cls, size = keys[fresh], cls[fresh], size[fresh]
    found, counts = np.unique(keys, return_counts=True)
    df = counts.astype(np.int64)
    if len(marked):
        at = np.minimum(np.searchsorted(marked, found), len(marked) - 1)
        df[marked[at] == found] = FREQUENT
    df = np.repeat(df, counts)
    real = df > 1
    hot = _open([r for r in rows if r["kind"] == HOT])
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([cls[real], hot[1]])),
            pa.array(np.concatenate([size[real], hot[2]]), pa.int32()),
            pa.array(np.concatenate([keys[real], hot[0]]).view(np.int64)),
            pa.array(np.concatenate([df[real], np.full(len(hot[0]), FREQUENT)])),
        ],
        schema=_SHARED,
    )


def required(n, m, percent: int):
    """Least overlap of linked sets of ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def _gather(percent: int):
    """Per class its shared shingles, rarest first; classes that share too few to link are dropped."""

    def run(group: pa.Table) -> pa.Table:
        cls, n, h, df = (group.column(c).to_numpy() for c in ("cls", "n", "h", "df"))
        order = np.lexsort((h, df, cls))
        cls, n, h = cls[order], n[order], h[order]
        fresh = np.concatenate([[True], (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])])
        cls, n, h = cls[fresh], n[fresh], h[fresh]
        heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        sizes = np.diff(np.append(heads, len(cls)))
        able = sizes * 100 >= percent * n[heads].astype(np.int64)
        keep = np.repeat(able, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes[able])]).astype(np.int32)
        return pa.table(
            {
                "cls": pa.array(cls[heads][able]),
                "n": pa.array(n[heads][able], pa.int32()),
                "items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keep])),
            }
        )

    return run


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Overlaps that links of a set of ``n`` with sets up to ``boundary`` require."""
    partners = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    return sorted({required(n, m, percent) for m in partners} & set(range(1, n + 1)))


def _subsets(boundary: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for cls, n, items in zip(frame["cls"], frame["n"], frame["items"], strict=True):
                ordered = np.sort(np.asarray(items, np.int64)).view(np.uint64)
                for size in subset_sizes(n, boundary, percent):
                    if size <= len(ordered):
                        picked = np.array(list(combinations(ordered.tolist(), size)), np.uint64)
                        keys = np.full(len(picked), size, np.uint64)
                        for j in range(size):
                            keys = W.mix(keys + picked[:, j])
                        rows.append(pd.DataFrame({"key": keys.view(np.int64), "cls": cls, "n": n, "rank": -1, "own": 1 - len(ordered) / n}))
            if rows:
                yield pd.concat(rows)

    return run


def _prefix_length(percent: int):
    """How many of the shared shingles belong to the prefix; those of one class come before them."""
    n = F.col("n")
    need = F.ceil(n * percent / 100)
    return F.greatest(F.lit(0), n - need + 1 - (n - F.size("items"))).cast("int")


def _light_boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs less in total than scanning the lists."""
    lengths = lists.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    scans = lists.where(F.col("n") <= LIGHT_LIMIT).join(lengths, "key").groupBy("n").agg(F.sum("length").alias("scan"))
    sizes = sets.where(F.col("n") <= LIGHT_LIMIT).groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
    cost = {r["n"]: (r["sets"], r["scan"] or 0) for r in sizes.join(scans, "n", "left").collect()}
    best, least, total = 0, 0, 0
    for x in range(1, LIGHT_LIMIT + 1):
        count, scan = cost.get(x, (0, 0))
        total += count * sum(comb(x, c) for c in subset_sizes(x, x, percent)) - scan
        if total <= least:
            best, least = x, total
    return best


def _possible(percent: int):
    """Bounds on size and, where both sides come from a list, on the positions of the shingle."""
    na, nb = F.col("a.n"), F.col("b.n")
    rest = F.least(na - F.col("a.rank"), nb - F.col("b.rank"))
    return (
        (na * 100 >= nb * percent)
        & (nb * 100 >= na * percent)
        & ((F.col("a.rank") < 0) | (rest * (100 + percent) >= (na + nb) * percent))
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of ``(x, cx, y, cy)``, as edges between their components."""
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("items").alias(f"i{s}"))
    overlap = F.size(F.array_intersect("ix", "iy"))
    return (
        pairs.join(side("x"), "x")
        .join(side("y"), "y")
        .where(overlap * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
        .select("cx", "cy")
        .distinct()
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """Each pair once, smaller class first, with the component of either side."""
    first, second = F.struct("a.cls", "a.comp"), F.struct("b.cls", "b.comp")
    return rows.select(F.least(first, second).alias("p"), F.greatest(first, second).alias("q")).distinct().select(
        F.col("p.cls").alias("x"), F.col("p.comp").alias("cx"), F.col("q.cls").alias("y"), F.col("q.comp").alias("cy")
    )


def _components(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(cls, comp)`` of every class in ``blocks``.

    The first pivot of a list is the set with the least share of shingles of its own: of a text and its
    edited copies that is the text, which links with more of them than they do with each other. Later
    pivots come from the largest component of the list. Components found are contracted, so each round
    adds edges between components only.
    """
    labelled = blocks.withColumn("comp", F.col("cls"))
    for turn in range(PIVOT_ROUNDS + 1):
        if turn == 0:
            order = F.struct("own", F.xxhash64("cls").alias("o"), "cls", "n", "rank", "comp")
            pivot = labelled.groupBy("key").agg(F.min(order).alias("p")).select("key", "p.cls", "p.n", "p.rank", "p.comp")
            rows = labelled.alias("a").join(pivot.alias("b"), "key").where(F.col("a.comp") != F.col("b.comp"))
        else:
            order = F.struct(F.xxhash64("cls", F.lit(turn)).alias("o"), "cls", "n", "rank")
            parts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("p"))
            top = (
                parts.groupBy("key").agg(F.max(F.struct("c", "comp", "p")).alias("t"), F.count(F.lit(1)).alias("parts"))
                .where("parts > 1").select("key", F.col("t.comp").alias("top"), F.col("t.p").alias("p"))
            )
            mixed = labelled.join(top, "key")
            if turn < PIVOT_ROUNDS:
                pivot = top.select("key", "p.cls", "p.n", "p.rank", F.col("top").alias("comp"))
                rows = labelled.alias("a").join(pivot.alias("b"), "key").where(F.col("a.comp") != F.col("b.comp"))
            else:
                rows = mixed.where("comp <> top").alias("a").join(mixed.alias("b"), "key").where(
                    (F.col("a.comp") != F.col("b.comp"))
                    & ((F.col("b.comp") == F.col("b.top")) | (F.col("a.cls") < F.col("b.cls")))
                )
        edges = _verified(_pairs(rows.where(_possible(percent))), sets, percent)
        roots = components(edges, "cx", "cy")
        labelled = stash(
            labelled.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
            .select("key", "cls", "n", "rank", "own", F.coalesce("root", "comp").alias("comp")),
            "labelled",
        )
    return labelled.select("cls", "comp").distinct()


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``class_id``, ``component_id``.

    ``class_id`` is the smallest id with an equal shingle set, ``component_id`` the smallest id that
    links lead to. A null or empty text, or one without words, has no shingles and links with nothing:
    both are its own id. A null id keeps its row; such rows link others but never name a class unless
    all its ids are null. Repeated rows stay and share a class. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    ranges = 2 * shuffle_width(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    described = stash(docs.mapInArrow(_describe(k), "id long, n long, cls long"), "described")
    sent = docs.select("text").mapInArrow(_send(k, ranges), "range int, kind byte, keys binary, idx binary, cls binary, size binary")
    shared = stash(sent.groupBy("range").applyInArrow(_meet, "cls long, n int, h long, df long"), "shared")
    sets = stash(
        shared.groupBy(F.pmod("cls", F.lit(ranges)).alias("lot")).applyInArrow(_gather(percent), "cls long, n int, items array<long>"),
        "sets",
    )
    lists = sets.select(
        "cls", "n", (F.col("n") - F.size("items")).alias("before"), F.posexplode(F.slice("items", F.lit(1), _prefix_length(percent))).alias("at", "key")
    ).select("key", "cls", "n", (F.col("before") + F.col("at")).alias("rank"), (F.col("before") / F.col("n")).alias("own"))
    boundary = _light_boundary(sets, lists, percent)
    light = sets.where(F.col("n") <= boundary).mapInPandas(_subsets(boundary, percent), "key long, cls long, n int, rank int, own double")
    keys = lists.where(F.col("n") * 100 >= (boundary + 1) * percent).unionByName(light)
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    blocks = stash(keys.join(several, "key", "left_semi"), "blocks")
    labels = _components(blocks, sets, percent)
    classes = described.where("n > 0").groupBy("cls").agg(F.min("id").alias("class_id"))
    named = classes.join(labels, "cls", "left").withColumn("root", F.coalesce("comp", "cls"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "class_id", "component_id")
    return described.join(named.withColumn("n_", F.lit(1)), (described["cls"] == named["cls"]) & (described["n"] > 0), "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from logmeridian.llm.storage import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
