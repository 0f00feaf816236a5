"""Hard-negative mining by coordinate pruning: length buckets, sorted coordinate lists, feasible ranges.

Rows are integer vectors. Those of similar length form a bucket, and a bucket is dealt over blocks of bounded
size by a hash. An anchor is sent to every block whose longest row could reach the score it still needs. A block goes through its
runs of rows from the longest on. An anchor that needs the score ``s`` can find it in a run only
at rows whose angle to it has at least the cosine ``s / (anchor length x longest row)``; that bounds the unit rows' value in
each coordinate. Binary search in the sorted lists of the anchor's focus coordinates (its largest) gives the rows in
each range, and only rows in all ranges are verified by their integer inner product; where the ranges hold most
of a run, the whole run is verified by one matrix product. What an anchor needs rises with what it found,
within the block: the fifth best positive, or the third best negative of each score band.

Two searches of this kind follow each other, for positives and then for negatives in the bands that the positives'
scores define. Blocks return their best, and the best of all blocks are ranked per anchor, or per anchor and
positive. Nothing is sampled or capped: the result is exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmeridian.llm.storage import arrow_ready, shuffle_width, stash, table
from logmeridian.llm.vectors import matrix, whole_vectors

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
BUCKET_RATIO = 1.1
"""Greatest length in a bucket over the least."""
MOST_ROWS, LEAST_ROWS = 1 << 16, 512
"""Rows of a block: at most so many; at least so many before another block is opened to keep all cores busy."""
RUN = 2048
"""Rows of a block that share one set of sorted lists."""
FOCUS = 4
"""Coordinates whose ranges are intersected."""
FEW = 0.25
"""Share of a run below which the narrowest range makes the lists worth reading."""
ANCHORS_AT_ONCE = 128
SLACK = 1e-9

Best = dict[str, np.ndarray]


class Run:
    """Rows of similar length, ordered by id, with lists of their unit coordinates sorted when first needed."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[by], labels[by], rows[by]
        lengths = np.sqrt((self.rows.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(lengths.max())
        self.unit = self.rows / np.maximum(lengths, 1e-300)[:, None]
        self.least, self.most = self.unit.min(axis=0), self.unit.max(axis=0)
        self.whole = bool(lengths.min() > 0)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        big = float(np.abs(self.rows).max(initial=0))
        self.big = big

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = (self.unit[order, f], order)
        return self._lists[f]

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Integer inner products; floats only where they hold every partial sum exactly."""
        top = float(np.abs(anchors).max(initial=0)) * self.big * self.rows.shape[1]
        kind = np.float32 if top < 2.0**24 else np.float64 if top < 2.0**53 else np.int64
        return (anchors.astype(kind) @ self.rows.T.astype(kind)).astype(np.int64)


def feasible(unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of a unit row's coordinates if its cosine with ``unit`` is at least ``cosine`` (per row of ``unit``)."""
    angle = np.arccos(np.clip(cosine, -1, 1))[:, None]
    own = np.arccos(np.clip(unit, -1, 1))
    return np.cos(np.minimum(own + angle, np.pi)) - SLACK, np.cos(np.maximum(own - angle, 0)) + SLACK


def candidates(run: Run, anchors: np.ndarray, lengths: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """``(anchor numbers, rows)``: rows are None for anchors that compare with the whole run."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(lengths * run.longest > 0, need / (lengths * run.longest), np.where(need > 0, 2.0, -1.0))
    cosine = np.where(need <= 0, -1.0, cosine)
    able = np.flatnonzero(cosine <= 1 + SLACK)
    pruned = []
    if run.whole:
        tight = able[cosine[able] > 0]
        unit = anchors[tight] / np.maximum(lengths[tight], 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        low, high = feasible(np.take_along_axis(unit, focus, axis=1), cosine[tight])
        cuts = ((low > run.least[focus]) | (high < run.most[focus])).any(axis=1)
        for i in np.flatnonzero(cuts).tolist():
            spans = []
            for f, a, b in zip(focus[i].tolist(), low[i].tolist(), high[i].tolist(), strict=True):
                values, order = run.sorted_list(f)
                spans.append(order[np.searchsorted(values, a, "left") : np.searchsorted(values, b, "right")])
            spans.sort(key=len)
            if len(spans[0]) <= FEW * len(run.ids):
                times = np.zeros(len(run.ids), np.int8)
                for span in spans:
                    times[span] += 1
                pruned.append(tight[i])
                yield tight[i : i + 1], np.flatnonzero(times == len(spans))
    rest = np.setdiff1d(able, np.array(pruned, np.int64), assume_unique=True)
    if len(rest):
        yield rest, None


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each group, by score, then smaller id."""
    by = np.lexsort((ids, -score, group))
    ordered = group[by]
    place = np.arange(len(by)) - np.searchsorted(ordered, ordered, "left")
    return by[place < k]


class Found:
    """The best found so far for ``n`` groups, and the score that a group still needs."""

    def __init__(self, floor: np.ndarray, k: int):
        self.need, self.k = floor.copy(), k
        self.group, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = _top(group, score, ids, self.k)
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]
        full = np.bincount(self.group, minlength=len(self.need)) >= self.k
        worst = np.full(len(self.need), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.group, self.score)
        self.need[full] = np.maximum(self.need[full], worst[full])


def _positives(runs: list[Run], ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, bands: None) -> Iterator[tuple[np.ndarray, ...]]:
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    found = Found(np.full(len(ids), np.iinfo(np.int64).min), POSITIVES)
    for run in runs:
        for few, rows in candidates(run, anchors, lengths, found.need.astype(np.float64)):
            at = np.arange(len(run.ids)) if rows is None else rows
            score = run.products(anchors[few]) if rows is None else (anchors[few] @ run.rows[at].T)
            fits = (run.labels[at][None] == labels[few][:, None]) & (run.ids[at][None] != ids[few][:, None]) & (score >= found.need[few][:, None])
            a, b = np.nonzero(fits)
            found.add(few[a], score[a, b], run.ids[at][b])
    yield found.group, np.zeros(len(found.group), np.int64), np.zeros(len(found.group), np.int64), found.ids, found.score


def _negatives(runs: list[Run], ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, bands: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """``bands`` holds per anchor rows of (positive id, its score); groups are the bands of all anchors in a row."""
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    owner = np.repeat(np.arange(len(ids)), [len(b) for b in bands])
    band = np.concatenate(bands) if bands else np.empty((0, 2), np.int64)
    low, high = -((-LOW_PERCENT * band[:, 1]) // 100), HIGH_PERCENT * band[:, 1] // 100
    found = Found(low, NEGATIVES)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    none = np.iinfo(np.int64).max
    for run in runs:
        need = np.full(len(ids), float(none))
        open_ = np.where(found.need <= high, found.need, none)
        if len(starts):
            need[owner[starts]] = np.minimum.reduceat(open_, starts)
        for few, rows in candidates(run, anchors, lengths, need):
            at = np.arange(len(run.ids)) if rows is None else rows
            score = run.products(anchors[few]) if rows is None else (anchors[few] @ run.rows[at].T)
            place = np.full(len(ids), -1)
            place[few] = np.arange(len(few))
            other = run.labels[at][None] != labels[few][:, None]
            a, b = np.nonzero(other & (score >= need[few][:, None]))
            a_score = score[a, b]
            first, last = np.searchsorted(owner, few, "left"), np.searchsorted(owner, few, "right")
            for j in range(int((last - first).max(initial=0))):
                g = first[a] + j
                inside = g < last[a]
                g = np.minimum(g, max(0, len(band) - 1))
                inside &= (a_score >= found.need[g]) & (a_score <= high[g])
                found.add(g[inside], a_score[inside], run.ids[at][b[inside]])
    yield owner[found.group], band[found.group, 0], band[found.group, 1], found.ids, found.score


def _search(width: int, look: Callable) -> Callable:
    """Rows of a block come first, its anchors after them, as they stand in the sorted partition."""

    def runs_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Run]:
        if not held:
            return []
        ids, labels, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        return [Run(ids[c], labels[c], rows[c]) for c in np.split(by, range(RUN, len(by), RUN))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, runs = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            keys, ids, labels = (batch.column(name).to_numpy() for name in ("key", "id", "code"))
            rows = matrix(batch.column("v"), width)
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(blocks)], strict=True):
                if blocks[a] != block:
                    block, held, runs = blocks[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], labels[a:b], rows[a:b]))
                    continue
                if runs is None:
                    runs, held = runs_of(held), []
                for c in range(a, b, ANCHORS_AT_ONCE):
                    d = min(b, c + ANCHORS_AT_ONCE)
                    bands = [np.array(x, np.int64).reshape(-1, 2) for x in batch.column("bands").slice(c, d - c).to_pylist()]
                    for out in look(runs, ids[c:d], labels[c:d], rows[c:d], bands):
                        out = (keys[c:d][out[0]], ids[c:d][out[0]], *out[1:])
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "anchor", "positive", "positive_score", "found", "score"])

    return run


def _blocks(entries: DataFrame, width: int) -> list[dict]:
    """Length buckets as ``bucket, first, blocks, longest``: some hundred at most, whatever the number of rows."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy("bucket").collect()
    total = sum(r["n"] for r in sizes)
    rows = min(MOST_ROWS, max(LEAST_ROWS, -(-total // max(1, 2 * width))))
    out, first = [], 0
    for r in sizes:
        blocks = -(-r["n"] // rows)
        out.append({"bucket": r["bucket"], "first": first, "blocks": blocks, "longest": r["longest"]})
        first += blocks
    return out


def _sent(anchors: DataFrame, buckets: list[dict], need: str) -> DataFrame:
    """Each anchor once for every block of the buckets that can reach the score it needs."""
    able = F.expr(need) <= F.col("length") * F.col("longest") * (1 + 1e-6) + 1
    reach = F.from_json(F.lit(json.dumps(buckets)), "array<struct<bucket: int, first: int, blocks: int, longest: double>>")
    return (
        anchors.withColumn("to", F.explode(reach)).select("*", "to.first", "to.blocks", "to.longest").where(able)
        .withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    )


_ROW = ["block", "kind", "key", "id", "code", "v", "bands"]


def _look(entries: DataFrame, sent: DataFrame, width: int, look: Callable) -> DataFrame:
    both = entries.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "id", "code", "v", F.array().cast("array<long>").alias("bands")).unionByName(sent.select("block", F.lit(1).alias("kind"), *_ROW[2:]))
    dealt = both.repartition(shuffle_width(entries.sparkSession), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_search(width, look), "key long, anchor long, positive long, positive_score long, found long, score long")


def mine_hard_negatives(vectors: DataFrame, anchors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` has the columns of ``vectors``, and its rows are looked up among them. Rows with a null id, label or vector, an
    empty vector, or a null or non-finite component take no part, nor do components so large that a score
    would not fit a long (262,144 and beyond at 64 components). Shorter vectors are filled up with zeros. Rows equal in id,
    label and vector count once; anchors that share an id are searched apart; a row with the anchor's own id is never its positive. An anchor without
    positives, or a positive without negatives in its band, has no rows; neither has a negative positive score, whose
    band is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_ready(spark)
    width_of_shuffle = shuffle_width(spark)

    def whole(df: DataFrame) -> DataFrame:
        rows = whole_vectors(df, id_column, vector_column, SCALE, label_column).where("id is not null and label is not null")
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(BUCKET_RATIO)))).otherwise(-1).cast("int")
        return rows.withColumn("code", F.xxhash64("label")).select("id", "code", "v").distinct().withColumn("length", length).withColumn("bucket", bucket)

    rows = stash(whole(vectors), "rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    buckets = _blocks(rows, width_of_shuffle)
    known = spark.createDataFrame([(b["bucket"], b["first"], b["blocks"]) for b in buckets], "bucket int, first int, blocks int")
    entries = rows.join(F.broadcast(known), "bucket").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("blocks"))).cast("int"))
    asked = stash(whole(anchors).withColumn("key", F.xxhash64("id", "code", "v")).withColumn("bands", F.array().cast("array<long>")), "anchors")

    best = Window.partitionBy("key").orderBy(F.desc("score"), "found")
    positives = stash(
        _look(entries, _sent(asked, buckets, "0"), width, _positives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POSITIVES).select("key", "found", "score"), "positives"
    )
    banded = positives.where("score >= 0").groupBy("key").agg(F.flatten(F.sort_array(F.collect_set(F.array("found", "score")))).alias("bands"), F.min("score").alias("least"))
    wanted = asked.drop("bands").join(banded, "key")
    each = Window.partitionBy("key", "positive", "positive_score").orderBy(F.desc("score"), "found")
    found = _look(entries, _sent(wanted, buckets, f"least * {LOW_PERCENT / 100}"), width, _negatives).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= NEGATIVES)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.id AS anchor, r.id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.id % 50 = 0 AND r.id <> a.id
), p AS (
  SELECT anchor, id AS positive, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor AS anchor_id, positive AS positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
