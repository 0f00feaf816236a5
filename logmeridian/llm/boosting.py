"""Small gradient boosting of shallow regression trees on binned features (logistic loss), on arrays or on a table of any size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm.storage import stash

ROUNDS, DEPTH, BINS, RATE, PENALTY, LEAST = 40, 3, 32, 0.2, 1.0, 10
SCALE = 2.0**20
"""Gradients of tables are summed as whole multiples of its inverse, so that sums do not depend on how rows are dealt."""


@dataclass
class Spread:
    """A column of a table of examples (``x`` array<double>, ``label`` boolean)."""

    table: DataFrame
    name: str

    def tolist(self) -> list:
        return [r[0] for r in self.table.orderBy("x", "label").select(self.name).collect()]


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    """Per tree: split feature and bin of the inner nodes in heap order, and the leaf values."""
    start: float

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if len(x):
            bins = self._bins(x)
            for tree in self.trees:
                out += tree[2][_leaf(bins, tree)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _leaf(bins: np.ndarray, tree: tuple) -> np.ndarray:
    feature, cut, _ = tree
    node = np.zeros(len(bins), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def _start(share: float) -> float:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _better(j: int, sums: list[np.ndarray], best: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The best gain of each node, with ``feature`` and ``cut`` where feature ``j`` is better; ``sums`` run over its bins."""
    gs, hs, ns = sums
    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
    gain = gs**2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt**2 / (ht + PENALTY)
    gain = np.where((ns >= LEAST) & (nt - ns >= LEAST), gain, 0)
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(at)), at]
    better = top > best + 1e-9
    feature[better] = j
    cut[better] = at[better]
    return np.where(better, top, best)


def _down(node: np.ndarray, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])


def fit(x: np.ndarray | Spread, y: np.ndarray | Spread) -> Boosted:
    """Trees for labels 0/1. The result depends on the set of rows, not on their order."""
    if isinstance(x, Spread):
        return _fit_spread(x.table)
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    model = Boosted(cuts, [], _start(y.mean() if len(y) else 0.5))
    if len(np.unique(y)) < 2:
        return model
    bins = model._bins(x)
    margin = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j in range(x.shape[1]):
                cell = (node - base) * (BINS + 1) + bins[:, j]
                sums = [np.bincount(cell, weights=w, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                best = _better(j, sums, best, feature[base : base + width], cut[base : base + width])
            node = _down(node, bins, feature, cut)
        leaf = node - (2**DEPTH - 1)
        gs, hs = (np.bincount(leaf, weights=w, minlength=2**DEPTH) for w in (g, h))
        value = RATE * gs / (hs + PENALTY)
        model.trees.append((feature, cut, value))
        margin += value[leaf]
    return model


def _fit_spread(table: DataFrame) -> Boosted:
    """The same trees from a table: exact quantiles, equal binned rows counted, and one job for the histograms of each level of a tree."""
    values = table.select(F.posexplode("x").alias("j", "v")).groupBy("j", "v").count()
    shares = [float(q) for q in np.linspace(0, 1, BINS)[1:-1]]
    found = values.groupBy("j").agg(F.percentile("v", shares, F.col("count")).alias("q")).collect()
    cuts = [np.unique(r["q"]) for r in sorted(found, key=lambda r: r["j"])]
    total, share = table.agg(F.count(F.lit(1)), F.avg(F.col("label").cast("double"))).first()
    model = Boosted(cuts, [], _start(share if total else 0.5))
    if not total or share in (0, 1):
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in model._bins(x).astype(np.uint8)], pa.binary()), batch.column(1)], names=["bins", "label"])

    empty = Boosted(cuts, [], model.start)
    cells = stash(table.select("x", "label").mapInArrow(binned, "bins binary, label boolean").groupBy("bins", "label").count(), "cells")
    features = len(cuts)
    for _ in range(ROUNDS):
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            gs, hs, ns = _histograms(cells, empty.start, list(model.trees), feature.copy(), cut.copy(), level, features)
            best = np.zeros(width)
            for j in range(features):
                best = _better(j, [gs[j], hs[j], ns[j]], best, feature[base : base + width], cut[base : base + width])
        at = np.arange(width)
        j, c = feature[base : base + width], cut[base : base + width]
        sides = [np.stack([s[j, at, c], s[j, at, -1] - s[j, at, c]], axis=1).ravel() for s in (gs, hs)]
        model.trees.append((feature, cut, RATE * sides[0] / (sides[1] + PENALTY)))
    return model


def _histograms(cells: DataFrame, start: float, trees: list, feature: np.ndarray, cut: np.ndarray, level: int, features: int) -> np.ndarray:
    """Running sums over the bins of gradients, curvatures and counts, by feature and node of one level of the tree that grows."""
    base, width = 2**level - 1, 2**level
    size = features * width * (BINS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, features).astype(np.int64)
            y, n = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy()
            margin = np.full(len(y), start)
            for tree in trees:
                margin += tree[2][_leaf(bins, tree)]
            p = 1 / (1 + np.exp(-margin))
            node = np.zeros(len(y), np.int64)
            for _ in range(level):
                node = _down(node, bins, feature, cut)
            weights = [np.rint((y - p) * SCALE) * n, np.rint(p * (1 - p) * SCALE) * n, n]
            for j in range(features):
                cell = (node - base) * (BINS + 1) + bins[:, j]
                part = slice(j * width * (BINS + 1), (j + 1) * width * (BINS + 1))
                for k, w in enumerate(weights):
                    sums[k, part] += np.bincount(cell, weights=w, minlength=width * (BINS + 1))
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(s[used].astype(np.int64)) for s in sums)], names=["at", "g", "h", "n"])

    out = np.zeros((3, size))
    for r in cells.mapInArrow(run, "at long, g long, h long, n long").groupBy("at").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
        out[:, r[0]] = r[1] / SCALE, r[2] / SCALE, r[3]
    return out.reshape(3, features, width, BINS + 1).cumsum(axis=3)
