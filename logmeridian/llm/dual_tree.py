"""Vector code compression: product codebooks fitted by dual-tree Lloyd rounds in integers.

Every vector becomes integers and is cut into equal consecutive parts; each part position has its own
codebook. Rows are packed into blocks, once. A block holds, for each position, a balanced tree over its parts
with the box, the count and the sum of every node. In each round a small tree over the codebook's
entries walks down against the trees of all blocks: where the least distance between a node's box and
an entry node's box is above the greatest distance between the node's box and another entry node's box,
the combination is dropped. A node left with one entry is assigned whole, by its cached sum; leaves that
stay uncertain compare their parts with the entries left, in integers, ties to the lower index. All distances are integers, so the
result is that of plain Lloyd rounds. Per round a task sends one row for each position, entry and component, whatever
its number of vectors; only the codebooks, whose size does not depend on the number of rows, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm.storage import arrow_ready, few_rows_read, one_row_batches, stash, table
from logmeridian.llm.vectors import matrix, whole_vectors

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LEAF = 16
"""Parts in a leaf of a block's tree."""
BLOCK_ROWS = 4096
FEW_LABELS = 10_000
"""Up to so many labels, their totals are broadcast; beyond, they are joined by shuffle."""
SALTS = 16


@dataclass
class Tree:
    """A balanced binary tree: level ``l`` has ``2 ** l`` nodes over equal runs of ``order``."""

    order: np.ndarray
    """Rows in tree order; -1 fills up the last level."""
    low: list[np.ndarray]
    high: list[np.ndarray]
    count: list[np.ndarray]
    total: list[np.ndarray]


def grow(points: np.ndarray, leaf: int) -> Tree:
    """Split runs at the middle of their widest dimension until at most ``leaf`` points are left in each."""
    n, width = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    size = -(-n // (1 << depth)) << depth
    rows = np.minimum(np.arange(size), n - 1)[None]
    real = (np.arange(size) < n)[None]
    for _ in range(depth):
        here = points[rows]
        wide = np.argmax(here.max(axis=1) - here.min(axis=1), axis=1)
        by = np.argsort(np.take_along_axis(here, wide[:, None, None], axis=2)[:, :, 0], axis=1, kind="stable")
        shape = (2 * len(rows), rows.shape[1] // 2)
        rows, real = np.take_along_axis(rows, by, axis=1).reshape(shape), np.take_along_axis(real, by, axis=1).reshape(shape)
    here = points[rows]
    low, high = [here.min(axis=1)], [here.max(axis=1)]
    count, total = [real.sum(axis=1)], [(here * real[:, :, None]).sum(axis=1)]
    for _ in range(depth):
        low.insert(0, low[0].reshape(-1, 2, width).min(axis=1))
        high.insert(0, high[0].reshape(-1, 2, width).max(axis=1))
        count.insert(0, count[0].reshape(-1, 2).sum(axis=1))
        total.insert(0, total[0].reshape(-1, 2, width).sum(axis=1))
    return Tree(np.where(real, rows, -1).ravel(), low, high, count, total)


class EntryTree:
    """Boxes of the nodes of a binary tree over a codebook, halved along the widest dimension down to single entries."""

    def __init__(self, book: np.ndarray):
        nodes, halves, i = [np.arange(len(book))], [], 0
        while i < len(nodes):
            node = nodes[i]
            if len(node) == 1:
                halves.append((i, -1))
            else:
                part = book[node]
                wide = np.argmax(part.max(axis=0) - part.min(axis=0))
                node = node[np.argsort(part[:, wide], kind="stable")]
                halves.append((len(nodes), len(nodes) + 1))
                nodes += [node[: len(node) // 2], node[len(node) // 2 :]]
            i += 1
        self.low = np.array([book[x].min(axis=0) for x in nodes])
        self.high = np.array([book[x].max(axis=0) for x in nodes])
        self.entry = np.array([x[0] if len(x) == 1 else -1 for x in nodes])
        self.halves = np.array(halves)
        """Numbers of both halves; a single entry has itself and -1."""


def _bounds(low: np.ndarray, high: np.ndarray, entry_low: np.ndarray, entry_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between a point of one box and one of another."""
    apart = np.maximum(np.maximum(entry_low - high, low - entry_high), 0)
    across = np.maximum(high - entry_low, entry_high - low)
    return (apart * apart).sum(axis=1), (across * across).sum(axis=1)


def walk(tree: Tree, points: np.ndarray, book: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(counts, sums)`` per entry of the parts nearest to it; fills ``codes`` by row if given."""
    entries = EntryTree(book)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    leaf = len(tree.order) >> (len(tree.low) - 1)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level, last = 0, len(tree.low) - 1
    while len(node):
        least, most = _bounds(tree.low[level][node], tree.high[level][node], entries.low[other], entries.high[other])
        new = np.concatenate([[True], node[1:] != node[:-1]])
        run = np.cumsum(new) - 1
        keep = least <= np.minimum.reduceat(most, np.flatnonzero(new))[run]
        node, other, run = node[keep], other[keep], run[keep]
        alone = (np.bincount(run)[run] == 1) & (entries.entry[other] >= 0)
        whole, e = node[alone], entries.entry[other[alone]]
        np.add.at(counts, e, tree.count[level][whole])
        np.add.at(sums, e, tree.total[level][whole])
        if codes is not None:
            rows = tree.order.reshape(len(tree.low[level]), -1)[whole]
            codes[rows[rows >= 0]] = np.repeat(e, rows.shape[1])[rows.ravel() >= 0]
        node, other = node[~alone], other[~alone]
        if level == last and np.all(entries.entry[other] >= 0):
            break
        # Down in the entries' tree, and in the tree of parts while it goes on.
        halves = entries.halves[other]
        node, other = np.repeat(node, 2)[halves.ravel() >= 0], halves.ravel()[halves.ravel() >= 0]
        if level < last:
            node, other = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([other, other])
            by = np.argsort(node, kind="stable")
            node, other = node[by], other[by]
            level += 1
    if len(node):
        entry = entries.entry[other]
        by = np.lexsort((entry, node))
        node, entry = node[by], entry[by]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        rows = tree.order.reshape(-1, leaf)
        away = points[rows[node]] - book[entry][:, None, :]
        away = (away * away).sum(axis=2)
        nearest = np.minimum.reduceat(away, starts, axis=0)
        lengths = np.diff(np.concatenate([starts, [len(node)]]))
        ties = np.where(away == np.repeat(nearest, lengths, axis=0), entry[:, None], len(book))
        code = np.minimum.reduceat(ties, starts, axis=0).ravel()
        rows = rows[node[starts]].ravel()
        code, rows = code[rows >= 0], rows[rows >= 0]
        counts += np.bincount(code, minlength=len(book))
        np.add.at(sums, code, points[rows])
        if codes is not None:
            codes[rows] = code
    return counts, sums


def _narrow(x: np.ndarray) -> np.ndarray:
    big = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if big < 1 << 15 else np.int32 if big < 1 << 31 else np.int64)


_BLOCK = "n int, rows binary, points binary, kind string, trees array<struct<parts: array<binary>, kinds: array<string>>>"


def _pack(position_width: int, width: int):
    """Rows of a task into blocks with their trees."""

    def block(ids: list[np.ndarray], rows: list[np.ndarray], labels: list[pa.Array]) -> pa.RecordBatch:
        x = np.concatenate(rows)
        points = _narrow(x)
        trees = []
        for at in range(0, width, position_width):
            tree = grow(x[:, at : at + position_width], LEAF)
            parts = [_narrow(a) for a in (tree.order, *(np.concatenate(level) for level in (tree.low, tree.high, tree.count, tree.total)))]
            trees.append({"parts": [p.tobytes() for p in parts], "kinds": [p.dtype.str for p in parts]})
        sink = pa.BufferOutputStream()
        held = pa.record_batch([pa.concat_arrays(ids), pa.concat_arrays(labels)], names=["id", "label"])
        with pa.ipc.new_stream(sink, held.schema) as writer:
            writer.write_batch(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(x)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([points.tobytes()], pa.binary()), pa.array([points.dtype.str]),
             pa.array([trees], pa.list_(pa.struct([("parts", pa.list_(pa.binary())), ("kinds", pa.list_(pa.string()))])))],
            names=["n", "rows", "points", "kind", "trees"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, labels, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                few = batch.slice(at, BLOCK_ROWS)
                if held + few.num_rows > BLOCK_ROWS:
                    yield block(ids, rows, labels)
                    ids, rows, labels, held = [], [], [], 0
                if few.num_rows:
                    ids.append(few.column(0))
                    labels.append(few.column(1))
                    rows.append(matrix(few.column(2), width))
                    held += few.num_rows
        if held:
            yield block(ids, rows, labels)

    return run


def _trees(batch: pa.RecordBatch, i: int, position_width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Tree and points of each position of a packed block."""
    n, kind = batch.column("n")[i].as_py(), batch.column("kind")[i].as_py()
    x = np.frombuffer(batch.column("points")[i].as_buffer(), kind).reshape(n, -1).astype(np.int64)
    for p, held in enumerate(batch.column("trees")[i].as_py()):
        order, low, high, count, total = (np.frombuffer(b, k).astype(np.int64) for b, k in zip(held["parts"], held["kinds"], strict=True))
        levels = [2**d for d in range((len(count) + 1).bit_length() - 1)]
        cuts = np.cumsum(levels)[:-1]
        low, high, total = (np.split(a.reshape(-1, position_width), cuts) for a in (low, high, total))
        yield Tree(order, low, high, np.split(count, cuts), total), x[:, p * position_width : (p + 1) * position_width]


def _gather(books: np.ndarray):
    """Counts and sums of every position, entry and component over the blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, (tree, points) in enumerate(_trees(batch, i, width)):
                    n, total = walk(tree, points, books[p])
                    counts[p] += n
                    sums[p] += total
        at = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(counts.ravel(), width)[at]), pa.array(sums.ravel()[at])], names=["at", "n", "total"])

    return run


def _encode(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])], dtype=object)
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                codes, error = np.zeros((parts, n), np.int64), np.zeros(n, np.int64)
                for p, (tree, points) in enumerate(_trees(batch, i, width)):
                    walk(tree, points, books[p], codes[p])
                    away = points - books[p][codes[p]]
                    error += (away * away).sum(axis=1)
                held = pa.ipc.open_stream(batch.column("rows")[i].as_buffer()).read_all().combine_chunks()
                code = digits[codes].sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [held.column("id").combine_chunks(), held.column("label").combine_chunks(), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    return run


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """``label_error``: the errors of equal labels (nulls together) added up, without gathering a label's rows."""
    totals = stash(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("label_"))
    if totals.count() <= FEW_LABELS:
        return rows.join(F.broadcast(totals), same)
    spread = totals.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    return salted.join(spread, same & (F.col("salt") == F.col("salt_")))


def compress_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` per vector that takes part, and the codebooks (part, entry, component).

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those with
    components so large that a squared distance would not fit a long (16,384 and beyond at 64 components).
    Vectors shorter than the longest, and lengths that ``parts`` does not divide, are filled up with
    zeros. Codebooks start with the rows of the smallest ids (null ids last, equal ids by vector); with fewer rows than
    ``entries``, there are as many entries as rows. Repeated rows count as often as they stand. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_ready(spark)
    rows = whole_vectors(vectors, id_column, vector_column, SCALE, label_column)
    seeds = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-longest // parts)
    books = np.zeros((parts, len(seeds), width), np.int64)
    for e, seed in enumerate(seeds):
        books[:, e] = np.array(seed + [0] * (width * parts - len(seed)), np.int64).reshape(parts, width)
    blocks = stash(rows.mapInArrow(_pack(width, width * parts), _BLOCK), "parts")
    coded = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    with one_row_batches(spark), few_rows_read(spark):
        for _ in range(rounds if seeds else 0):
            found = blocks.mapInArrow(_gather(books), "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            flat = books.ravel()  # a view; entries that got no part stay as they are
            for r in found.collect():  # at most one row for each component of the codebooks
                flat[r["at"]] = r["total"] // r["n"]
        codes = stash(blocks.mapInArrow(_encode(books), coded), "codes")
    return _with_label_errors(codes).select("vec_id", "label", "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_dual_tree_lloyd(spark, sf_dir: str) -> DataFrame:
    out, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def _lloyd_sql() -> str:
    """The rounds written out, one table of assignments and one of entries for each."""
    steps = [
        f"""kept AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {PARTS}) AS p, (i - 1) % (n // {PARTS}) AS j, floor({SCALE} * v::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM kept))""",
        f"""c0 AS MATERIALIZED (SELECT p, e, j, x AS y FROM x
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT vec_id, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (p, j) GROUP BY ALL)""")
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(z, y) AS y FROM c{r} LEFT JOIN
  (SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS z FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL) USING (p, e, j))""")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


OP13_SQL = _lloyd_sql()
