"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

A node that is to become ``s`` shards is cut along its widest dimension so that ``floor(s / 2)`` of its
``s`` parts of bytes fall left; all nodes of a level are cut together. A cut position is found by
histograms: sums of bytes per interval of the key come from Spark, the interval with the wanted sum is
divided again until what is left in it does not matter. The dimensions are the size of the text, its bytes per
character (which tells scripts apart), its number of lines and the length of its words, each on a logarithmic scale; the widest is that
which spans the greatest part of its range over all rows. They depend on the text alone and ties are
ordered by its checksum, so equal texts stay together, except where a cut has to go through a group
of equal texts too heavy for that; there it goes by a hash of the row. Language and source are no dimensions: copies of
a text may differ in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmeridian.llm.storage import shuffle_width, stash, table

OVERHEAD = 16
BIN_BITS = 13
TOLERANCE = 0.0005
"""Share of a shard's bytes that may stay on either side of a cut."""
KEY_BITS = 62
DIMENSIONS = 4


def _scaled(column: Column, bits: int = 30) -> Column:
    """A non-negative number on a logarithmic scale of ``bits`` bits, so that wide ranges can be compared."""
    return F.least(F.floor(F.log2(column.cast("double") + 1) * (2.0**bits / 40)), F.lit(2**bits - 1)).cast("long")


def _points(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long")
    crc = F.crc32(F.encode(text, "UTF-8"))
    per_char = F.coalesce(F.try_divide(F.octet_length(text) * 1000, F.length(text)), F.lit(0)).cast("long")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    per_word = (F.length(text) * 1000 / (lines + spaces + 1)).cast("long")
    mixed = F.shiftrightunsigned(F.xxhash64(id_column), 33).cast("long")
    return docs.select(
        F.col(id_column).alias("id"), (size + OVERHEAD).alias("size"), crc.alias("crc"), _scaled(size).alias("d0"), _scaled(per_char).alias("d1"),
        _scaled(lines).alias("d2"), _scaled(per_word).alias("d3"), mixed.alias("mixed"), F.monotonically_increasing_id().alias("row"),
    )


def _of_node(values: dict[int, int]) -> Column:
    """The value kept for a row's node; null for other nodes."""
    pairs = [x for node, value in sorted(values.items()) for x in (F.lit(node), F.lit(value).cast("long"))]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _node_key(dimension: dict[int, int]) -> Column:
    """The sort key along the node's dimension: the scaled value, then the checksum of the text."""
    value = F.when(F.lit(False), F.col("d0"))
    for j in sorted(set(dimension.values())):
        value = value.when(F.col("node").isin(sorted(n for n, d in dimension.items() if d == j)), F.col(f"d{j}"))
    return F.shiftleft(value, 32).bitwiseOR(F.col("crc"))


def _tie_key() -> Column:
    return F.shiftleft(F.col("mixed"), 31).bitwiseOR(F.col("low_row"))


def _cuts(points: DataFrame, wanted: dict[int, tuple[int, float]], slack: float, tie: bool) -> dict[int, tuple[int, float, float]]:
    """Per node the key at which the wanted bytes are left of it, the bytes left, and the bytes at that key.

    ``wanted`` is ``node -> (dimension, bytes)``. Every pass sums the bytes of ``2**BIN_BITS`` intervals of
    what is left of each node, so what the driver gets has a fixed bound.
    """
    low = dict.fromkeys(wanted, 0)
    left = dict.fromkeys(wanted, 0.0)
    inside: dict[int, float] = {}
    shift = KEY_BITS
    open_ = set(wanted)
    while open_ and shift > 0:
        before, shift = shift, max(0, shift - BIN_BITS)
        rows = points.where(F.col("node").isin(sorted(open_)))
        key = _tie_key() if tie else _node_key({node: wanted[node][0] for node in open_})
        rows = rows.select("node", "size", (key - _of_node({node: low[node] for node in open_})).alias("k")).where((F.col("k") >= 0) & (F.col("k") < F.lit(2**before)))
        sums = rows.groupBy("node", F.shiftright("k", shift).alias("bin")).agg(F.sum("size").alias("b")).collect()
        bins: dict[int, list[tuple[int, int]]] = {node: [] for node in open_}
        for r in sums:
            bins[r["node"]].append((r["bin"], r["b"]))
        for node in sorted(open_):
            target = wanted[node][1]
            for at, weight in sorted(bins[node]):
                inside[node] = float(weight)
                low_at = low[node] + (at << shift)
                if left[node] + weight >= target:
                    break
                left[node] += weight
            else:
                low_at, inside[node] = low[node] + (1 << before), 0.0
            low[node] = low_at
            if inside[node] <= slack or shift == 0:
                open_.discard(node)
                if inside[node] <= slack and target - left[node] > inside[node] / 2:
                    low[node] += 1 << shift
                    left[node], inside[node] = left[node] + inside[node], 0.0
    return {node: (low[node], left[node], inside.get(node, 0.0)) for node in wanted}


def kd_shards(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Sizes are UTF-8 bytes plus 16, a null text counting as empty. Shards have nearly equal bytes as far
    as single rows allow; a shard can be empty only if there are fewer rows than shards. Null and
    repeated ids keep their rows. Slots count from 0 within a shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    now = stash(
        _points(docs, id_column, text_column).withColumn("low_row", F.shiftrightunsigned(F.xxhash64("row"), 33).cast("long"))
        .withColumn("node", F.lit(0)), "points",
    )
    spans = {0: (0, shards)}
    total = float(now.agg(F.sum("size")).first()[0] or 0)
    slack = TOLERANCE * total / shards
    whole: list[int] = []
    while any(b - a > 1 for a, b in spans.values()):
        stats = now.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(f"d{j}").alias(f"a{j}") for j in range(DIMENSIONS)], *[F.max(f"d{j}").alias(f"b{j}") for j in range(DIMENSIONS)])
        at = {r["node"]: r for r in stats.collect()}
        wide = lambda r, j: (r[f"b{j}"] or 0) - (r[f"a{j}"] or 0)
        whole = whole or [max(1, wide(at[0], j)) for j in range(DIMENSIONS)] if 0 in at or whole else [1] * DIMENSIONS
        wanted = {}
        for node, (a, b) in spans.items():
            if b - a > 1 and node in at:
                r = at[node]
                widest = max(range(DIMENSIONS), key=lambda j: (wide(r, j) / whole[j], -j))
                wanted[node] = (widest, r["w"] * ((b - a) // 2) / (b - a))
        first = _cuts(now, wanted, slack, tie=False)
        heavy = {n: c for n, c in first.items() if c[2] > slack}
        second: dict[int, tuple[int, float, float]] = {}
        if heavy:
            dims = {n: wanted[n][0] for n in heavy}
            same = _node_key(dims) == _of_node({n: heavy[n][0] for n in heavy})
            second = _cuts(now.where(same), {n: (dims[n], wanted[n][1] - heavy[n][1]) for n in heavy}, slack, tie=True)
        left, fresh = F.lit(True), {}
        if first:
            key, cut = _node_key({n: wanted[n][0] for n in first}), _of_node({n: first[n][0] for n in first})
            left = key < cut
            if second:
                left = left | ((key == cut) & (_tie_key() < _of_node({n: second[n][0] for n in second})))
        label = F.col("node") * 2 + F.when(F.coalesce(left, F.lit(True)), 1).otherwise(2)
        for node, (a, b) in spans.items():
            if b - a == 1:
                fresh[2 * node + 1] = (a, b)
            else:
                fresh[2 * node + 1], fresh[2 * node + 2] = (a, a + (b - a) // 2), (a + (b - a) // 2, b)
        now, spans = stash(now.withColumn("node", label.cast("int")), "kd"), fresh
    shard = _of_node({node: a for node, (a, _) in spans.items()}).cast("int")
    return _slots(now.withColumn("shard", shard), shuffle_width(spark)).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def _slots(rows: DataFrame, parts: int) -> DataFrame:
    """Gapless numbers within each shard: a shard is numbered in parts, shifted by the counts before them."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return rows.withColumn("number", number).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("number") + F.col("offset")).cast("long"))


def op6_kd_sharding(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
