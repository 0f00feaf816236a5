"""Templates of masked messages: mined in tasks, merged, with ids that never change.

Signatures are cut into tokens at spaces. Those of one source class, number of tokens and first tokens stand in one
leaf of a tree of fixed depth. In a leaf, a signature joins the template that agrees with it in the greatest share
of tokens, if that is at least ``similarity``; tokens that differ become wildcards. A leaf with many
signatures is dealt into bounded parts by a hash; the templates of the parts are then merged by the same rule, some parts
at a time, until the leaf is whole. Every step takes its rows in an order of their own (known ids, then size, then
text), so neither partitions nor repeated tasks change the result.

Templates known from earlier runs enter first and keep their ids, also when they become more general; new ones get ids beyond the
greatest of their source class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.catalog.masks import MASKS
from logmeridian.operators.ordering import numbered
from logmeridian.session import cut_lineage

WILDCARD = "<*>"
SIMILARITY = 0.4
DEPTH = 4
"""Levels of the tree: the root, the number of tokens, ``DEPTH - 3`` first tokens, and the leaf."""
MAX_CHILDREN = 100
PART = 4096
"""Signatures of a leaf that one task groups at once, on average."""
FAN_IN = 8
MOST_TEMPLATES = 5000
"""Parts of a leaf whose templates together are more than this stay apart: so many unlike templates are noise."""

TEMPLATES = "template_id string, source_class string, cluster_id long, template string, size long, mask_names array<string>, is_new boolean"
_LEAF = ["source_class", "length", "path"]
_ROWS = "source_class string, length int, path string, part int, known long, tokens array<string>, size long"


class Groups:
    """Templates of one leaf: rows of token numbers, compared all at once."""

    def __init__(self, width: int, similarity: float):
        self.width, self.similarity = width, similarity
        self.tokens: dict[str, int] = {WILDCARD: 0}
        self.rows = np.zeros((16, width), np.int64)
        self.size: list[int] = []
        self.known: list[int | None] = []

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.tokens.setdefault(t, len(self.tokens)) for t in tokens], np.int64)

    def add(self, tokens: list[str], size: int, known: int | None) -> None:
        row, n = self.numbers(tokens), len(self.size)
        if known is None and n:
            here = self.rows[:n]
            equal = ((here == row) & (here != 0)).sum(axis=1)
            wild = (here == 0).sum(axis=1)
            best = int(np.lexsort((np.arange(n), -wild, -equal))[0])
            if equal[best] >= self.similarity * self.width:
                self.rows[best] = np.where(here[best] == row, row, 0)
                self.size[best] += size
                return
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = row
        self.size.append(size)
        self.known.append(known)

    def templates(self) -> list[list[str]]:
        names = list(self.tokens)
        return [[names[t] for t in row] for row in self.rows[: len(self.size)].tolist()]


def _in_order(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: (r["known"] is None, r["known"] or 0, -r["size"], r["tokens"]))


def _grouped(similarity: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        ordered = _in_order(rows)
        groups = Groups(ordered[0]["length"], similarity)
        for r in ordered:
            groups.add(r["tokens"], r["size"], r["known"])
        n = len(groups.size)
        same = {c: pa.array([ordered[0][c]] * n, rows.schema.field(c).type) for c in (*_LEAF, "part")}
        return pa.table({**same, "known": pa.array(groups.known, pa.int64()), "tokens": pa.array(groups.templates(), pa.list_(pa.string())), "size": pa.array(groups.size, pa.int64())})

    return run


def _tokens(signature: Column) -> Column:
    return F.filter(F.split(signature, " +"), lambda t: t != "")


def _path(tokens: Column, levels: int) -> Column:
    """The first tokens as text, at most one less than there are."""
    return F.array_join(F.slice(tokens, 1, F.least(F.lit(levels), F.size(tokens) - 1)), " ")


def _leaves(rows: DataFrame, children: DataFrame, levels: int) -> DataFrame:
    """``path``: the first tokens if their node is one of the tree's children, else the wildcard's."""
    named = rows.withColumn("length", F.size("tokens")).withColumn("first", _path(F.col("tokens"), levels))
    kept = children.withColumn("kept", F.lit(True))
    return named.join(kept, ["source_class", "length", "first"], "left").withColumn("path", F.when(F.col("kept"), F.col("first")).otherwise(WILDCARD)).drop("first", "kept")


def _children(rows: DataFrame, levels: int, most: int) -> DataFrame:
    """Per source class and number of tokens the most frequent first tokens; those of known templates come first."""
    first = rows.groupBy("source_class", F.size("tokens").alias("length"), _path(F.col("tokens"), levels).alias("first")).agg(F.min("known").alias("known"), F.sum("size").alias("n"))
    order = Window.partitionBy("source_class", "length").orderBy(F.col("known").asc_nulls_last(), F.desc("n"), "first")
    return first.filter(F.col("first") != WILDCARD).withColumn("child", F.row_number().over(order)).filter(F.col("child") < most).select("source_class", "length", "first")


def mine_templates(
    signatures: DataFrame, known: DataFrame | None = None, similarity: float = SIMILARITY, depth: int = DEPTH, max_children: int = MAX_CHILDREN
) -> DataFrame:
    """``TEMPLATES`` of ``source_class, signature, n`` rows (masked texts with their counts) and of those ``known`` before.

    A node has at most ``max_children`` children, the last of them for all other first tokens. ``size`` adds what earlier runs
    counted. Null or blank signatures, and null classes, have no template; a signature that repeats is counted together. Without
    any signature the known templates come back as they were.
    """
    spark = signatures.sparkSession
    levels = max(0, depth - 3)
    new = (
        signatures.select("source_class", _tokens(F.col("signature")).alias("tokens"), F.col("n").cast("long").alias("n"))
        .filter("source_class IS NOT NULL AND tokens IS NOT NULL AND size(tokens) > 0")
        .groupBy("source_class", "tokens").agg(F.sum("n").alias("size")).withColumn("known", F.lit(None).cast("long"))
    )
    before = known if known is not None else spark.createDataFrame([], TEMPLATES)
    old = before.select("source_class", F.split("template", " ").alias("tokens"), "size", F.col("cluster_id").alias("known"))
    rows = cut_lineage(old.unionByName(new))
    leaves = _leaves(rows, _children(rows, levels, max_children), levels)
    parts = leaves.groupBy(*_LEAF).agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.lit(1)).cast("int").alias("parts"))
    text = F.array_join("tokens", " ")
    # Known templates of a leaf stand in its first part, from which they spread by the merge.
    dealt = leaves.join(parts, _LEAF).withColumn("part", F.when(F.col("known").isNull(), F.pmod(F.xxhash64(text), F.col("parts"))).otherwise(0).cast("int"))
    fields = [c.split(" ")[0] for c in _ROWS.split(", ")]
    found = cut_lineage(dealt.select(fields).groupBy(*_LEAF, "part").applyInArrow(_grouped(similarity), _ROWS))
    most = found.agg(F.max("part")).first()[0] or 0
    while most > 0:
        together = found.withColumn("next", F.floor(F.col("part") / FAN_IN).cast("int"))
        counts = together.groupBy(*_LEAF, "next").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("several")).filter(f"several > 1 AND n <= {MOST_TEMPLATES}")
        sized = together.join(counts.select(*_LEAF, "next", F.lit(True).alias("merge")), [*_LEAF, "next"], "left")
        merged = sized.filter("merge").drop("part", "merge").withColumnRenamed("next", "part").select(fields).groupBy(*_LEAF, "part").applyInArrow(_grouped(similarity), _ROWS)
        apart = sized.filter("merge IS NULL").drop("part", "merge").withColumnRenamed("next", "part").select(fields)
        found = cut_lineage(merged.unionByName(apart))
        most //= FAN_IN
    return _with_ids(found, before)


def _with_ids(found: DataFrame, before: DataFrame) -> DataFrame:
    """Known numbers stay; new templates follow, by number of tokens, path and text, after the greatest of their class."""
    template = F.array_join("tokens", " ")
    new = found.filter("known IS NULL").groupBy("source_class", template.alias("template"), "length", "path").agg(F.sum("size").alias("size"))
    placed = numbered(new, "place", F.col("source_class"), F.col("length"), F.col("path"), F.col("template"))
    least = placed.groupBy("source_class").agg((F.min("place") - 1).alias("least"))
    greatest = before.groupBy("source_class").agg(F.max("cluster_id").alias("greatest"))
    fresh = placed.join(least, "source_class").join(greatest, "source_class", "left").withColumn("cluster_id", F.col("place") - F.col("least") + F.coalesce("greatest", F.lit(0)))
    kept = found.filter("known IS NOT NULL").select("source_class", template.alias("template"), "size", F.col("known").alias("cluster_id"), F.lit(False).alias("is_new"))
    both = kept.unionByName(fresh.select("source_class", "template", "size", "cluster_id", F.lit(True).alias("is_new")))
    names = F.array(*[F.lit(name) for name, *_ in MASKS])
    return both.select(
        F.concat_ws(":", "source_class", "cluster_id").alias("template_id"), "source_class", F.col("cluster_id").cast("long").alias("cluster_id"), "template", "size",
        F.array_distinct(F.filter(names, lambda n: F.contains(F.col("template"), F.concat(F.lit("<"), n, F.lit(">"))))).alias("mask_names"), "is_new",
    )


def _matching(signatures: pa.Table, templates: pa.Table) -> pa.Table:
    """The template with fewest wildcards, then the smaller number, that agrees with each signature in all its other tokens."""
    out, wanted = [], signatures.to_pylist()
    known = sorted(templates.to_pylist(), key=lambda t: (t["tokens"].count(WILDCARD), t["cluster_id"]))
    if wanted and known:
        numbers: dict[str, int] = {WILDCARD: 0}
        number = lambda tokens: [numbers.setdefault(t, len(numbers)) for t in tokens]
        rows = np.array([number(t["tokens"]) for t in known])
        for s in wanted:
            fits = ((rows == np.array(number(s["tokens"]))) | (rows == 0)).all(axis=1)
            if fits.any():
                out.append((s["source_class"], s["signature"], known[int(fits.argmax())]["template_id"]))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, pa.string()) for c in columns], names=["source_class", "signature", "template_id"])


def match_templates(signatures: DataFrame, templates: DataFrame) -> DataFrame:
    """``source_class, signature, template_id`` of the distinct signatures that some template covers.

    Templates are looked up among those of the same class, number of tokens and first token, or with a wildcard first.
    """
    rows = signatures.select("source_class", "signature", _tokens(F.col("signature")).alias("tokens")).filter("source_class IS NOT NULL AND size(tokens) > 0").distinct()
    rows = rows.withColumn("length", F.size("tokens")).withColumn("first", F.explode(F.array(F.col("tokens")[0], F.lit(WILDCARD)))).withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(FAN_IN)))
    all_ = templates.select("source_class", "template_id", "cluster_id", F.split("template", " ").alias("tokens")).withColumn("length", F.size("tokens"))
    dealt = all_.withColumn("first", F.col("tokens")[0]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN_IN - 1).cast("long"))))
    key = ["source_class", "length", "first", "part"]
    found = rows.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_matching, "source_class string, signature string, template_id string")
    wild = F.array_size(F.filter(F.split("template", " "), lambda t: t == WILDCARD))
    best = found.join(templates.select("template_id", wild.alias("wild"), "cluster_id"), "template_id")
    order = Window.partitionBy("source_class", "signature").orderBy("wild", "cluster_id")
    return best.withColumn("place", F.row_number().over(order)).filter("place = 1").select("source_class", "signature", "template_id")


def annotate(events: DataFrame, templates: DataFrame, source_class: str = "vendor", signature: str = "signature_text") -> DataFrame:
    """``events`` with the ``template_id`` of their signature, empty where no template covers it."""
    wanted = events.select(F.col(source_class).alias("source_class"), F.col(signature).alias("signature")).distinct()
    found = match_templates(wanted, templates).select(F.col("source_class").alias("class_"), F.col("signature").alias("signature_"), F.col("template_id").alias("template_"))
    joined = events.drop("template_id").join(found, (F.col(source_class) == F.col("class_")) & (F.col(signature) == F.col("signature_")), "left")
    return joined.withColumn("template_id", F.coalesce("template_", F.lit(""))).drop("class_", "signature_", "template_")


def discovery_sample(events: DataFrame, templates: DataFrame, source_class: str = "vendor", signature: str = "signature_text", percent: int = 1) -> DataFrame:
    """Events whose signature no template covers: every one that failed to parse, and ``percent`` in a hundred of the others by a hash of the id."""
    sampled = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    unseen = annotate(events, templates, source_class, signature).filter("template_id = ''")
    return unseen.filter((F.col("parse_status") == "failed") | (sampled < percent))
