"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. Lines on fewer rows than the threshold cannot spread
that far and are left out by an exact count; for the rest, HyperLogLog sketches of the sites per line
hash are made in salted parts and merged by aggregation. Where the estimate is near the threshold, the sites are counted
exactly, so the result is that of exact counting unless a sketch errs by more than ``MARGIN``. A text
made of such lines alone is a copy of other texts rather than a page with boilerplate: it
stays whole, for a near-duplicate step to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.llm.storage import free_names, stash, table

SITES = 10
SKETCH_BITS = 10
MARGIN = 0.2
"""Six standard errors of a sketch of 2^10 registers."""
SALTS = 16
"""Tasks that the rows of one line are dealt over; each makes a sketch of its own part."""


def _lines(docs: DataFrame, key: Column, site: str, text: str) -> DataFrame:
    return (
        docs.select(key.alias("key"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .where(F.trim("line") != "")
        .select("key", "site", "pos", F.xxhash64("line").alias("h"))
    )


def widespread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes of lines that stand on at least ``sites`` distinct sites; a null site is none."""
    seen = lines.where("site is not null").select("h", "site", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).alias("salt"))
    often = (
        seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
        .select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    parts = seen.join(often, ["h", "salt"], "left_semi").groupBy("h", "salt").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = stash(
        parts.groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
        .where(F.col("estimate") >= sites * (1 - MARGIN)),
        "spread",
    )
    clear = spread.where(F.col("estimate") > sites * (1 + MARGIN)).select("h")
    near = spread.where(F.col("estimate") <= sites * (1 + MARGIN)).select("h")
    counted = seen.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return stash(clear.unionByName(counted.select("h")), "widespread")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", site_column: str = "source", text_column: str = "text", sites: int = SITES) -> DataFrame:
    """``docs`` with widespread lines taken out of its text, and ``n_lines``, ``n_removed`` added.

    Lines are the pieces between line feeds; those of spaces only never count. A null text stays null
    and has no lines. A text without any other line stays whole. Rows equal in id and text are treated alike; null ids and null sites keep their
    rows, and other columns stay as they are (an existing ``n_lines`` or ``n_removed`` is replaced).
    """
    docs = docs.drop("n_lines", "n_removed")
    key = F.xxhash64(id_column, text_column)
    lines = _lines(docs, key, site_column, text_column)
    wide = widespread_lines(lines, sites)
    key_name, gone_name = free_names(docs.columns, "key", "gone")
    found = (
        lines.join(wide, "h", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("key").alias(key_name), F.col("gone").alias(gone_name))
    )
    joined = docs.join(found, key == F.col(key_name), "left")
    kept = F.filter(F.split(text_column, "\n"), lambda _, i: ~F.array_contains(gone_name, i))
    gone = F.when(F.exists(kept, lambda line: F.trim(line) != ""), F.col(gone_name))
    return joined.select(
        *[F.when(gone.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_column else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.split(text_column, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), wide AS (
  SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, w.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN wide w ON l.line = w.line
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
         bool_or(NOT gone AND trim(line) <> '') AS able,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS rest
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, CASE WHEN able THEN n_gone ELSE 0 END AS n_removed,
       sha256(CASE WHEN able AND n_gone > 0 THEN coalesce(rest, '') ELSE d.text END) AS text_sha256
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""
