"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is the repetition rate its source needs
to reach its target share. The number comes from inverting the distribution at a uniform value hashed
from the seed and the document's id, so it is the same on every run and at every layout. Copies are
then ordered by a hash over the whole table. Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.llm.storage import free_names, table

SEED = 17
BROADCAST_SOURCES = 10_000
"""With at most this many sources their rates are broadcast; with more they are joined on salted keys."""
SALTS = 64


def _uniform(*parts: Column) -> Column:
    """A value in [0, 1) of 52 hashed bits."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _identity(id_column: str) -> Column:
    return F.coalesce(F.col(id_column).cast("string"), F.lit("null"))


def repetition_rates(docs: DataFrame, source_column: str = "source", weights: Mapping[str, float] | None = None, rows: float | None = None) -> DataFrame:
    """``source_key, rate, cdf``: mean copies per document, and the distribution function at 0, 1, ...

    ``weights`` are relative target shares, equal for all sources if not given; a source that is not
    named gets none. ``rows`` is the size aimed at, the number of rows if not given.
    """
    counts = docs.groupBy(F.col(source_column).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    elif weights:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weighted = counts.withColumn("w", F.coalesce(F.element_at(given, F.col("source_key")), F.lit(0.0)))
    else:
        weighted = counts.withColumn("w", F.lit(0.0))
    totals = weighted.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    aim, all_weights = float(rows if rows is not None else totals["n"] or 0), float(totals["w"] or 1)
    rate = F.when(F.col("w") > 0, F.lit(aim) * F.col("w") / F.lit(all_weights) / F.col("n"))
    rated = weighted.select("source_key", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    start = F.struct((-F.col("rate")).alias("l"), F.exp(-F.col("rate")).alias("c"), F.array(F.exp(-F.col("rate"))).alias("a"))

    def add(acc: Column, k: Column) -> Column:
        log_p = acc["l"] + F.log("rate") - F.log(k.cast("double"))
        total = acc["c"] + F.exp(log_p)
        return F.struct(log_p.alias("l"), total.alias("c"), F.array_append(acc["a"], total).alias("a"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, add)["a"]).otherwise(F.array(F.lit(2.0)))
    return rated.select("source_key", "rate", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", weights: Mapping[str, float] | None = None, rows: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs``, each row repeated; ``n_copies``, ``copy`` (from 1) and ``mix_key`` added.

    The result is ordered by ``mix_key`` over all rows. Null sources are one source; null ids share one
    hashed value, as do repeated ids, which therefore get equal numbers of copies. An empty table
    stays empty. Existing columns named like the three added ones are replaced.
    """
    docs = docs.drop("n_copies", "copy", "mix_key")
    source_key, cdf, salt, u_name = free_names([*docs.columns, "n_copies", "copy", "mix_key"], "source_key", "cdf", "salt", "u")
    rates = repetition_rates(docs, source_column, weights, rows).select(F.col("source_key").alias(source_key), F.col("cdf").alias(cdf))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), F.col(source_column).eqNullSafe(F.col(source_key)))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(
            salted, F.col(source_column).eqNullSafe(F.col(source_key)) & (F.pmod(F.xxhash64(id_column), F.lit(SALTS)) == F.col(salt))
        )
    u = _uniform(F.lit(seed), _identity(id_column))
    counted = joined.withColumn(u_name, u).withColumn("n_copies", F.size(F.filter(cdf, lambda c: c <= F.col(u_name))).cast("long"))
    copies = counted.where("n_copies > 0").select(*docs.columns, "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(seed), _identity(id_column), F.col("copy")))
    return copies.withColumn("mix_key", key).orderBy("mix_key")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_copies", "copy", "mix_key")


OP9_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS all_n, count(*)::DOUBLE AS all_w FROM counts),
rates AS (SELECT source, all_n / all_w / n AS rate FROM counts, totals),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS l, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, l + ln(rate) - ln((k + 1)::DOUBLE), c + exp(l + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(2**52)} AS u FROM documents
),
counted AS (
  SELECT d.doc_id, d.source, count(*) FILTER (s.c <= d.u) AS n_copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id, d.source
)
SELECT doc_id, source, n_copies, copy, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS mix_key
FROM (SELECT doc_id, source, n_copies, unnest(generate_series(1, n_copies)) AS copy FROM counted WHERE n_copies > 0)
"""
