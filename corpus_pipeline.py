"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns the columns of
``documents``; the last returns token digests. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.llm.bpe import bpe_decode, bpe_encode, default_vocabulary
from logmeridian.llm.line_dedup import dedup_lines
from logmeridian.llm.mixing import mix_sources
from logmeridian.llm.ngram_join import ngram_jaccard_join
from logmeridian.llm.quality import quality_rules
from logmeridian.llm.storage import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows of one id are judged apart by their text."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("key"), "doc_id", "text")
    judged = quality_rules(keyed.select("key", "text"), _keyed_labels(spark, keyed, sf_dir), id_column="key")
    kept = judged.where("kept").select("key").distinct().withColumnRenamed("key", "key_")
    return docs.join(kept, key == F.col("key_"), "left_semi").select(COLUMNS)


def _keyed_labels(spark: SparkSession, keyed: DataFrame, sf_dir: str) -> DataFrame:
    return keyed.select("key", "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("key", "quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites are taken out of the texts; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, a null id being the last.

    Rows are told apart by id and text. Documents without words link with nothing and stay; of rows with words
    that repeat both id and text, one stays.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("key"), "doc_id", "text")
    groups = stash(ngram_jaccard_join(keyed, id_column="key").where("n_shingles > 0").select("key", "component_id").distinct(), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = groups.join(keyed.select("key", "doc_id"), "key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.key")
    gone = groups.join(first, "key", "left_anti").select("key")
    rest = docs.withColumn("key", key).join(gone, "key", "left_anti")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return rest.where(worded).dropDuplicates(["key"]).unionByName(rest.where(~worded)).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned towards equal shares, in a globally shuffled order."""
    return mix_sources(docs).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again: counts and digests per row."""
    path = default_vocabulary()
    back = bpe_decode(bpe_encode(docs, path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: SQL cannot express the hashed scores of the first stage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage{i + 1}")
    return docs
