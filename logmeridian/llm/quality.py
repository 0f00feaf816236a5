"""Quality rules: base text statistics, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words (lower-cased) are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted on all data: one over the trusted documents (labelled good),
one over the whole raw corpus. A document's score is the mean over its n-grams of
``log(trusted share / raw share)``, so length does not matter. Documents are dealt into folds by a hash
of their id, and each is scored by what the other folds count, so trusted documents get no advantage
from their own n-grams. One threshold, taken from the scores of
all labelled documents on a fixed grid, decides every document, so equal inputs give equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeridian.llm import words as W
from logmeridian.llm.storage import arrow_ready, stash, table

BUCKETS = 10_000
FOLDS = 8
SMOOTHING = 10.0
"""Pseudo-counts of a bucket, given to the trusted side in proportion to the raw shares."""
KEEP_TRUSTED = 0.999
"""Least share of trusted documents that the threshold must keep."""
GRID = 0.001
"""Scores are compared on a grid of this width when the threshold is chosen."""
FILTER_BITS = 1 << 24
"""Bits of the table that finds trusted documents before the join: at most 262,144 rows of 64."""
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: how often its value occurs in its text, and whether an earlier entry has it."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, bool)
    key = W.mix(hashes ^ W.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, back, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return counts[back], first[back] != np.arange(len(key))


def text_statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    found = W.find_words(data, offs)
    n_words = np.diff(found.bounds)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[found.starts] += 1
    np.subtract.at(inside, found.ends, 1)
    letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80)
    lines = W.find_lines(data, offs)
    worded = np.searchsorted(found.starts, lines.ends) > np.searchsorted(found.starts, lines.starts)
    line_doc = np.repeat(np.arange(len(offs) - 1), np.diff(lines.bounds))[worded]
    _, again = _repeats(W.slice_hashes(data, lines.starts[worded], lines.ends[worded]), line_doc)
    windows = W.window_hashes(W.slice_hashes(data, found.starts, found.ends), 3)
    doc = np.repeat(np.arange(len(offs) - 1), n_words)
    valid = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.empty(0, np.int64)
    times, _ = _repeats(windows[valid], doc[valid])
    covered = np.zeros(len(doc), bool)
    for j in range(3):
        covered[valid[times > 1] + j] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": _sums(letters, offs),
        "n_symbols": _sums(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_doc[again], minlength=len(offs) - 1).astype(np.int64),
        "n_repeat_words": _sums(covered, found.bounds),
    }


def ngram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text each belongs to."""
    data = W.lower(data)
    found = W.find_words(data, offs)
    hashes = W.slice_hashes(data, found.starts, found.ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(found.bounds))
    pairs = W.window_hashes(hashes, 2)
    valid = doc[1:] == doc[:-1]
    both = np.concatenate([hashes, pairs[valid]]) % np.uint64(BUCKETS)
    return both.astype(np.int64), np.concatenate([doc, doc[1:][valid]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """N-grams per fold and bucket over all rows of ``(fold, text)``; a task sends at most one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FOLDS * BUCKETS, np.int64)
        for batch in batches:
            fold = batch.column(0).to_numpy().astype(np.int64)
            for first, last, data, offs in W.pieces(batch.column(1)):
                buckets, doc = ngram_buckets(data, offs)
                counts += np.bincount(fold[first:last][doc] * BUCKETS + buckets, minlength=FOLDS * BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["bucket", "n"])

    rows = texts.select("fold", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(FOLDS * BUCKETS)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out.reshape(FOLDS, BUCKETS)


def among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``id`` is one of ``ids`` (distinct), whatever the sizes by the same plan.

    A bit table of the ids' hashes, at most ``FILTER_BITS`` long and so a bounded broadcast, drops most other
    rows where they lie; only what passes is shuffled for the exact join.
    """
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    marks = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("marks"))
    marked = texts.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(marks), "word")
    likely = marked.where(F.expr("shiftrightunsigned(marks, CAST(bit & 63 AS INT)) & 1L = 1L")).select(texts.columns)
    return likely.hint("merge").join(ids.hint("merge"), "id", "left_semi")


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per fold and bucket the log of trusted share over raw share in the other folds; 0 without trusted text."""
    trusted, raw = trusted.sum(axis=0) - trusted, raw.sum(axis=0) - raw
    share = (raw + 1) / (raw + 1).sum(axis=1, keepdims=True)
    total = trusted.sum(axis=1, keepdims=True)
    out = np.log((trusted + SMOOTHING * BUCKETS * share) / (total + SMOOTHING * BUCKETS)) - np.log(share)
    return np.where(total > 0, out, 0.0)


def choose_threshold(scored: DataFrame) -> float:
    """Best cut between good and bad labels (``good`` boolean, ``score``) that keeps the trusted share.

    Without bad or without good labels nothing is rejected.
    """
    grid = scored.groupBy(F.floor(F.col("score") / GRID).alias("g"), "good").agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r["g"], r["good"], r["n"]) for r in grid.collect())
    good, bad = (sum(n for _, x, n in cells if x is kind) for kind in (True, False))
    if not good or not bad:
        return float("-inf")
    best, cut, lost, caught = -1.0, float("-inf"), 0, 0
    for g in sorted({c[0] for c in cells}):
        if lost <= (1 - KEEP_TRUSTED) * good and caught / bad - lost / good > best:
            best, cut = caught / bad - lost / good, g * GRID
        lost += sum(n for h, x, n in cells if h == g and x)
        caught += sum(n for h, x, n in cells if h == g and not x)
    return cut


def measure(texts: DataFrame, ratios: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy().astype(np.int64)
            for first, last, data, offs in W.pieces(batch.column(2)):
                stats = text_statistics(data, offs)
                buckets, doc = ngram_buckets(data, offs)
                total = np.bincount(doc, weights=ratios[fold[first:last][doc], buckets], minlength=last - first)
                count = np.bincount(doc, minlength=last - first)
                stats["score"] = total / np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(v) for v in stats.values())], names=["id", *stats])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "fold", "text").mapInArrow(
        run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    )


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, five statistics, ``score``, ``base_failed``, ``kept``.

    A document is rejected for fewer than 50 words, for more than half of its words in repeated
    three-word windows, or for a score below the threshold. Null and empty texts have no words and
    fail. Labels other than 1 count as bad, null labels and null ids are not used; several labels of
    one id count as good only if all are 1. Repeated rows stay. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    texts = docs.select(
        F.col(id_column).alias("id"),
        F.pmod(F.xxhash64(id_column), F.lit(FOLDS)).cast("int").alias("fold"),
        F.col(text_column).cast("string").alias("text"),
    )
    known = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).where("id is not null and label is not null")
        .groupBy("id").agg((F.min((F.col("label") == 1).cast("int")) == 1).alias("good"))
    )
    raw = bucket_counts(texts)
    trusted = bucket_counts(among(texts, known.where("good").select("id")))
    measured = stash(measure(texts, log_ratios(trusted, raw)), "quality")
    threshold = choose_threshold(measured.where(f"n_words >= {MIN_WORDS}").join(known, "id"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured.withColumnRenamed("id", id_column).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= F.lit(threshold))
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
