"""License scans: an exact set-similarity join of text blocks with license templates, on DataFrame functions only.

A text is cut into words; every window of ``2 w`` words at steps of ``w`` is a block, so that each run of up to ``w``
words lies whole in one. There are two sizes of blocks, for short statements and for whole notices. A block matches a
template when it holds at least ``CONTAINMENT`` of the template's distinct words.

The templates' words are counted over all texts and ordered from the rarest on. A block that matches must hold one of the
``size - required + 1`` rarest words of the template (prefix filter), so texts without any such word go no
further. The others' blocks join the templates on the words of their prefixes; a pair is looked at once, at its first
common word in the order, and dropped when the block has too few template words (length filter) or when the words after the
common one, on either side, cannot reach the required number (positional filter). What is left is counted exactly.
Counting, join and verification need no Python on the executors; the templates are the only broadcast side.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeridian.llm.storage import stash, table

CONTAINMENT = 0.9
SHORT, LONG = 16, 192
"""Words of a run that surely lies in one block, for short and for long templates."""
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels that they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Statements and notices as their licenses word them.
TEMPLATES = [
    ("mit-statement", "Released under the MIT License"),
    ("mit-statement", "Licensed under the MIT License"),
    ("apache-2.0-statement", "Licensed under the Apache License, Version 2.0"),
    ("gpl-statement", "Licensed under the GNU General Public License, version"),
    ("lgpl-statement", "Licensed under the GNU Lesser General Public License, version"),
    ("mpl-2.0-statement", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0-statement", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-statement", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache-2.0-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc-notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
]


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    """Distinct words, sorted."""
    span: int
    """Size class: ``SHORT`` or ``LONG``."""
    required: int


def templates(texts: list[tuple[str, str]], containment: float) -> list[Template]:
    out = []
    for i, (label, text) in enumerate(texts):
        words = [w for w in re.split(NOT_WORD, text.lower()) if w]
        if not words or len(words) > LONG:
            raise ValueError(f"a template has 1 to {LONG} words, {label} has {len(words)}")
        distinct = tuple(sorted(set(words)))
        out.append(Template(i, label, distinct, SHORT if len(words) <= SHORT else LONG, max(1, math.ceil(containment * len(distinct) - 1e-9))))
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normal_text(text: Column) -> Column:
    """The words, A-Z lower-cased, with one space between them.

    ``lower`` also changes other letters, but of these only the Kelvin sign would become an ASCII letter; it is replaced first.
    Which other letters stand in a word matters neither for counts nor for templates, which are ASCII.
    """
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("é")))
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def word_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words from the rarest in all texts on, equal counts by word."""
    counted = texts.select(F.explode(F.split("norm", " ")).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}  # at most the templates' words
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _index(spark: SparkSession, known: list[Template], order: list[str]) -> tuple[DataFrame, list[str]]:
    """The words of all prefixes, in order, and one row for each template and each word of its prefix; ``place`` counts from 0 in the global order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in known:
        words = sorted(t.words, key=rank.__getitem__)
        for place in range(len(words) - t.required + 1):
            rows.append((words[place], t.span, t.number, t.label, words, words[:place], place, t.required))
    schema = "word string, span int, template int, label string, words array<string>, before array<string>, place int, required int"
    return spark.createDataFrame(rows, schema), sorted({r[0] for r in rows}, key=rank.__getitem__)


def _blocks(words: Column, n: Column, span: int) -> Column:
    """All blocks of a size class as (span, first word, words)."""
    last = F.greatest(F.ceil(n / span) - 2, F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(span).alias("span"), (i * span).cast("long").alias("first"), F.slice(words, i * span + 1, 2 * span).alias("block"))
    )


def _phrase_starts(words: Column, n: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    here = lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int") - len(parts), F.lit(0))), here)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out &= test
    return F.coalesce(out, F.lit(False))


def license_scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` per row of ``docs``.

    ``base_labels`` come from the phrases, ``labels`` hold those of matching templates too; both are distinct, sorted and
    joined by commas, empty without any. ``score`` is the greatest share of a matching template's words that a block holds, 0
    without a match. ``matches`` lists label, first word, number of words and share of every matching block. A null text is
    empty; empty texts have no words, nulls in first and last, and score 0. Null ids, repeated ids and repeated rows keep their rows.
    Very long texts are cut into blocks like all others. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = templates(texts, containment)
    text = docs.select(F.col(id_column).alias("id"), normal_text(F.col(text_column)).alias("norm"))
    order = word_order(text, sorted({w for t in known for w in t.words}))
    index, prefix = _index(spark, known, order)

    words, n = F.col("words"), F.col("n_words")
    framed = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    has = {p: F.contains(framed, F.lit(f" {p} ")) for p in phrases}
    starts = F.concat(*[F.when(has[p], _phrase_starts(words, n, p)).otherwise(F.array().cast("array<int>")) for p in phrases])
    labels = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in phrases.items()]))
    scanned = (
        text.withColumn("words", F.split("norm", " "))
        .withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size("words")).cast("long"))
        .select(
            "id", "n_words", starts.alias("starts"), F.array_sort(F.array_distinct(labels)).alias("base"),
            F.when(F.arrays_overlap("words", _strings(prefix)), F.col("norm")).alias("norm"),
        )
        .select(
            F.monotonically_increasing_id().alias("row"), "id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"), "base", "norm",
        )
    )
    scanned = stash(scanned, "scanned")  # fixes the row numbers

    blocks = (
        scanned.where("norm is not null").select("row", "n_words", F.split("norm", " ").alias("words"))
        .select("row", F.explode(F.concat(_blocks(words, n, SHORT), _blocks(words, n, LONG))).alias("b")).select("row", "b.*")
        .where(F.arrays_overlap("block", _strings(prefix)))
        .select("row", "span", "first", F.size("block").alias("length"), F.array_intersect(_strings(order), F.col("block")).alias("held"))
    )
    pairs = blocks.withColumn("word", F.explode(F.array_intersect(_strings(prefix), F.col("held")))).join(F.broadcast(index), ["word", "span"])
    at = F.array_position("held", F.col("word")) - 1
    bound = 1 + F.least(F.size("words") - F.col("place") - 1, F.size("held") - at - 1)
    found = (
        pairs.where(F.size("held") >= F.col("required")).where(~F.arrays_overlap("before", "held")).where(bound >= F.col("required"))
        .withColumn("both", F.size(F.array_intersect("words", "held"))).where(F.col("both") >= F.col("required"))
        .select("row", F.struct("label", F.col("first").alias("first_word"), "length", (F.col("both") / F.size("words")).alias("share")).alias("match"))
        .groupBy("row").agg(F.array_sort(F.collect_list("match")).alias("matches"))
    )
    joined = scanned.drop("norm").where("norm is not null").join(found, "row", "left").unionByName(
        scanned.where("norm is null").drop("norm").withColumn("matches", F.lit(None)), allowMissingColumns=True
    )
    matched = F.coalesce(F.col("matches"), F.array().cast(found.schema["matches"].dataType))
    return joined.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform(matched, lambda m: m["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(matched, lambda m: m["share"])), F.lit(0.0)).alias("score"), matched.alias("matches"),
    )


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")


def _scan_sql() -> str:
    known = templates(TEMPLATES, CONTAINMENT)
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    rows = ", ".join(f"('{t.label}', {t.span}, {t.required}, {quoted(t.words)})" for t in known)
    spots = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, unnest(list_filter(range(n_words), lambda i: {' AND '.join(f'''words[i + {k + 1}] = '{p}' ''' for k, p in enumerate(phrase.split(' ')))})) AS i FROM d"
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda w: w <> '') AS words,
         len(words)::BIGINT AS n_words FROM documents
), t(label, span, required, tokens) AS (VALUES {rows}),
b AS (SELECT row, n_words, words, span, unnest(range(greatest(ceil(n_words / span)::BIGINT - 1, 1))) AS i FROM d, (SELECT DISTINCT span FROM t)),
m AS (
  SELECT row, label, len(list_intersect(tokens, words[i * b.span + 1 : i * b.span + 2 * b.span])) AS held, len(tokens) AS size, required
  FROM b JOIN t ON b.span = t.span
), best AS (SELECT row, list(DISTINCT label) AS labels, max(held / size::DOUBLE) AS score FROM m WHERE held >= required GROUP BY row),
s AS ({spots}),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM s GROUP BY row)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN best USING (row)
"""


OP12_SQL = _scan_sql()
