"""Masked message signatures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.catalog.masks import MASKS
from logmeridian.functions.exprs import let

Mask = tuple[str, str, Sequence[Sequence[tuple[str, int]]]]


def _holds(text: Column, literal: str, count: int) -> Column:
    if count == 0:
        return text.rlike(literal)
    if count == 1:
        return text.contains(literal)
    return F.substring_index(text, literal, count) != text


def masks_with(extra: Sequence[tuple[str, str]] = ()) -> tuple[Mask, ...]:
    """The dictionary with user masks placed in front of the built-in ones."""
    return tuple((name, regex, ()) for name, regex in extra) + MASKS


def masked(body: Column, masks: Sequence[Mask] = MASKS, max_chars: int | None = None) -> Column:
    """The masked text of ``body``; with ``max_chars`` longer bodies get the empty text.

    Every step binds its predecessor once (:func:`let`), so the expression grows with the number of
    masks and not with its power, wherever the optimizer moves it.
    """

    def step(name: str, regex: str, quick: Sequence[Sequence[tuple[str, int]]]) -> Callable[[Column], Column]:
        def replace(text: Column) -> Column:
            replaced = F.regexp_replace(text, F.lit("(?U)" + regex), F.lit(f"<{name}>"))
            if not quick:
                return replaced
            possible = reduce(or_, (reduce(and_, (_holds(text, *need) for need in needs)) for needs in quick))
            return F.when(possible, replaced).otherwise(text)

        return replace

    text = body if max_chars is None else F.when(F.length(body) <= max_chars, body).otherwise(F.lit(""))
    for name, regex, quick in masks:
        text = let(text, step(name, regex, quick))
    return text


def hash_of(text: Column) -> Column:
    """64-bit signature; 0 is kept for "no signature", so a real 0 becomes 1."""

    def hashed(t: Column) -> Column:
        return let(
            F.xxhash64(t),
            lambda d: F.when(t == "", F.lit(0).cast("bigint")).when(d == 0, F.lit(1).cast("bigint")).otherwise(d),
        )

    return let(text, hashed)


def with_signature(
    df: DataFrame,
    body: str = "body",
    text: str = "signature_text",
    hash_column: str = "signature_hash",
    masks=MASKS,
    max_chars: int | None = None,
) -> DataFrame:
    """``df`` with the masked text of ``body`` and its hash; a null body has the empty text and hash 0.

    Neither is ever null, so joins on them need no test for nulls, which would mask every row once more.
    """
    signed = df.withColumn(text, F.coalesce(masked(F.col(body), masks, max_chars), F.lit("")))
    return signed.withColumn(hash_column, F.coalesce(hash_of(F.col(text)), F.lit(0).cast("bigint")))


def unsigned_text(column: Column) -> Column:
    """Decimal text of the hash read as an unsigned number."""
    return F.when(column >= 0, column.cast("string")).otherwise(
        (column.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)"))
        .cast("decimal(20,0)")
        .cast("string")
    )
