"""Small expression helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_MAP = "map<string,string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def attr(key: str, column: str = "attrs") -> Column:
    """A map value, with a missing key read as the empty string so negations keep their rows."""
    return F.coalesce(F.element_at(F.col(column), F.lit(key)), F.lit(""))


def nonblank(column: Column) -> Column:
    """The value, or NULL when it is NULL or only whitespace."""
    return F.when(F.trim(column) != "", column)


def text_map(values: Mapping[str, Column]) -> Column:
    """A string map without its NULL values."""
    if not values:
        return empty_map()
    pairs: list[Column] = []
    for key, value in values.items():
        pairs += [F.lit(key), value.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def empty_map() -> Column:
    return F.create_map().cast(TEXT_MAP)


def literal_map(values: Mapping[str, str]) -> Column:
    """A constant lookup table; it folds to one literal at planning time."""
    pairs: list[Column] = []
    for key, value in values.items():
        pairs += [F.lit(str(key)), F.lit(str(value))]
    return F.create_map(*pairs)


def ellipsis(column: Column, length: int = 160) -> Column:
    """Sample text shortened for display."""
    return F.when(F.length(column) > length, F.concat(F.substring(column, 1, length), F.lit("…"))).otherwise(
        column
    )


def count_true(condition: Column) -> Column:
    """How many rows satisfy ``condition``; a fixed-width buffer, so hash aggregation applies."""
    return F.count(F.when(condition, F.lit(1)))


def utc_text(column: Column) -> Column:
    """ISO-8601 text of an instant, seven fraction digits and a zone mark."""
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def decimal_text(column: Column, digits: int = 3) -> Column:
    """Invariant decimal text with at most ``digits`` fraction digits and no trailing zeros."""
    fixed = F.round(column, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
