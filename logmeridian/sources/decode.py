"""Text from bytes of unknown encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FALLBACK = "windows-1254"
_RESULT = StructType().add("encoding", "string").add("text", "string").add("declared_honored", "boolean")


@F.pandas_udf(_RESULT)
def _decoded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import codecs
    from unicodedata import normalize

    names = {"cp1254": "windows-1254", "cp1252": "windows-1252", "iso8859-1": "iso-8859-1", "iso8859-9": "iso-8859-9", "utf-16-le": "utf-16", "utf-16-be": "utf-16BE", "ascii": "us-ascii"}

    def strict(raw: bytes, name: str | None) -> tuple[str, str] | None:
        if not name or not name.strip():
            return None
        try:
            found = codecs.lookup(name.strip()).name
            return names.get(found, found), raw.decode(found)
        except (LookupError, UnicodeError):
            return None

    def one(raw: bytes | None, declared: str | None, fallback: str | None) -> tuple:
        if raw is None:
            return None, None, None
        for mark, codec, name in ((codecs.BOM_UTF8, "utf-8", "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le", "utf-16"), (codecs.BOM_UTF16_BE, "utf-16-be", "utf-16BE")):
            if raw.startswith(mark):
                return name, normalize("NFC", raw[len(mark) :].decode(codec, "replace")), True
        if got := strict(raw, declared):
            return got[0], normalize("NFC", got[1]), True
        got = strict(raw, "utf-8") or strict(raw, fallback) or ("iso-8859-1", raw.decode("latin-1"))
        return got[0], normalize("NFC", got[1]), not (declared or "").strip()

    for raw, declared, fallback in batches:
        yield pd.DataFrame([one(*row) for row in zip(raw, declared, fallback, strict=True)], columns=["encoding", "text", "declared_honored"])


def _optional(column: Column | None) -> Column:
    return (F.lit(None) if column is None else column).cast("string")


def decode_text(df: DataFrame, raw: str, declared: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """``df`` with ``encoding``, ``text`` (in NFC) and ``declared_honored`` of the bytes in ``raw``.

    A byte-order mark decides; then the declared encoding if all bytes fit it, UTF-8, the fallback of the
    source (``windows-1254`` if none is given), and at last Latin-1, which fits all. Unknown names are passed over;
    ``declared_honored`` is false where a declared encoding was not used. NULL bytes give NULLs. Plain
    ASCII without a declaration is decoded by a built-in; only other rows go to Python.
    """
    said = _optional(declared)
    plain = F.coalesce(F.is_valid_utf8(F.col(raw).cast("string")) & F.col(raw).cast("string").rlike(r"\A[\x00-\x7F]*\z") & (F.trim(F.coalesce(said, F.lit(""))) == ""), F.lit(False))
    other = _decoded(F.when(~plain, F.col(raw)), said, F.lit(FALLBACK) if fallback is None else _optional(fallback))
    got = df.withColumns({"plain_": plain, "other_": other})
    kept = [c for c in df.columns if c not in ("encoding", "text", "declared_honored")]
    return got.select(
        *kept,
        F.when(F.col("plain_"), "utf-8").otherwise(F.col("other_.encoding")).alias("encoding"),
        F.when(F.col("plain_"), F.col(raw).cast("string")).otherwise(F.col("other_.text")).alias("text"),
        (F.col("plain_") | F.col("other_.declared_honored")).alias("declared_honored"),
    )
