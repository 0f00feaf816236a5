"""Integer vectors for the operators that promise exact results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int, label_column: str | None = None) -> DataFrame:
    """``id, label, v``: components as ``floor(scale * x)``; the rows that can take part.

    Left out are vectors that are null, empty, or hold null or non-finite components, and those with a
    component that leaves the range in which squared distances and inner products fit a long.
    """
    v = F.col("v")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), (F.col(label_column) if label_column else F.lit(None).cast("int")).alias("label"), F.col(vector_column).cast("array<double>").alias("v")
    ).where("v is not null and size(v) > 0")
    limit = F.pow(F.lit(2.0), F.floor((60 - F.ceil(F.log2(F.size(v)))) / 2) - 1)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < limit))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out
