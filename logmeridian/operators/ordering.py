"""Row numbers over a global order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmeridian.session import cut_lineage


def numbered(df: DataFrame, name: str, *order: Column, start: int = 1) -> DataFrame:
    """``df`` with the place of every row in ``order`` as a long column.

    Rows are sorted into ranges; each range numbers its own rows, and the sizes of the ranges before it, one row for each range,
    are added. The sorted rows are written once to the shared folder, since a sort that is repeated after a lost
    executor might deal ties to other places. Ties get some order, the same for all later reads.
    """
    spread = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id()))
    sizes = spread.groupBy("range_").agg(F.count(F.lit(1)).alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("range_", before.alias("before_"))
    # The low 33 bits of the increasing id count the rows of its partition.
    own = F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(F.broadcast(offsets), "range_").withColumn(name, own + F.col("before_") + F.lit(start)).drop("range_", "place_", "before_")
