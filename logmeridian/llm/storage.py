"""Shared scratch tables and the settings the Arrow stages rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows handed to Python at once; a text column is cut further by bytes inside the tasks.
ARROW_ROWS = 1024
ARROW_BYTES = "8m"
"""Bytes handed to Python at once, as far as single rows allow; held by the executor and by its worker."""


def scratch(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive any lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stash`, in ``buckets`` by ``key``: joins and groups on it need not shuffle the table again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    as_table = f"{name}_{path.rsplit('-', 1)[-1]}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(as_table)
    return spark.table(as_table)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more; only folders below the scratch folder are touched."""
    for df in tables:
        spark = df.sparkSession
        root = f"{scratch(spark)}/llm/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if f"/{root.split('://')[-1].strip('/')}/" in f"{folder}/":
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_ready(spark: SparkSession) -> None:
    for name, value in (("maxRecordsPerBatch", str(ARROW_ROWS)), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) != value:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened by underscores until none is among ``taken`` (upper and lower case alike)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def few_rows_read(spark: SparkSession) -> Iterator[None]:
    """While jobs run inside, Parquet readers hold 4 rows at a time instead of 4,096: for rows of several MB."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run inside, Python gets one row at a time: for rows that each hold a packed block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)
