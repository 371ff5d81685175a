"""Where intermediate tables of the document engine go, and sums along an order that no single task holds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: What a batch for a Python worker has at most where the session has Spark's own defaults (the second of each): it is held several times over there.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (1_000, "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": (4 << 20, str(64 << 20))}
#: Bytes of a batch that are unpacked at a time.
UNPACKED = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the size of batches by rows and bytes, so that a worker's memory doesn't follow from the texts' lengths or the input's size."""
    for name, (most, default) in BATCHES.items():
        if spark.conf.get(name).removesuffix("b") in (default, str(most)):
            spark.conf.set(name, most)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``UNPACKED`` bytes, a row at least; after the last, unused memory goes back, as workers are used again."""
    for batch in batches:
        rows = max(1, batch.num_rows * UNPACKED // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a temporary one only where the executors are threads of this process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.folder = path
    return made


def discard(made: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    context = made.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(made.folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sums_before(rows: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before in ``order``.

    Rows are ranged by their order into tasks; each task sums up its own, and the few sums of whole tasks are added up apart. So
    the longest run of rows that one task sees is its range.
    """
    ranged = written(rows.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    whole = ranged.groupBy("_task").agg(F.sum("_value").alias("_all"))  # one row a task
    before = whole.select(F.col("_task").alias("_of"), (F.sum("_all").over(W.partitionBy(F.lit(0)).orderBy("_task")) - F.col("_all")).alias("_before"))
    own = W.partitionBy("_task").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    placed = placed.join(F.broadcast(before), F.col("_task") == F.col("_of"))
    return placed.withColumn(name, F.col("_own") + F.col("_before")).drop("_value", "_task", "_of", "_own", "_before")
