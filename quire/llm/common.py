"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that goes to a Python worker, where the session hasn't set its own number: a batch of long texts is held several times over.
BATCH_ROWS = 1_000
BATCH_DEFAULT = "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == BATCH_DEFAULT:
        spark.conf.set(rows, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns, ``pick(df, out="source name")``.

    A column is found by its exact name first and without regard to case after
    that, and through its position, so other columns may have any name at all:
    dots, the operator's own output names or the same name in another case.
    """
    names = df.columns
    flat = df.toDF(*[f"__{i}" for i in range(len(names))])
    chosen = []
    for out, name in columns.items():
        at = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"column {name!r} is found {len(at)} times in {names}")
        chosen.append(F.col(f"__{at[0]}").alias(out))
    return flat.select(chosen)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a temporary one where none is set and the executors are threads of this process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nothing reads them again once the result is in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spooled(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder, and read from there: smaller than a checkpoint for many rows.

    ``by`` is a column whose values get folders of their own, so that a filter on it reads nothing else.
    """
    path = f"{shared_folder(df.sparkSession)}/spool-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.spool = path
    return made


def discard(made: DataFrame, part: str = "") -> None:
    """Deletes what ``spooled`` wrote, or a part of it (``column=value``), once nothing reads it any more."""
    jvm, context = made.sparkSession.sparkContext._jvm, made.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(made.spool + (f"/{part}" if part else ""))
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def thinned(rows: DataFrame, most: int, seed: int, count: int | None = None) -> DataFrame:
    """About ``most`` of the rows, or all if there are fewer, repeated rows once: those whose seeded hash is low, so reruns agree."""
    count = rows.count() if count is None else count
    if count > most:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 30)) < int(most / count * (1 << 30)))
    return rows.dropDuplicates()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that little of a batch of long texts is unpacked at a time; after the last, unused memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Hands freed memory back to the system: Python workers are used again, and what one task took would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc
