"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = 256
"""Rows of an Arrow batch. Texts may be long, so batches are kept far below Spark's 10,000 rows."""
BYTES_PER_BATCH = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Free memory of this process goes back to the system: Arrow's, and that of malloc where its library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_KEPT: list[Callable] = []
_LAST: list[int | None] = [None]


def kept_for_stage(fn: Callable) -> Callable:
    """A worker makes it once for all its tasks of a stage; later stages, for which the worker stays, get the memory."""
    kept = lru_cache(maxsize=4)(fn)
    _KEPT.append(kept)
    return kept


def forget_other_stages() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _LAST[0]:
        _LAST[0] = stage
        for kept in _KEPT:
            kept.cache_clear()


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, rows: int = ROWS_PER_BATCH
) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so that the memory of a Python worker is bounded, and given back at
    the end of each task: workers stay for the tasks of later stages.

    Both bounds are settings of the session (Spark reads them when the query runs, so they stay set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        try:
            yield from fn(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return df.mapInArrow(run, schema)


def text_input(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns, whatever their names, can't interfere."""
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in more))


def extended(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    """df's schema with more columns; df's own is left alone."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that setting is absent, a folder of this machine will do only if all tasks run here; elsewhere it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and lost executors don't cause it to be made again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(key: str, folds: int) -> F.Column:
    """crc32 of a key's decimal text, modulo folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
