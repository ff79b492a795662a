"""Helpers that the training-data operators share: table access, memory of tasks, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import checkpoint_dir, drop_table, materialise

__all__ = ["arrow_task", "bound_batches", "checkpoint_dir", "drop_table", "held_out", "materialise", "pick", "place_of", "read_table"]


#: Bytes of an Arrow batch on its way to and from Python.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts may be very long; a bound below Spark's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) not in range(1, 64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give the memory that a task has freed back to the system, as workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def arrow_task(run):
    """``run`` over Arrow batches, with its memory released at its end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, found by exact spelling, then by spelling without case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not (exact or loose):
        raise ValueError(f"column {name} is missing; there are {df.columns}")
    return (exact or loose)[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, each found as by ``place_of``."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"c{place_of(df, n)}").alias(n) for n in names])
