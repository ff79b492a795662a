"""Tables between the steps of a plan, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written within ``scratch``, for each of its levels.
_WRITTEN: list[list[DataFrame]] = []


class NoSharedFolder(RuntimeError):
    """A cluster that names no folder its machines share."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; an own folder only where none is set and all runs on one
    machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Rows of a file, in tables of which a bound of rows is known.
FILE_ROWS = 250_000


def materialise(df: DataFrame, what: str, rows: int | None = None, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    Lost executors then re-read the table instead of recomputing what made it, and a step that is
    read more than once runs once. ``rows``: about how many there are at most. A table of few rows is then
    written by two tasks a core and not by one for each shuffle partition, as each file costs a
    writer, and in a local file system a process that sets its permissions. ``packed``: smaller on disk, for
    tables that hold texts.
    """
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS))
    path = f"{checkpoint_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.option("compression", "zstd") if packed else df.write).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(out)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a table has fewer pieces than that; a
    larger table stays as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialise`` writes within are removed at the end, when the result is written too."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for table in _WRITTEN.pop():
            drop_table(table)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        with contextlib.suppress(Exception):  # it may be gone already, and a leftover harms nothing
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
