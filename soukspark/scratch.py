"""Where intermediate tables go (the folder that driver and executors share), and small tables dealt over all cores."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session has none, a folder of our own on a local master; elsewhere executors
    could not see it."""
    where, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not where:
        if not sc.getCheckpointDir() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = sc.getCheckpointDir() or os.path.join(tempfile.gettempdir(), f"soukspark-{os.getuid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def folder(spark: SparkSession, name: str) -> str:
    """A path of this application's own that nothing else uses."""
    return f"{shared(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet and read back."""
    path = folder(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    for file in table.inputFiles():
        path = sc._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, False)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once, as a reliable checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


#: Bytes of a table up to which it is looked at how many files it has.
SMALL = 1 << 30


def spread(table: DataFrame, piece: int | None = None) -> DataFrame:
    """A table of files as it is, unless it is small and has fewer files than there are cores: a file of one row group is
    read by one task, whatever is asked of it, so its rows are dealt round first. The columns that are not used later
    take no part in that. With ``piece`` a table of any size is dealt into tasks of so many bytes of its files, for work that
    takes long for each row: the longest task then stays as long when the table grows."""
    tasks = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if piece is not None:
        return table.repartition(max(tasks, -(-size // piece)))
    return table.repartition(tasks) if size < SMALL and len(table.inputFiles()) < tasks else table


def parts(table: DataFrame, rows: int) -> int:
    """How many tasks a table's rows are dealt into, for each to get about ``rows`` of them; one a core at least. Tasks
    then become more as the table grows, not larger. Of Parquet files only the footers are read for it."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))
