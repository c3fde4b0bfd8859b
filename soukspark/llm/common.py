"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soukspark.scratch import spread

#: The ASCII whitespace that separates words: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACES_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a folder of our own is set; that is allowed on a local master only,
    since executors on other machines could not see it.
    """
    where, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if where:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(where)
        return where
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"soukspark-{os.getuid()}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of this application's own in the shared folder; ``clear`` removes them all."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application stored in the shared folder. To be called once its results are written: DataFrames
    that read from there cannot be computed any more. Checkpoints are Spark's own; it deletes those that are no longer
    referenced where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``left`` joined with ``right``, which has every key once and in ``weight`` how many rows of ``left`` have it.

    Keys with more than a thousandth of all rows are broadcast, so a thousand at most; the others meet by a shuffle, in
    which no key is large. ``left`` is read twice."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * 1000 > total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) * 1000 <= total), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives freed memory back to the system; freed lists and arrays otherwise stay with their process."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives back what its task held: Spark keeps Python workers for the next task that
    needs one, beside an executor that may need the memory itself meanwhile."""

    def of(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return of


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the columns of ``ddl`` after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
