"""A table of keyed rows that is changed in place: only the partitions that hold changed rows are written.

The table is Parquet, laid out by a column that operations go by (an account) and a bucket of the key. A change reads the
partitions of its keys, puts the new values in, and overwrites those partitions and no others. So what a claim of twenty
rows writes is twenty buckets at most, whatever the table's size; ``buckets`` sets how large one is.

One writer at a time: two changes of one partition at once would lose one, as nothing locks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soukspark.operators import load, queue
from soukspark.scratch import cut

BUCKET = "_bucket"


class KeyedTable:
    """``by`` must not change for a key. Rows with a null key can be read but not changed."""

    def __init__(self, spark: SparkSession, path: str, by: str = "account", key: str = "id", buckets: int = 64):
        self.spark, self.path, self.by, self.key, self.buckets = spark, path, by, key, buckets

    def bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64({self.key}), {self.buckets}) as int)")

    def create(self, rows: DataFrame) -> None:
        self._write(rows.withColumn(BUCKET, self.bucket()), "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(self.by, BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.by, BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def update(self, changes: DataFrame) -> int:
        """Puts the columns of ``changes`` (``by``, ``key`` once each, and others of the table) in place; how many partitions
        were written. Keys that the table lacks change nothing."""
        names = [c for c in changes.columns if c not in (self.by, self.key)]
        changes = cut(changes.withColumn(BUCKET, self.bucket()))
        # a row for each partition that is touched: as many as the table has, at most
        touched: dict = {}
        for r in changes.select(self.by, BUCKET).distinct().collect():
            touched.setdefault(r[0], []).append(r[1])
        if not touched:
            return 0
        here = reduce(Column.__or__, [F.col(self.by).eqNullSafe(F.lit(a)) & F.col(BUCKET).isin(b) for a, b in touched.items()])
        new = changes.select(F.col(self.key).alias("_key"), F.col(self.by).alias("_by"), *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
        old = self._stored().where(here)
        out = old.join(new, (F.col(self.key) == F.col("_key")) & F.col(self.by).eqNullSafe(F.col("_by")), "left")
        hit = F.coalesce("_hit", F.lit(False))
        put = [F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in names else F.col(c) for c in old.columns]
        self._write(cut(out.select(*put)), "overwrite")
        return sum(map(len, touched.values()))


_STATE = ("state", "holder", "held_since", "attempts", "done_at", "done_url", "refusal")


def _changed(table: KeyedTable, rows: DataFrame) -> DataFrame:
    """The rows that an operation on ``rows`` (which keep their old state as ``_was``) gave another state or holder."""
    return cut(rows.where(F.col("state").cast("string") != F.col("_was")).select(table.by, table.key, *_STATE))


def claim(table: KeyedTable, staff: DataFrame, worker: str, n: int, now: str) -> DataFrame:
    """``queue.claim`` in place; the rows taken. Only the worker's account is read."""
    own = staff.where(F.col("id") == worker).select("own_account").first()
    rows = table.rows().where(F.col(table.by) == F.lit(own and own[0]))
    taken = cut(queue.claim(rows, staff, worker, n, now).where("taken").select(table.by, table.key, *_STATE))
    table.update(taken)
    return taken


def complete(table: KeyedTable, worker: str, ids: list[int] | DataFrame, now: str, url: str | None = None) -> DataFrame:
    done = _changed(table, queue.complete(table.rows().withColumn("_was", F.col("state")), worker, ids, now, url))
    table.update(done)
    return done


def reject(table: KeyedTable, worker: str, ids: list[int] | DataFrame, now: str, why: str | None = None) -> DataFrame:
    """``queue.reject`` in place, pending rows of the same URL on other accounts included; all rows that changed."""
    out = _changed(table, queue.reject(table.rows().withColumn("_was", F.col("state")), worker, ids, now, why))
    table.update(out)
    return out


def release(table: KeyedTable, worker: str) -> DataFrame:
    out = _changed(table, queue.release(table.rows().withColumn("_was", F.col("state")), worker))
    table.update(out)
    return out


def reprice(table: KeyedTable, ranked: DataFrame) -> int:
    """Puts the ranked list's prices in place; how many partitions were written."""
    rows = table.rows()
    changes = load.repriced(rows, ranked).select("id", F.col("want").alias("price"))
    return table.update(changes.join(rows.select("id", table.by), "id"))
