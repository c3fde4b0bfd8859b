"""The scrape inbox as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema: str, files: int = 3) -> DataFrame:
    """Files of an inbox folder, so many a trigger; a checkpoint gives every file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(rows: DataFrame, key: str = "item_id", ts: str = "created_at", late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats within the watermark are dropped and their state forgotten after it."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def attempts(rows: DataFrame, most: int = 3) -> DataFrame:
    """``unloaded``: whether a row came without a payload after so many tries."""
    return rows.withColumn("unloaded", F.col("title").isNull() & (F.col("tries") >= most))


def daily_counts(done: DataFrame, ts: str = "done_at", late: str = "1 hour") -> DataFrame:
    """Completions by worker and local day: days start at 16:00 UTC."""
    day = F.window(ts, "1 day", startTime="16 hours")
    out = done.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy("worker_id", day.alias("w")).agg(F.count("*").alias("n"))
    return out.select("worker_id", F.to_date(F.col("w.start") + F.expr("interval 8 hours")).alias("day"), "n")


def write_outcomes(rows: DataFrame, accepted: str, dead: str, checkpoint: str):
    """Starts the query that appends accepted rows and dead letters, each batch in folders of its own, so that a batch
    that runs again replaces what it had written. In: ``outcome``."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("outcome in ('ok', 'refresh')").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        batch.where("outcome not in ('ok', 'refresh')").write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
