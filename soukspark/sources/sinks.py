"""Writers of queues, rejects, snapshots and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukspark.operators.load import insert_ignore
from soukspark.scratch import cleaned


def queue_csv(kept: DataFrame, path: str, compression: str = "none") -> None:
    """The sourcing queue, best first; quotes are doubled. Files in the order of their names hold the rows in order. With
    ``compression`` (``gzip``, say) they are compressed, which readers tell by their names."""
    rows = kept.select(F.col("url_clean").alias("url"), "name", F.col("price_n").alias("cost_sgd"), F.col("sell").alias("sell_sgd"), "sold", F.col("reviews_n").alias("reviews"), F.col("rating_n").alias("rating"), F.col("shop_name").alias("shop"))
    _csv(rows, path, compression)


def rejects_csv(rejected: DataFrame, path: str, compression: str = "none") -> None:
    rows = rejected.select("reason", F.col("url_clean").alias("url"), "name", F.col("price_n").alias("cost_sgd"), "sold", F.col("reviews_n").alias("reviews"), F.col("rating_n").alias("rating"), "location", F.col("shop_name").alias("shop"))
    _csv(rows, path, compression)


def _csv(rows: DataFrame, path: str, compression: str) -> None:
    with cleaned(rows.sparkSession):
        rows.write.csv(path, header=True, quote='"', escape='"', compression=compression)


def append_new(target: DataFrame, rows: DataFrame, keys: list[str], path: str) -> None:
    """Appends the rows whose keys the target lacks; running it again appends none."""
    insert_ignore(target, rows, keys).write.mode("append").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """For logs: completions, inbox rows, duplicates found."""
    rows.write.mode("append").parquet(path)


def catalogue_json(items: DataFrame, path: str) -> None:
    items.write.json(path)
