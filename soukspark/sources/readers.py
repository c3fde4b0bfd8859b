"""Exports, lists and catalogues as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = """itemId string, shopId string, shopName string, name string, url string, price double, historicalSoldEstimated string,
 reviewCount long, rating double, location string, images array<string>, _mock boolean"""
SHOP = """itemid long, shopid long, name string, price double, price_min double, price_max double, sold long, month_sold long,
 rating double, reviews long, stock long, liked long, image string, cat long"""


def exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items of JSON exports, each an array or an object with ``items``, with ``ord``: the file's place in ``paths``
    above the item's place in the file."""
    kind = f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in EXPORT.split(','))}>>"
    # one scan of all paths, however many; a file is told by its own path or by a folder's that it lies in
    at = spark.createDataFrame([(_bare(path), k) for k, path in enumerate(paths)], "_at string, _k long")
    body = F.coalesce(F.when(F.ltrim("value").startswith("["), F.col("value")), F.get_json_object("value", "$.items"))
    parts = F.split(_local(F.col("_metadata.file_path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    files = spark.read.text(sorted(set(paths)), wholetext=True).select(above.alias("_above"), body.alias("_body"))
    known = files.select("_body", F.explode("_above").alias("_at")).join(F.broadcast(at), "_at")
    return known.select("_k", F.posexplode(F.from_json("_body", kind)).alias("pos", "x")).select((F.shiftleft("_k", 40) + F.col("pos")).alias("ord"), "x.*")


def _local(path: Column) -> Column:
    """A path without escapes, and without the scheme and authority that not everybody writes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _bare(path: str) -> str:
    return re.sub(r"/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|/", path) else os.path.abspath(path))).rstrip("/")


def as_items(export: DataFrame, blocked: DataFrame) -> DataFrame:
    """Exports in the columns of the sourcing cascade; ``blocked``: ids rejected by hand."""
    ids = blocked.select(F.col("id").alias("_id")).distinct()
    rows = export.join(ids, F.col("itemId") == F.col("_id"), "left")
    return rows.select(
        "ord", F.col("itemId").alias("item_id"), F.col("shopId").alias("shop_id"), F.col("shopName").alias("shop_name"), "name", "url", "price",
        F.col("historicalSoldEstimated").alias("sold_text"), F.col("reviewCount").alias("reviews"), "rating", "location",
        F.coalesce("_mock", F.lit(False)).alias("is_mock"), F.col("_id").isNotNull().alias("blocked"), "images",
    )


def blocklist(spark: SparkSession, path: str | None) -> DataFrame:
    """``id``: the digits that a line starts with, up to white space or a hash sign. No path: none."""
    if path is None:
        return spark.createDataFrame([], "id string")
    got = spark.read.text(path).select(F.regexp_extract(F.trim("value"), r"^(\d+)(?=[\s#]|$)", 1).alias("id"))
    return got.where("id <> ''").distinct()


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Strings under a header; quotes doubled inside quotes. ``ord`` follows the lines of one file."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).withColumn("ord", F.monotonically_increasing_id())


def newest(spark: SparkSession, folder: str, glob: str) -> str | None:
    """The path of the file that was changed last; of equals the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def shop_catalogue(spark: SparkSession, path: str) -> DataFrame:
    items = f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in SHOP.split(','))}>>"
    raw = spark.read.schema(f"shopid long, username string, pulled string, items {items}").json(path, multiLine=True)
    return raw.select("username", F.posexplode("items").alias("ord", "x")).select("ord", "username", "x.*")


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The first row by ``ord`` of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), "ord").alias("_x")).select(key, "_x.*").select(*rows.columns)


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """One row for each keyword of a run's settings, with its other settings."""
    raw = spark.read.json(path, multiLine=True)
    return raw.withColumn("keyword", F.explode("keywords")).drop("keywords").dropDuplicates(["keyword"])


def data_uris(spark: SparkSession, path: str) -> DataFrame:
    """``path, uri``: files as base64 data URIs, kind by the name's end."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(F.lower("path").endswith(".png"), "image/png").when(F.lower("path").endswith(".webp"), "image/webp").otherwise("image/jpeg")
    return files.select("path", F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("uri"))
