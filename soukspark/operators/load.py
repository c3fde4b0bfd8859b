"""Loading a catalogue into the queue: joins with the ranked list, merges, repricing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukspark.functions import arrays, num


def last_ranked(ranked: DataFrame) -> DataFrame:
    """One row for each URL of the ranked list: its last."""
    last = F.max_by(F.struct(F.col("times_listed").try_cast("int").alias("times_listed"), num.two_places("price").alias("price")), "ord")
    return ranked.groupBy("listing_url").agg(last.alias("x")).select("listing_url", F.col("x.times_listed").alias("ranked_times"), F.col("x.price").alias("ranked_price"))


def usable(catalog: DataFrame) -> DataFrame:
    """Rows with a URL and a title, both trimmed."""
    out = catalog.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("listing_url", "title")})
    return out.where("listing_url <> '' and title <> ''")


def built(catalog: DataFrame, ranked: DataFrame, ranked_only: bool = False) -> DataFrame:
    """Queue rows of a catalogue: images, price, and how often the ranked list counts the product (else once).

    ``ranked_only``: rows of the ranked list alone, with its price where it has one.
    """
    rows = usable(catalog).join(last_ranked(ranked), "listing_url", "inner" if ranked_only else "left")
    own = num.two_places("price")
    price = F.coalesce("ranked_price", own) if ranked_only else own
    images = arrays.image_list("cover_image", "image_2", "image_3", extra="extra_images")
    return rows.select("ord", "listing_url", "title", price.alias("price"), images.alias("images"), F.coalesce("ranked_times", F.lit(1)).alias("times_listed"))


def ordered(rows: DataFrame, top: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("times_listed"), "ord")
    return out.limit(top) if top else out


def summary(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """``total, skipped, covered, without_images`` of a load."""
    got = rows.agg(F.count("*").alias("total"), F.count_if(F.col("times_listed") > 1).alias("covered"), F.count_if(F.size("images") == 0).alias("without_images"))
    every = catalog.agg(F.count("*").alias("_n"), F.count_if((F.trim(F.coalesce("listing_url", F.lit(""))) == "") | (F.trim(F.coalesce("title", F.lit(""))) == "")).alias("skipped"))
    return got.join(every).select("total", "skipped", "covered", "without_images")  # one row each


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the target lacks, of equal keys the one of least ``ord``. A null key never conflicts."""
    null = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    others = [c for c in rows.columns if c not in keys]
    first = rows.where(~null).groupBy(*keys).agg(F.min_by(F.struct(*others), "ord").alias("_x")).select(*keys, "_x.*")
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return fresh.select(*rows.columns).unionByName(rows.where(null))


def repriced(queue: DataFrame, ranked: DataFrame) -> DataFrame:
    """``id, have, want`` of queue rows whose price is a cent or more off the ranked list's. Of rows that share a
    URL only that of least id is looked at."""
    first = queue.groupBy("listing_url").agg(F.min_by(F.struct("id", F.col("price").alias("have")), "id").alias("x")).select("listing_url", "x.*")
    out = first.join(last_ranked(ranked), "listing_url").select("id", "have", F.col("ranked_price").alias("want"))
    return out.where(F.abs(F.col("have") - F.col("want")) >= 0.01)


def largest_changes(changes: DataFrame, n: int = 6) -> DataFrame:
    return changes.orderBy(F.desc(F.abs(F.col("want") - F.col("have"))), "id").limit(n)


def update_prices(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue with the wanted prices in place."""
    return queue.join(changes.select("id", "want"), "id", "left").withColumn("price", F.coalesce("want", "price")).drop("want")
