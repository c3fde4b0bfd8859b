"""Reports over judged items and shop catalogues. Each is one aggregate; settings are columns of it, not scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukspark.config import COST_BANDS, SHOP_BANDS, Flags
from soukspark.functions import num
from soukspark.operators import medians
from soukspark.scratch import cut


def reasons(judged: DataFrame) -> DataFrame:
    """How many items each reason took, most first, ties by which came first."""
    found = judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return found.orderBy(F.desc("n"), "first_ord")


def _table(spark, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _unpivot(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    pairs = ", ".join(f"'{x}', `{k}`" for k, x in enumerate(labels))
    return df.selectExpr(f"stack({len(labels)}, {pairs}) as ({name}, n)")


def cost_bands(judged: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """Of items that passed quality, how many are in each cost band, what they sell for, and whether the price
    limits let them in; empty bands are left out."""
    inside = [(F.col("price_n") >= a) & (F.col("price_n") < b) for a, b in COST_BANDS]
    which = F.coalesce(*[F.when(x, k) for k, x in enumerate(inside)])
    out = judged.where("good").groupBy(which.alias("band")).agg(F.count("*").alias("n")).where("band is not null")
    pick = lambda f: F.element_at(F.array(*[F.lit(f(a, b)) for a, b in COST_BANDS]), F.col("band") + 1)
    low, high = pick(lambda a, b: float(a)), pick(lambda a, b: float(min(b, a * 2 + 50)))
    ok = pick(lambda a, b: bool(a >= flags.min_price and b <= flags.max_price + 1))
    return out.select("band", "n", low.alias("low"), num.sell_price(low).alias("sell_low"), num.sell_price(high).alias("sell_high"), ok.alias("in_queue")).orderBy("band")


def excluded_by_band(judged: DataFrame, low: float, high: float) -> DataFrame:
    n = F.count_if((F.col("price_n") < low) | (F.col("price_n") > high))
    return judged.where("good").agg(n.alias("excluded"), F.count("*").alias("total")).withColumn("percent", num.half_up(F.coalesce(F.try_divide(F.col("excluded") * 100.0, "total"), F.lit(0.0))))


def presets(flags: Flags) -> list[tuple]:
    own = (flags.min_sold, flags.min_reviews, flags.min_rating)
    # Fixed values, but for the current ones.
    return [
        ("strict", 1000, 200, 4.5, 25, 110), ("current", *own, flags.min_price, flags.max_price), ("relaxed", 500, 100, 4.3, 20, 150),
        ("loose", 100, 50, 4.0, 15, 200), ("any price", *own, 0, 1e9), ("no filter", 0, 0, 0, 0, 1e9),
    ]


def _qualifies(sold, reviews, rating, low, high) -> Column:
    return (F.col("sold") >= sold) & (F.col("reviews") >= reviews) & (F.col("rating") >= rating) & F.col("price").between(low, high)


def sensitivity(copies: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """How many distinct products each preset of thresholds lets through."""
    rows = presets(flags)
    counts = copies.agg(*[F.count_if(_qualifies(*r[1:])).alias(str(k)) for k, r in enumerate(rows)])
    return _unpivot(counts, [r[0] for r in rows], "preset")


def loosened(copies: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """What loosening one threshold at a time adds to the current ones."""
    s, r, g, lo, hi = flags.min_sold, flags.min_reviews, flags.min_rating, flags.min_price, flags.max_price
    rows = [("current", s, r, g, lo, hi), ("sold -> 500", 500, r, g, lo, hi), ("reviews -> 100", s, 100, g, lo, hi), ("rating -> 4.3", s, r, 4.3, lo, hi), ("price -> any", s, r, g, 0, 1e9)]
    counts = copies.agg(*[F.count_if(_qualifies(*x[1:])).alias(str(k)) for k, x in enumerate(rows)])
    base = counts.select(*[F.col(f"`{k}`") for k in range(5)], *[(F.col(f"`{k}`") - F.col("`0`")).alias(f"d{k}") for k in range(5)])
    pairs = ", ".join(f"'{x[0]}', `{k}`, d{k}" for k, x in enumerate(rows))
    return base.selectExpr(f"stack(5, {pairs}) as (setting, n, delta)")


def shop_band() -> Column:
    return F.coalesce(*[F.when((F.col("price") >= a) & (F.col("price") < b), label) for a, b, label in SHOP_BANDS], F.lit(SHOP_BANDS[-1][2]))


def winners() -> Column:
    return (F.col("sold") >= 1000) & (F.col("reviews") >= 200)


def band_tally(shop: DataFrame) -> DataFrame:
    """Items and winners in each price band; empty bands count 0."""
    got = shop.groupBy(shop_band().alias("band")).agg(F.count("*").alias("n_all"), F.count_if(winners()).alias("n_winners"))
    bands = _table(shop.sparkSession, [(k, x[2]) for k, x in enumerate(SHOP_BANDS)], "k int, label string")
    out = bands.join(F.broadcast(got), bands.label == got.band, "left")  # a row a band
    return out.select("k", "label", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("n_winners", F.lit(0)).alias("n_winners")).orderBy("k")


def shop_summary(shop: DataFrame) -> DataFrame:
    """Medians, cheap shares and markups of a shop's items and of its winners."""
    rows = cut(shop.select("price", winners().alias("win"), num.markup("price").alias("mult")))
    cheap = lambda c: F.count_if(c & (F.col("price") < 15))
    share = lambda a, b: num.half_up(F.try_divide(F.col(a) * 100.0, F.greatest(F.col(b), F.lit(1))))
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if("win").alias("n_win"), cheap(F.lit(True)).alias("_ca"), cheap(F.col("win")).alias("_cw"),
        F.count_if(F.col("win") & (F.col("mult") > 3)).alias("over_3x"), F.count_if(F.col("win") & F.col("price").between(15, 300)).alias("sweet"),
    )
    own = F.struct(F.lit("median_win").alias("of"), F.col("price").alias("v")), F.struct(F.lit("median_markup").alias("of"), F.col("mult").alias("v"))
    every = F.array(F.struct(F.lit("median_all").alias("of"), F.col("price").alias("v")))
    values = rows.select(F.explode(F.when(F.col("win"), F.concat(every, F.array(*own))).otherwise(every)).alias("x")).select("x.*")
    got = {r.of: r.median for r in medians.upper(values, ["of"], "v").collect()}  # three rows
    out = counts.withColumns({c: F.lit(float(got.get(c, 0.0))) for c in ("median_all", "median_win", "median_markup")})
    return out.select("*", share("_ca", "n").alias("cheap_pct"), share("_cw", "n_win").alias("cheap_pct_win")).drop("_ca", "_cw")


def top_sold(shop: DataFrame, n: int = 20, sweet: bool = False) -> DataFrame:
    rows = shop.where(winners() & (F.col("price").between(15, 300) if sweet else F.lit(True)))
    return rows.select("ord", "name", "price", "sold", num.sell_price("price").alias("sell"), num.markup("price").alias("markup")).orderBy(F.desc("sold"), "ord").limit(n)


def competitor_stats(rows: DataFrame, cost: float | None = None) -> DataFrame:
    """Count, least, upper median and a price just under the least, never under the margin's floor."""
    median = medians.upper(rows, [], "price").first()
    out = rows.agg(F.count("*").alias("n"), F.min("price").alias("least")).withColumn("median", F.lit(median and median[0]).cast("double"))
    under = F.greatest(F.col("least") - 1, F.lit(0.0))
    return out.withColumn("undercut", F.greatest(under, num.margin_floor(F.lit(cost)).cast("double")) if cost and cost > 0 else under)


def bake_off(runs: DataFrame) -> DataFrame:
    """Averages of model trials: ``model, ms, cost, has_dim, failed``."""
    return runs.groupBy("model").agg(F.avg("ms").alias("avg_ms"), F.sum("cost").alias("cost"), F.count_if("has_dim").alias("with_dim"), F.count_if("failed").alias("failed"))


def revenue(sales: DataFrame) -> DataFrame:
    """Revenue and profit by local day and category."""
    return sales.groupBy("day", "category").agg(F.sum("price").alias("revenue"), F.sum(F.col("price") - F.col("source_cost")).alias("profit"))


def attribution(sales: DataFrame, listings: DataFrame) -> DataFrame:
    """Sales and revenue of each worker, by the listing sold; sales of no known listing go to no worker."""
    own = listings.select(F.col("id").alias("listing_id"), "assigned_worker_id")
    return sales.join(own, "listing_id", "left").groupBy(F.col("assigned_worker_id").alias("worker_id")).agg(F.count("*").alias("sold"), F.sum("price").alias("revenue"))


def template_medians(listings: DataFrame, template: str = "template") -> DataFrame:
    """Group size and upper median price of listings that share a title template."""
    sizes = listings.groupBy(template).agg(F.count("*").alias("times_listed"))
    median = medians.upper(listings, [template], "price").withColumnsRenamed({template: "_t", "median": "price"})
    return sizes.join(median, F.col(template).eqNullSafe(F.col("_t")), "left").drop("_t")
