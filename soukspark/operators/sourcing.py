"""The sourcing cascade: every item gets the first reason against it, or none.

Columns in: ``ord, item_id, shop_id, shop_name, name, url, price, sold_text, reviews, rating, location, is_mock,
blocked``. Facts about shops and first copies are map-side combined aggregates joined back, so a shop or product
that holds much of the input does not sit in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukspark.config import LOW_RATING_FACTOR, NEAR, OVERSEAS, PRICE_BARS, RATING_NEEDS, SG_TITLE, SG_TITLE_PARTS, Flags
from soukspark.functions import num, text
from soukspark.scratch import discard, stored

REASONS = ("mock", "blocked", "not-local", "no-url", "duplicate", "zero-reviews", "sold", "reviews", "rating", "price-min", "price-max")


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _has(low: Column, parts) -> Column:
    """Whether a lower-cased text holds any of the parts: plain searches, which cost less than a pattern."""
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def abroad(flags: Flags) -> Column:
    return _has(_lower("location"), OVERSEAS[flags.near_abroad].split("|"))


def claims_local(flags: Flags) -> Column:
    """Words are looked for by pattern only where their letters are there at all."""
    where = F.trim(_lower("location"))
    whole, *parts = NEAR[flags.near_abroad].split("|")
    near = (where == whole.strip("^$")) | _has(where, parts)
    word = lambda c, words, pattern: F.when(_has(_lower(c), words), F.col(c).rlike(f"(?i){pattern}")).otherwise(False)
    title = _has(_lower("name"), SG_TITLE_PARTS) | word("name", SG_TITLE, "|".join(map(text.word, SG_TITLE)))
    shop = _lower("shop_name").contains("singapore") | word("shop_name", ["sg"], rf"\.sg{text.RIGHT}|{text.word('sg')}")
    return near | title | shop


def bar(flags: Flags) -> Column:
    """``sold, reviews, rating`` needed at the item's price."""
    flat = F.struct(F.lit(flags.min_sold).alias("sold"), F.lit(flags.min_reviews).alias("reviews"), F.lit(float(flags.min_rating)).alias("rating"))
    out = flat
    for least, sold, reviews, rating in reversed(PRICE_BARS) if flags.scale_by_price else ():
        own = F.struct(F.lit(sold).alias("sold"), F.lit(reviews).alias("reviews"), F.lit(float(rating)).alias("rating"))
        out = F.when(F.col("price_n") >= least, own).otherwise(out)
    return out


def reviews_needed(rating: Column, reviews: Column) -> Column:
    out = num.half_up(reviews * LOW_RATING_FACTOR)
    for least, factor, floor in reversed(RATING_NEEDS):
        out = F.when(rating >= least, F.greatest(F.lit(floor), num.half_up(reviews * factor))).otherwise(out)
    return out


def prepared(items: DataFrame, flags: Flags) -> DataFrame:
    """Items with numbers, product ids and what they say of their place."""
    return items.withColumns({
        "url_clean": F.coalesce(text.before("url", "?"), F.lit("")),
        "sold": num.sold_to_number("sold_text"), "reviews_n": num.number_or_zero("reviews"),
        "rating_n": num.number_or_zero("rating"), "price_n": num.number_or_zero("price"),
        "abroad": abroad(flags), "claims": claims_local(flags), "mock": F.coalesce("is_mock", F.lit(False)), "listed": F.coalesce("blocked", F.lit(False)),
    }).withColumns({"product_id": text.product_id("url_clean"), "linked": F.col("url_clean") != ""})


#: What verdicts are made of; texts take no part.
NARROW = ["ord", "shop_id", "product_id", "sold", "reviews_n", "rating_n", "price_n", "abroad", "claims", "mock", "listed", "linked"]


def narrow(items: DataFrame, flags: Flags) -> DataFrame:
    return prepared(items, flags).select(*NARROW)


def shop_facts(rows: DataFrame, flags: Flags, shop: str = "shop_id") -> DataFrame:
    """``_shop, local_shop, proven_shop``: whether a shop has a row that claims to be local, or one that clears the flat bar."""
    clears = (F.col("sold") >= flags.min_sold) & (F.col("reviews_n") >= flags.min_reviews) & (F.col("rating_n") >= flags.min_rating)
    real = ~F.col("mock")
    return rows.groupBy(F.col(shop).alias("_shop")).agg(F.bool_or(real & ~F.col("abroad") & F.col("claims")).alias("local_shop"), F.bool_or(real & clears).alias("proven_shop"))


def _early(flags: Flags) -> Column:
    local = ~F.col("abroad") & (F.col("claims") | F.col("local_shop")) if flags.local_only else F.lit(True)
    return F.when(F.col("mock"), "mock").when(F.col("listed"), "blocked").when(~local, "not-local").when(~F.col("linked"), "no-url")


def _own(flags: Flags) -> Column:
    """The reason against a row that it gives by itself, whatever its shop and other copies are."""
    out = F.when(F.col("mock"), "mock").when(F.col("listed"), "blocked")
    return out.when(F.col("abroad"), "not-local") if flags.local_only else out


def _quality(flags: Flags) -> Column:
    vouched = F.lit(flags.trust_shops) & F.col("proven_shop") & (F.col("reviews_n") >= flags.trust_reviews)
    need = bar(flags)
    return F.coalesce(
        F.when(F.col("reviews_n") < 1, "zero-reviews"),
        F.when(~vouched, F.coalesce(
            F.when(F.col("sold") < need["sold"], "sold"),
            F.when(F.col("reviews_n") < reviews_needed(F.col("rating_n"), need["reviews"]), "reviews"),
            F.when(F.col("rating_n") < need["rating"], "rating"),
        )),
    )


def passing(rows: DataFrame, flags: Flags) -> DataFrame:
    """Rows (narrow, with their shop's facts) that pass all but price and duplicates."""
    return rows.where(_early(flags).isNull() & _quality(flags).isNull())


def verdict(rows: DataFrame, firsts: DataFrame, flags: Flags) -> DataFrame:
    """``rows`` (narrow, with their shop's facts) with ``reason`` and ``good``; ``firsts``: ``_id, _first``."""
    rows = rows.join(firsts, F.col("product_id") == F.col("_id"), "left")
    price = F.coalesce(F.when(F.col("price_n") < flags.min_price, "price-min"), F.when(F.col("price_n") > flags.max_price, "price-max"))
    rows = rows.withColumns({"_early": _early(flags), "_quality": _quality(flags), "_late": F.when(F.col("ord") > F.col("_first"), "duplicate")})
    good = F.col("_early").isNull() & F.col("_late").isNull() & F.col("_quality").isNull()
    return rows.withColumns({"reason": F.coalesce("_early", "_late", "_quality", price), "good": good}).drop("_early", "_quality", "_late", "_id", "_first")


def _judged(rows: DataFrame, narrow_rows: DataFrame, flags: Flags) -> DataFrame:
    """``rows``, of which ``narrow_rows`` are the narrow form, with what their shops' facts and products' first copies make
    of them."""
    facts = stored(shop_facts(narrow_rows, flags), "shops")
    # an unknown shop is one shop
    known = lambda df: df.join(facts, F.col("shop_id").eqNullSafe(F.col("_shop")), "left").drop("_shop")
    firsts = stored(passing(known(narrow_rows), flags).groupBy(F.col("product_id").alias("_id")).agg(F.min("ord").alias("_first")), "firsts")
    return verdict(known(rows), firsts, flags)


def judged(items: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """The narrow rows of ``items`` with ``reason`` and ``good``. The items are read once."""
    rows = stored(narrow(items, flags), "narrow")
    return _judged(rows, rows, flags)


def cascade(items: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """Items with ``reason`` (null: kept), ``good`` (passed quality, whatever its price) and ``sell``. They are read three
    times, once in narrow form; rows that their own columns rule out meet no others.

    A copy of a product is a duplicate only after an earlier one that passed quality: copies that failed do not
    count, those that only their price excluded do. Null flags count as false, null and unreadable numbers as 0.
    """
    rows = stored(narrow(items, flags), "narrow")
    own = _own(flags)
    # rows that are alike in narrow form are judged alike, so what was said of them is there once, and wide rows meet it alone
    said = stored(_judged(rows.where(own.isNull()), rows, flags).groupBy(*_known()).agg(F.first("reason").alias("reason"), F.first("good").alias("good")), "said")
    discard(rows)
    wide = prepared(items, flags)
    out = wide.where(own.isNull()).withColumns({"_k": _known()[0], "_h": _known()[1]}).join(said, ["_k", "_h"]).drop("_k", "_h")
    out = out.unionByName(wide.where(own.isNotNull()).withColumns({"reason": own, "good": F.lit(False)}))
    return out.withColumn("sell", num.sell_price("price_n")).drop("mock", "listed", "linked")


def _known() -> list[Column]:
    """A row by its number and what verdicts are made of, for tables in which numbers come twice or are missing."""
    return [F.coalesce("ord", F.lit(0)).cast("long").alias("_k"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in NARROW]).alias("_h")]


def kept(judged: DataFrame) -> DataFrame:
    out = judged.where("reason is null").orderBy(F.desc("sold"), F.desc("reviews_n"), "ord")
    return out.select("ord", "url_clean", "name", "price_n", "sell", "sold", "reviews_n", "rating_n", "shop_name")


def rejects(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").orderBy(F.desc("reviews_n"), F.desc("rating_n"), "ord")


def first_copies(items: DataFrame) -> DataFrame:
    """One row for each product: its first real copy with a URL."""
    rows = items.where(~F.coalesce("is_mock", F.lit(False)) & (F.coalesce("url", F.lit("")) != "")).withColumn("product_id", text.product_id("url"))
    one = F.struct(num.sold_to_number("sold_text").alias("sold"), num.number_or_zero("reviews").alias("reviews"), num.number_or_zero("rating").alias("rating"), num.number_or_zero("price").alias("price"))
    return rows.groupBy("product_id").agg(F.min_by(one, "ord").alias("x")).select("product_id", "x.*")
