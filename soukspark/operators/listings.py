"""Expanding a product into listings: by cover, by variant, single, or by backdrop.

In: ``product, url, title, ai_title, ai_description, cost, models, images, review_images, refresh, warnings`` of
accepted products. Out: rows of ``listing_url, title, ai_title, ai_description, source_cost, sell_price, images``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soukspark.config import LEAD_TIME_DAYS
from soukspark.functions import arrays, num, text
from soukspark.operators.load import insert_ignore


def outcome(inbox: DataFrame) -> DataFrame:
    """``outcome`` of scraped rows: unloaded, no-url, lead-time-too-long, duplicate, refresh or ok. In: ``unloaded,
    listing_url, edt_max, action`` (of ``fuzzy.existing``)."""
    refresh = F.col("action") == "refresh"
    late = ~refresh & (F.col("edt_max") >= LEAD_TIME_DAYS)
    said = F.when(F.coalesce("unloaded", F.lit(False)), "unloaded").when(F.coalesce("listing_url", F.lit("")) == "", "no-url")
    said = said.when(F.col("action") == "block", "duplicate").when(late, "lead-time-too-long").when(refresh, "refresh").otherwise("ok")
    return inbox.withColumn("outcome", said)


def by_variant(products: DataFrame) -> DataFrame:
    """One row for each priced model of products that have two or more. Two photos: the first of its colour, and the
    next other colour's; without a photo of its colour, the product's first two."""
    rows = products.where(F.size(arrays.sold_models("models")) >= 2)  # not by the groups, which the filter would build again
    rows = rows.select("product", "url", "title", "ai_title", "ai_description", "images", arrays.variant_groups("models").alias("groups"))
    # what holds for the whole product is found once, before it becomes rows; each name's colour once, too
    rows = rows.withColumn("groups", F.transform("groups", lambda g: g.withField("colour", text.colour_key(g["name"]))))
    # first photo of each colour, in the order in which colours with a photo first appear
    rows = rows.withColumn("_shots", F.transform(F.filter("groups", lambda g: g["image"].isNotNull()), lambda g: F.struct(g["colour"].alias("colour"), g["image"].alias("image"))))
    first = F.filter("_shots", lambda s, i: F.array_position(F.col("_shots.colour"), s["colour"]) == i + 1)
    rows = rows.withColumn("_first", first).withColumn("_palette", F.array_distinct(F.transform("_first", lambda a: a["image"])))
    rows = rows.withColumn("ai_description", text.without_sizes("ai_description")).drop("_shots")
    one = rows.select("*", F.posexplode_outer("groups").alias("k", "g"))  # never empty; a plain one is given a filter that builds the groups again
    own = F.try_element_at(F.transform(F.filter("_first", lambda a: a["colour"] == F.col("g.colour")), lambda a: a["image"]), F.lit(1))
    one = one.withColumn("_own", own)
    pair = F.filter(F.array("_own", arrays.second_photo("_palette", "_own", "k")), lambda x: x.isNotNull())
    images = F.when(F.col("_own").isNotNull(), pair).otherwise(F.slice(F.coalesce("images", F.array().cast("array<string>")), 1, 2))
    return one.select(
        "product", F.concat("url", F.lit("#"), text.encode_component("g.name")).alias("listing_url"), "title", text.variant_title("ai_title", "g.label").alias("ai_title"),
        "ai_description", F.col("g.price").alias("source_cost"), num.sell_price("g.price").alias("sell_price"), images.alias("images"),
    )


def single(products: DataFrame) -> DataFrame:
    """One row for each product that is not split."""
    rows = products.where(arrays.variant_groups("models").isNull())
    cost = F.when(F.col("cost") > 0, F.col("cost"))
    return rows.select("product", F.col("url").alias("listing_url"), "title", "ai_title", "ai_description", cost.alias("source_cost"), num.sell_price(cost).alias("sell_price"), arrays.with_review_photos("images", "review_images").alias("images"))


def cover_map(answers: DataFrame) -> DataFrame:
    """``product, url, needs_clean, ord`` of covers: each once, to be cleaned if any copy has to be. In: ``product, i,
    role, needs_clean, url``."""
    rows = answers.where("role = 'cover' and url is not null")
    return rows.groupBy("product", "url").agg(F.bool_or(F.coalesce("needs_clean", F.lit(False))).alias("needs_clean"), F.min("i").alias("ord"))


def clean_gate(covers: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """Covers as they will be shown: those to be cleaned only in their cleaned form (``product, url, cleaned_url``)."""
    if cleaned is None:
        return covers.where(~F.col("needs_clean")).withColumn("cover", F.col("url"))
    out = covers.join(cleaned, ["product", "url"], "left")
    return out.withColumn("cover", F.when(F.col("needs_clean"), F.col("cleaned_url")).otherwise(F.col("url"))).where("cover is not null").drop("cleaned_url")


def by_cover(products: DataFrame, covers: DataFrame, dims: DataFrame) -> DataFrame:
    """One row for each usable cover, numbered in order. ``dims``: ``product, dims_url`` of a size chart."""
    k = F.row_number().over(Window.partitionBy("product").orderBy("ord")) - 1  # covers of one product
    rows = covers.select("product", "cover", "ord").withColumn("k", k).join(products, "product").join(dims, "product", "left")
    lead = F.filter(F.array("cover", F.when(F.col("dims_url") != F.col("cover"), F.col("dims_url"))), lambda x: x.isNotNull())
    cost = F.when(F.col("cost") > 0, F.col("cost"))
    return rows.select(
        "product", F.concat("url", F.lit("#c"), F.col("k").cast("string")).alias("listing_url"), "title", F.when(F.col("ai_title").isNotNull(), text.rotate_title("ai_title", "k")).alias("ai_title"),
        "ai_description", cost.alias("source_cost"), num.sell_price(cost).alias("sell_price"), arrays.with_review_photos(lead, "review_images").alias("images"),
    )


KEPT = ("assigned_worker_id", "own_account", "ai_title", "ai_description", "images", "guard_warnings", "source_cost", "sell_price")


def refreshed(listings: DataFrame, scraped: DataFrame) -> DataFrame:
    """The snapshot after products were scraped again: a live listing takes over the staff member, texts, images, warnings
    and prices of the row that names it, nulls too (``changed``). In: ``existing_id`` and ``KEPT`` with ``action`` (of
    ``fuzzy.existing``) and ``ord``; of rows for one listing the last by ``ord`` counts."""
    rows = scraped.where("action = 'refresh' and existing_id is not null")
    last = rows.groupBy(F.col("existing_id").alias("id")).agg(F.max_by(F.struct(*KEPT), "ord").alias("_new"))
    out = listings.join(last, "id", "left").withColumn("changed", F.col("_new").isNotNull())
    return out.withColumns({c: F.when(F.col("changed"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in KEPT}).drop("_new")


def fresh(listings: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose URL no live listing has, of equal URLs the one of least ``ord``: what an insert adds. After it, the same
    rows add none. Rows without a URL are always added."""
    return insert_ignore(listings.where("status <> 'deleted'"), rows, ["listing_url"])


def of_worker(listings: DataFrame, worker: str | None = None) -> DataFrame:
    """A staff member's active listings, or everybody's, oldest first, as they may be shown: without what a product costs."""
    rows = listings.where((F.col("status") == "active") & (F.col("assigned_worker_id") == worker if worker else F.lit(True)))
    return rows.drop("source_cost").orderBy("assigned_worker_id", "created_at", "id")


def chats(rows: DataFrame, most: int = 50) -> DataFrame:
    """The first chats of each capture (``capture, ord, href``), each link once."""
    first = rows.groupBy("capture", "href").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("capture", "href")]), "ord").alias("x")).select("capture", "href", "x.*")
    rank = F.row_number().over(Window.partitionBy("capture").orderBy("ord"))  # stops at ``most`` of a capture
    return first.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def free_slots(sources: DataFrame, listings: DataFrame, backdrops: int, angles: int, want: int) -> DataFrame:
    """``id, slot, backdrop, angle``: the first free shots of each source listing (``id, url``), backdrops changing
    fastest. A slot is taken by a live listing of the base URL with ``#v{id}-{slot}``."""
    base = text.before("url", "#")
    rows = sources.select("id", base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(backdrops * angles - 1))).alias("slot"))
    rows = rows.withColumn("listing_url", F.concat("base", F.lit("#v"), F.col("id").cast("string"), F.lit("-"), F.col("slot").cast("string")))
    free = rows.join(listings.where("status <> 'deleted'").select("listing_url"), "listing_url", "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("slot"))  # backdrops times angles rows at most
    free = free.withColumn("_r", rank).where(F.col("_r") <= want)
    return free.select("id", "slot", (F.col("slot") % backdrops).alias("backdrop"), (F.floor(F.col("slot") / backdrops) % angles).cast("int").alias("angle"))


def by_backdrop(sources: DataFrame, shots: DataFrame) -> DataFrame:
    """One row for each passed shot (``id, slot, shot_url``) of a source listing (``id, url, title, ai_title,
    ai_description, source_cost, sell_price, images``)."""
    rows = shots.join(sources, "id")
    dims = F.try_element_at("images", F.lit(2))
    url = F.concat(text.before("url", "#"), F.lit("#v"), F.col("id").cast("string"), F.lit("-"), F.col("slot").cast("string"))
    title = F.when(F.col("ai_title").isNotNull(), text.rotate_title("ai_title", F.col("slot") + 1))
    images = F.filter(F.array("shot_url", dims), lambda x: x.isNotNull())
    return rows.select("id", url.alias("listing_url"), "title", title.alias("ai_title"), "ai_description", "source_cost", "sell_price", images.alias("images"))


def batches(pool: DataFrame, size: int = 20) -> DataFrame:
    """``pool`` (``product, i``) with ``batch``: each product's images dealt round over as many batches as it needs."""
    n = pool.groupBy("product").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    out = pool.join(n, pool["product"].eqNullSafe(n["product"])).drop(n["product"])
    return out.withColumn("batch", F.pmod(F.col("i"), F.greatest("_n", F.lit(1)))).drop("_n")


def colours(models: DataFrame) -> DataFrame:
    """``product, n_variants, n_colours``."""
    return models.groupBy("product").agg(F.count("*").alias("n_variants"), F.count_distinct(text.colour_key("name")).alias("n_colours"))


def swatches(models: DataFrame, options: DataFrame, parts: int | None = None) -> DataFrame:
    """Models with a missing image filled by that of the option at their place: models ``product, name, image,
    tier_index``, options ``product, images``; of options that share a name the last wins. ``parts`` (of
    ``scratch.parts``) is the least number of tasks that rows are dealt into by their keys; without it Spark sizes tasks by
    shuffled bytes, of which a task sorts some twenty times as many."""

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, *keys) if parts else df

    at = F.try_element_at("images", (F.col("tier_index") + 1).cast("int"))
    named = dealt(models, "product").join(dealt(options, "product"), "product").select("product", "name", at.alias("swatch"), "pos").where("swatch is not null")
    last = named.groupBy("product", "name").agg(F.max_by("swatch", "pos").alias("swatch"))
    rows = dealt(models, "product", "name").join(last, ["product", "name"], "left")  # last is dealt alike
    return rows.withColumn("image", F.coalesce("image", "swatch")).drop("swatch")


def merged_copies(copies: DataFrame) -> DataFrame:
    """One row for each item: prices from its first priced copy, text and images from the first that has them (else
    from the priced one). In: ``item, ord, price, description, images``."""
    priced = lambda c: F.min_by(c, F.when(F.col("price").isNotNull(), F.col("ord")))
    has = lambda c, ok: F.min_by(c, F.when(ok, F.col("ord")))
    return copies.groupBy("item").agg(
        priced("price").alias("price"), F.coalesce(has("description", F.col("description") != ""), priced("description")).alias("description"),
        F.coalesce(has("images", F.size("images") > 0), priced("images")).alias("images"),
    )


def link_faults(listings: DataFrame) -> DataFrame:
    """Done listings whose sold link is missing or is none of the marketplace's."""
    return listings.where((F.col("status") == "done") & ~F.coalesce(valid_link("sold_url"), F.lit(False)))


def valid_link(url) -> F.Column:
    u = num.col(url)
    return u.rlike(r"(?i)carousell\.") & u.rlike("(?i)/p/|/sell/|app.link")


def resolved(urls: DataFrame, links: DataFrame) -> DataFrame:
    """``url`` with short links replaced by where they lead (``short, target``); unknown ones stay."""
    return urls.join(links, urls["url"] == links["short"], "left").withColumn("url", F.coalesce("target", "url")).drop("short", "target")


def extra_warnings(products: DataFrame, categories: list[str], least_rating: float = 4.0, low: float = 15, high: float = 150) -> DataFrame:
    """``warnings`` by rules that are off unless asked for: category, seller's place, rating, cost. Fields that were not
    captured raise none. In: ``category, shop_location, rating, cost``."""
    found = F.array(
        F.when(~F.col("category").isin(categories), "category"), F.when(~F.lower("shop_location").contains("singapore"), "seller"),
        F.when(F.col("rating") < least_rating, "rating"), F.when(~F.col("cost").between(low, high), "cost"),
    )
    return products.withColumn("warnings", F.filter(found, lambda x: x.isNotNull()))


def duplicate_log(found: DataFrame, products: DataFrame, now: str) -> DataFrame:
    """Rows for the log of near duplicates: the product, the listing it is like, and how much. In: pairs of
    ``fuzzy.best_match``; products ``id, title, listing_url``."""
    rows = found.join(products.select(F.col("id").alias("probe_id"), "title", "listing_url"), "probe_id")
    return rows.select("probe_id", "title", "listing_url", F.col("id").alias("matched_id"), "score", F.to_timestamp(F.lit(now)).alias("logged_at"))


def search(listings: DataFrame, words: str, assigned: bool | None = None) -> DataFrame:
    """Listings whose title or AI title holds the words, in any case; assigned to a worker or not, if asked."""
    w = words.lower()
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(w) | F.lower(F.coalesce("ai_title", F.lit(""))).contains(w)
    out = listings.where(hit)
    return out if assigned is None else out.where(F.col("assigned_worker_id").isNotNull() == assigned)


def to_regenerate(listings: DataFrame, n: int = 2) -> DataFrame:
    """The first listings, by age, that still lack an AI title."""
    return listings.where(F.coalesce("ai_title", F.lit("")) == "").orderBy("created_at", "id").limit(n)


def oldest_pending(inbox: DataFrame, n: int = 3) -> DataFrame:
    return inbox.where(~F.coalesce("consumed", F.lit(False))).orderBy("id").limit(n)
