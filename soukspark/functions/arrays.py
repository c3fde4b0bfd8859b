"""Arrays of images, models and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soukspark.functions.num import col
from soukspark.functions.text import variant_label


def _none() -> Column:
    return F.array().cast("array<string>")


def with_review_photos(images, reviews) -> Column:
    """The first image, two review photos other than it, then the rest; null or empty images stay as they are."""
    x = col(images)
    extra = F.slice(F.filter(F.coalesce(col(reviews), _none()), lambda r: r.isNotNull() & (r != "") & (r != F.element_at(x, 1))), 1, 2)
    return F.when(F.size(x) > 0, F.concat(F.slice(x, 1, 1), extra, F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))))).otherwise(x)


def sold_models(models) -> Column:
    """Models that have a price and a name."""
    return F.filter(F.coalesce(col(models), F.array()), lambda m: (m["price"] > 0) & (m["name"] != ""))


def variant_groups(models) -> Column:
    """``price, label, image, name`` of each priced and named model; null if there are fewer than two."""
    good = sold_models(models)
    one = lambda m: F.struct(m["price"].alias("price"), variant_label(F.trim(m["name"])).alias("label"), F.nullif(m["image"], F.lit("")).alias("image"), F.trim(m["name"]).alias("name"))
    return F.when(F.size(good) >= 2, F.transform(good, one))


def cover_and_dims(images, dims_index) -> Column:
    x, i = col(images), F.coalesce(col(dims_index), F.lit(0))
    second = F.when(i > 0, F.try_element_at(x, (i + 1).cast("int"))).otherwise(F.try_element_at(x, F.lit(2)))
    return F.when(F.size(x) <= 2, x).otherwise(F.array(F.element_at(x, 1), second))


def second_photo(palette, own, k) -> Column:
    """The first other photo of the palette after place k, going round; null if there is none."""
    p, n = col(palette), F.size(col(palette))
    r = F.pmod(col(k) + 1, F.greatest(n, F.lit(1))).cast("int")
    turned = F.concat(F.slice(p, r + 1, F.greatest(n - r, F.lit(0))), F.slice(p, 1, r))
    return F.try_element_at(F.filter(turned, lambda x: x != col(own)), F.lit(1))


def remapped(answers, batch) -> Column:
    """Answers of a batch with its own places put back to places in the whole; those out of range are dropped."""
    b = col(batch)
    kept = F.filter(col(answers), lambda a: (a["i"] >= 0) & (a["i"] < F.size(b)))
    return F.transform(kept, lambda a: a.withField("i", F.element_at(b, (a["i"] + 1).cast("int"))))


def max_cost(price_max, price_min, models) -> Column:
    prices = F.array_max(F.transform(F.coalesce(col(models), F.array()), lambda m: F.coalesce(m["price"], F.lit(0.0))))
    return F.greatest(F.coalesce(col(price_max), F.lit(0.0)), F.coalesce(col(price_min), F.lit(0.0)), F.coalesce(prices, F.lit(0.0)))


def in_stock(models, sold_out) -> Column:
    return F.filter(col(models), lambda m: ~F.array_contains(F.coalesce(col(sold_out), _none()), m["name"]))


def image_list(*fixed, extra) -> Column:
    more = F.split(F.replace(F.coalesce(col(extra), F.lit("")), F.lit(" "), F.lit("")), ",")
    every = F.concat(F.array(*[F.trim(col(x)) for x in fixed]), more)
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


def new_hashes(hashes, gallery) -> Column:
    return F.array_except(F.array_distinct(col(hashes)), col(gallery))


def description_images(rich, found) -> Column:
    """Images of the description's own value, then those found in its page, each once."""
    return F.array_distinct(F.concat(F.coalesce(col(rich), _none()), F.coalesce(col(found), _none())))


def priced_models(models, page: bool) -> Column:
    """Models with a price: in a page's data one that is there at all, in an item's answer one above 0."""
    return F.filter(col(models), lambda m: m["price"].isNotNull() if page else F.coalesce(m["price"] > 0, F.lit(False)))


def dimension_image(answers, pool) -> Column:
    """The first image that an answer (``i, role``) calls a dimension drawing; answers out of range are passed over."""
    p = col(pool)
    kept = F.filter(col(answers), lambda a: (a["role"] == "dimension") & (a["i"] >= 0) & (a["i"] < F.size(p)))
    return F.element_at(p, (F.try_element_at(F.transform(kept, lambda a: a["i"]), F.lit(1)) + 1).cast("int"))


def review_images(ratings) -> Column:
    """Images of each rating before its videos' covers, distinct, sixty at most."""
    each = F.transform(col(ratings), lambda r: F.concat(F.coalesce(r["images"], _none()), F.coalesce(r["covers"], _none())))
    return F.slice(F.array_distinct(F.flatten(each)), 1, 60)


def scene_lines(text, want: int, fallback: tuple[str, ...]) -> Column:
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*\d.)]+", "")))
    good = F.filter(lines, lambda x: (F.length(x) > 8) & (F.length(x) < 120))
    return F.slice(F.when(F.size(good) >= 2, good).otherwise(F.array(*map(F.lit, fallback))), 1, want)


def guard_warnings(edt_max, review_status, refresh) -> Column:
    """``no-edt`` and ``reviews-blocked``; null where there are none, as listings hold them."""
    found = F.array(F.when(~F.coalesce(col(edt_max) >= 1, F.lit(False)), "no-edt"), F.when((col(review_status) != "") & ~col(review_status).isin("ok", "empty"), "reviews-blocked"))
    kept = F.filter(found, lambda x: x.isNotNull())
    return F.when(~col(refresh) & (F.size(kept) > 0), kept)


def longest_line(text, least: int = 15) -> Column:
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x, i: F.struct(F.length(F.trim(x)).alias("n"), (-i).alias("at"), F.trim(x).alias("t")))
    return F.array_max(F.filter(lines, lambda x: x["n"] > least))["t"]
