"""JSON: known paths as expressions; walks whose order of keys counts as small Arrow-batched Python helpers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soukspark.functions.num import col

_TEXT_KEY = re.compile(r"^(text|content|paragraph|description)$", re.I)
_IMAGE_KEY = re.compile(r"image|img|photo", re.I)
_IMAGE = re.compile(r"^https?://|^[a-z0-9_-]{16,}$", re.I)
RICH = T.StructType([T.StructField("text", T.StringType()), T.StructField("images", T.ArrayType(T.StringType()))])


def rich_text(value, deepest: int = 8) -> tuple[str, list[str]]:
    """Text runs, joined by line feeds, and image values of a rich-text value, in the order of its keys."""
    if isinstance(value, str):
        return value, []
    texts: list[str] = []
    images: list[str] = []
    seen: set[int] = set()
    stack = [iter([(None, value, 0)])]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            continue
        key, x, depth = item
        if isinstance(x, str):
            if key is not None and _TEXT_KEY.match(key):
                texts.append(x)
            elif key is not None and _IMAGE_KEY.search(key) and _IMAGE.search(x):
                images.append(x)
        elif isinstance(x, (dict, list)) and depth <= deepest and id(x) not in seen:
            seen.add(id(x))
            pairs = x.items() if isinstance(x, dict) else ((None, y) for y in x)
            stack.append(iter([(k, y, depth + 1) for k, y in pairs]))
    return "\n".join(texts), images


def _load(x):
    try:
        return json.loads(x) if x is not None else None
    except ValueError:
        return None


@F.udf(returnType=RICH, useArrow=True)
def rich_text_of(x):
    """``text, images`` of a JSON string; of no JSON, or null: empty ones."""
    return rich_text(_load(x))


def copies(value, item: str, deepest: int = 10) -> list[dict]:
    """Objects at any depth whose id is ``item`` and that hold models."""
    out, todo = [], [(value, 0)]
    while todo:
        x, depth = todo.pop()
        if depth > deepest:
            continue
        if isinstance(x, dict):
            if str(x.get("itemid", x.get("item_id"))) == item and isinstance(x.get("models"), list):
                out.append(x)
            todo += [(y, depth + 1) for y in reversed(list(x.values()))]
        elif isinstance(x, list):
            todo += [(y, depth + 1) for y in reversed(x)]
    return out


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def item_copies(x, item):
    """Each copy of an item in a JSON string, as JSON."""
    return [json.dumps(c, ensure_ascii=False) for c in copies(_load(x), str(item))]


def first_number(value, key: str, deepest: int = 6):
    todo = [(value, 0)]
    while todo:
        x, depth = todo.pop(0)
        if isinstance(x, dict):
            if isinstance(x.get(key), (int, float)) and x[key]:
                return int(x[key])
            if depth < deepest:
                todo += [(y, depth + 1) for y in x.values()]
        elif isinstance(x, list) and depth < deepest:
            todo += [(y, depth + 1) for y in x]
    return None


@F.udf(returnType=T.LongType(), useArrow=True)
def shop_id_of(x):
    return first_number(_load(x), "shopid")


OFFER = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType())]))
_AMOUNT = re.compile(r"[\d,.]+")
_NUMBER = re.compile(r"\d*\.?\d+|\d+\.")


def offers(value) -> list[tuple[str, float]]:
    """``title, price`` of objects at any depth that have a title and a price above 0, in the order in which they are
    met; each pair once, titles cut to 90 characters."""
    seen: dict[tuple[str, float], str] = {}
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            raw = next((x[k] for k in ("price", "priceFormatted", "price_formatted") if x.get(k)), None)
            digits = _AMOUNT.search(str(raw)) if x.get("title") and raw is not None else None
            number = _NUMBER.match(digits[0].replace(",", "")) if digits else None
            if number and float(number[0]) > 0:
                seen.setdefault((str(x["title"]), float(number[0])), str(x["title"])[:90])
            todo += reversed(list(x.values()))
    return [(short, price) for (_, price), short in seen.items()]


@F.udf(returnType=OFFER, useArrow=True)
def offers_of(x):
    """``title, price`` of the offers in a JSON string; none of no JSON, or null."""
    return offers(_load(x))


CHANNEL = "array<struct<channel_delivery_info: struct<is_fastest_edt_channel: boolean, estimated_delivery_time_min: int, estimated_delivery_time_max: int>>>"


def delivery_estimate(channels) -> Column:
    """``edt_min, edt_max`` of the fastest channel with an estimate, else of the first with one. JSON in."""
    every = F.transform(F.from_json(col(channels), CHANNEL), lambda c: c["channel_delivery_info"])
    timed = F.filter(every, lambda c: c["estimated_delivery_time_max"] > 0)
    fast = F.filter(timed, lambda c: F.coalesce(c["is_fastest_edt_channel"], F.lit(False)))
    pick = F.coalesce(F.try_element_at(fast, F.lit(1)), F.try_element_at(timed, F.lit(1)))
    return F.struct(pick["estimated_delivery_time_min"].alias("edt_min"), pick["estimated_delivery_time_max"].alias("edt_max"))


def first_path(x, *paths: str) -> Column:
    """The first of the JSON paths that is there."""
    return F.coalesce(*[F.nullif(F.get_json_object(col(x), p), F.lit("")) for p in paths])


def rating(x) -> Column:
    return first_path(x, "$.item_rating.rating_star", "$.product_review.rating_star", "$.rating_star").try_cast("double")


def category(x) -> Column:
    return first_path(x, "$.categories[0].display_name", "$.fe_categories[0].display_name", "$.categories[0].name")


ITEM = """name string, description string, images array<string>, price_min double, price_max double, price double, historical_sold long,
 sold long, stock long, models array<struct<name: string, price: double, has_stock: boolean, image: string>>"""


def item_payload(x, cdn: str) -> Column:
    """Title, description, images, prices and stock of an item's JSON: under ``item``, ``data.item`` or ``data``."""
    raw = F.coalesce(*[F.get_json_object(col(x), p) for p in ("$.item", "$.data.item", "$.data")])
    i = F.from_json(raw, ITEM)
    real = lambda *cs: F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs], F.lit(0))
    models = F.transform(F.filter(i["models"], lambda m: m["price"] > 0), lambda m: F.struct(m["name"].alias("name"), (m["price"] / 1e5).alias("price"), m["image"].alias("image")))
    return F.when(F.coalesce(i["name"], F.lit("")) != "", F.struct(
        i["name"].alias("title"), F.coalesce(i["description"], F.lit("")).alias("description"),
        F.slice(F.transform(F.coalesce(i["images"], F.array().cast("array<string>")), lambda h: F.concat(F.lit(cdn), h)), 1, 9).alias("images"),
        (real(i["price_min"], i["price"]) / 1e5).alias("price"), (real(i["price_max"], i["price"]) / 1e5).alias("price_max"),
        real(i["historical_sold"], i["sold"]).alias("sold"), F.coalesce(i["stock"], F.lit(0)).alias("stock"), models.alias("models"),
    ))
