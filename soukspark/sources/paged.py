"""Paged listings as a Python data source, ``paged_listing``: shops' items or products' ratings.

Options: ``fetch`` (``module:function``, called with key, page, size and the options, giving a list of records as dicts; nothing is
fetched from a network here), ``keys`` (shops or products, a JSON array), ``kind`` (``items`` or ``ratings``), ``size`` and
``pages`` (at most; 100 and 40 for items, 50 and 6 for ratings).

A key's pages are read one after another, up to the first that is empty or fails, and an item that came before is left
out: a listing that moves on while it is read gives items twice. Keys are read by a task each. As a stream the offset is
the place in all keys' pages, and a page that fails ends the query; a restart goes on at that page.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from soukspark.functions import arrays

ITEMS = """key string, page int, pos int, itemid long, shopid long, name string, price double, price_min double, price_max double, sold long,
 month_sold long, rating double, reviews long, stock long, liked long, image string, cat long"""
#: A last row for each key has no place (-1) and says in ``failed`` why its pages ended, if not by their end.
RATINGS = "key string, page int, pos int, images array<string>, covers array<string>, failed string"
SCHEMAS = {"items": ITEMS, "ratings": RATINGS}
#: page size, pages, and distinct images after which no further ratings are read
LIMITS = {"items": (100, 40), "ratings": (50, 6)}
ENOUGH = 60


class Blocked(OSError):
    """The source wants a login, or takes the reader for a robot."""


def item(key: str, page: int, pos: int, record: dict) -> tuple:
    """A listing's record as a row; prices are in hundred-thousandths, what is missing counts 0."""
    b = record.get("item_basic") or record
    price, rating = b.get("price") or 0, b.get("item_rating") or {}
    count = rating.get("rating_count") or [0]
    return (
        key, page, pos, b.get("itemid"), b.get("shopid"), b.get("name"), price / 1e5, (b.get("price_min") or price) / 1e5, (b.get("price_max") or price) / 1e5,
        b.get("historical_sold") or b.get("sold") or 0, b.get("sold") or 0, float(rating.get("rating_star") or 0), count[0] or 0,
        b.get("stock") or 0, b.get("liked_count") or 0, b.get("image") or None, b.get("catid"),
    )


def rating(key: str, page: int, pos: int, record: dict) -> tuple:
    images = [h for h in record.get("images") or () if h]
    covers = [v["cover"].split("?")[0] for v in record.get("videos") or () if v and v.get("cover")]
    return key, page, pos, images, covers, None


def reason(e: OSError) -> str:
    return "blocked" if isinstance(e, Blocked) else "timeout" if isinstance(e, TimeoutError) else "error"


class _Pages:
    def __init__(self, options):
        self.options, self.kind = dict(options), options.get("kind", "items")
        size, pages = LIMITS[self.kind]
        self.size, self.pages = int(options.get("size", size)), int(options.get("pages", pages))
        self.keys, self.name = json.loads(options["keys"]), options["fetch"]

    def fetch(self, key: str, page: int) -> list[dict]:
        module, _, name = self.name.partition(":")
        return getattr(importlib.import_module(module), name)(key, page, self.size, self.options)

    def rows(self, key: str, page: int, records: list[dict], seen: set) -> Iterator[tuple]:
        for pos, r in enumerate(records):
            if self.kind == "ratings":
                row = rating(key, page, pos, r)
                seen.update(row[3], row[4])
                yield row
            elif (row := item(key, page, pos, r))[3] not in seen:
                seen.add(row[3])
                yield row


class PageReader(_Pages, DataSourceReader):
    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        key, seen, failed = partition.value, set(), None
        for page in range(self.pages):
            if self.kind == "ratings" and len(seen) >= ENOUGH:
                break
            try:
                records = self.fetch(key, page)
            except OSError as e:
                failed = reason(e)
                break
            if not records:
                break
            yield from self.rows(key, page, records, seen)
        if self.kind == "ratings":
            yield key, None, -1, None, None, failed


class PageStream(_Pages, SimpleDataSourceStreamReader):
    """A page a batch. Items that come on two pages are left out downstream (``distinct_items``)."""

    def initialOffset(self):
        return {"key": 0, "page": 0}

    def _after(self, at: dict, more: bool) -> dict:
        if more and at["page"] + 1 < self.pages:
            return {"key": at["key"], "page": at["page"] + 1}
        return {"key": at["key"] + 1, "page": 0}

    def read(self, start):
        if start["key"] >= len(self.keys):
            return iter(()), start
        key = self.keys[start["key"]]
        records = self.fetch(key, start["page"])
        return iter([*self.rows(key, start["page"], records, set())]), self._after(start, bool(records))

    def readBetweenOffsets(self, start, end):
        out = []
        while start != end:
            rows, start = self.read(start)
            out += rows
        return iter(out)


class PagedListing(DataSource):
    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "items")]

    def reader(self, schema):
        return PageReader(self.options)

    def simpleStreamReader(self, schema):
        return PageStream(self.options)


def distinct_items(rows: DataFrame) -> DataFrame:
    """Each item of a shop once; on a stream the first that came, held as state."""
    return rows.dropDuplicates(["key", "itemid"])


def reviews(ratings: DataFrame) -> DataFrame:
    """``key, review_images, review_status`` of ratings as read: images before covers rating by rating, sixty at most;
    ``ok`` where there are any, else why there are none (``empty`` if the source had none)."""
    last, rows = F.col("pos") == -1, F.struct("page", "pos", "images", "covers")
    # a key has pages times size ratings at most
    out = ratings.groupBy("key").agg(F.sort_array(F.collect_list(F.when(~last, rows))).alias("r"), F.max(F.when(last, F.col("failed"))).alias("failed"))
    return out.select("key", arrays.review_images("r").alias("review_images"), "failed").select("key", "review_images", _status().alias("review_status"))


def _status() -> Column:
    return F.when(F.size("review_images") > 0, "ok").otherwise(F.coalesce("failed", F.lit("empty")))
