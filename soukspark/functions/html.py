"""Product facts in page HTML, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soukspark.functions.num import col

_Q, _NQ = "[\"']", "([^\"']+)"


def meta(html, name: str) -> Column:
    """Content of the first meta tag of a property or name, attributes in either order; empty if there is none."""
    one = rf"(?i)<meta[^>]+(?:property|name)={_Q}{name}{_Q}[^>]+content={_Q}{_NQ}{_Q}"
    two = rf"(?i)<meta[^>]+content={_Q}{_NQ}{_Q}[^>]+(?:property|name)={_Q}{name}{_Q}"
    get = lambda p: F.nullif(F.regexp_extract(col(html), p, 1), F.lit(""))
    return F.coalesce(get(one), get(two), F.lit(""))


def title(html) -> Column:
    return F.regexp_extract(col(html), r"(?is)<title>(.*?)</title>", 1)


def image_urls(html, market: str, cdns: tuple[str, ...], most: int = 9) -> Column:
    """Distinct image URLs without their queries: preview images that name the market, then those of each CDN, given
    as expressions of a whole URL."""
    og = F.regexp_extract_all(col(html), F.lit(rf"(?i)<meta[^>]+property={_Q}og:image(?::\w+)?{_Q}[^>]+content={_Q}{_NQ}{_Q}"), 1)
    found = [F.filter(og, lambda x: x.contains(market)), *[F.regexp_extract_all(col(html), F.lit(f"(?i){p}"), 0) for p in cdns]]
    return F.slice(F.array_distinct(F.transform(F.concat(*found), lambda x: F.substring_index(x, "?", 1))), 1, most)


def clean_title(x, site: str) -> Column:
    """Without the site's name after a bar or a dash at the end."""
    name = site.replace(" ", r"\s+")
    out = F.regexp_replace(col(x), rf"(?i)\s*\|\s*{name}\s*$", "")
    return F.trim(F.regexp_replace(out, rf"(?i)\s*-\s*{name}\s*$", ""))


def clean_description(x) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s*-\s*Buy\s+.{0,120}$", ""))


def json_ld_product(html) -> Column:
    """``name, description`` of the first product with a name in structured data; blocks that are no JSON are
    passed over. Empty strings if there is none."""
    blocks = F.regexp_extract_all(col(html), F.lit(rf"(?is)<script[^>]+type={_Q}application/ld\+json{_Q}[^>]*>(.*?)</script>"), 1)
    one = "struct<`@type`: string, name: string, description: string>"
    read = lambda b: F.coalesce(F.when(F.trim(b).startswith("["), F.from_json(b, f"array<{one}>")), F.array(F.from_json(b, one)))
    found = F.filter(F.flatten(F.transform(blocks, read)), lambda p: (p["@type"] == "Product") & (p["name"] != ""))
    first = F.try_element_at(found, F.lit(1))
    return F.struct(F.coalesce(first["name"], F.lit("")).alias("name"), F.coalesce(first["description"], F.lit("")).alias("description"))


def product(html, site: str, market: str, cdns: tuple[str, ...]) -> Column:
    """``title, description, images``; null where nothing was found. The page's own tags come first, structured data
    where they are missing or the title is the site's."""
    t, d = clean_title(meta(html, "og:title"), site), clean_description(meta(html, "og:description"))
    ld = json_ld_product(html)
    own = (t != "") & ~t.rlike("(?i)^" + site.replace(" ", r"\s+") + "(?![A-Za-z0-9_])")
    name = F.when(own, t).otherwise(F.coalesce(F.nullif(ld["name"], F.lit("")), F.lit("")))
    text = F.coalesce(F.nullif(d, F.lit("")), ld["description"])
    images = image_urls(html, market, cdns)
    return F.when((name != "") | (text != "") | (F.size(images) > 0), F.struct(name.alias("title"), text.alias("description"), images.alias("images")))
