"""Strings: product ids and URLs, titles, descriptions, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soukspark.config import BANNED_TITLE_WORDS, CLOSING, COLOUR_WORDS, DELIVERY, DIMENSIONS, OPENING, OPTIONS, PAYMENT, SEGMENTS, SIZES_LINE, TITLE_LENGTH, TITLE_TAGS
from soukspark.functions.num import col

#: Word boundaries as ASCII sees them; Java's take accented letters for parts of words.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    return f"{LEFT}(?:{pattern}){RIGHT}"


def let(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def stripped(x) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def before(x, mark: str) -> Column:
    return F.substring_index(col(x), mark, 1)


def _pair(url: Column, pattern: str) -> Column:
    """Two numbers of a URL with a dot between; the pattern is tried only where its first letters are there at all."""
    mark = pattern.split(r"(")[0].replace("\\", "")
    found = F.regexp_replace(F.nullif(F.regexp_substr(url, F.lit(pattern)), F.lit("")), f"(?s)^{pattern}$", "$1.$2")
    return F.when(url.contains(mark), found)


def product_id(url) -> Column:
    """``shop.item`` from a slug or a product path; else the URL without its query."""
    u = before(url, "?")
    return F.coalesce(_pair(u, r"-i\.(\d+)\.(\d+)"), _pair(u, r"/product/(\d+)/(\d+)"), u)


def loose_product_id(url) -> Column:
    u = col(url)
    return F.coalesce(_pair(u, r"i\.(\d+)\.(\d+)"), _pair(u, r"/product/(\d+)/(\d+)"))


def canonical_url(url, root: str) -> Column:
    """The product path of a product or slug URL under ``root``; else the URL without its query."""
    u = before(url, "?")
    path = F.coalesce(_pair(u, r"/product/(\d+)/(\d+)"), _pair(u, r"-i\.(\d+)\.(\d+)(?:/|$)"))
    return F.coalesce(F.concat(F.lit(f"{root}/product/"), F.replace(path, F.lit("."), F.lit("/"))), u)


def encode_component(x) -> Column:
    """As browsers encode a URL's component."""
    out = F.url_encode(col(x))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slot_of(url) -> Column:
    """The whole number after the last dash; null if there is none."""
    return F.substring_index(col(url), "-", -1).try_cast("int")


def segments(title) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(title), F.lit("")), r" \| "), lambda x: F.trim(x)), lambda x: x != "")


def rotate_title(title, k) -> Column:
    """A tag by turns, the first segment, then the others turned by k."""
    t, k = col(title), col(k)
    seg = segments(t)
    n = F.size(seg) - 1
    r = F.pmod(k, F.greatest(n, F.lit(1)))
    tail = F.slice(seg, 2, F.greatest(n, F.lit(0)))
    turned = F.concat(F.slice(tail, r + 1, F.greatest(n - r, F.lit(0))), F.slice(tail, 1, r))
    tag = F.element_at(F.array(*map(F.lit, TITLE_TAGS)), (F.pmod(k, F.lit(len(TITLE_TAGS))) + 1).cast("int"))
    whole = F.concat(F.slice(seg, 1, 1), turned)
    return F.concat(tag, F.lit(" "), F.when(n < 1, F.coalesce(t, F.lit(""))).otherwise(F.array_join(whole, " | ")))


def cut_title(title, most: int = TITLE_LENGTH) -> Column:
    """Segments from the front as far as they fit; always the first."""
    def add(acc, x):
        longer = F.concat(acc["t"], F.lit(" | "), x)
        fits = ~acc["full"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["t"]).alias("t"), (~fits).alias("full"))

    parts = F.split(col(title), r" \| ")
    start = F.struct(F.element_at(parts, 1).alias("t"), F.lit(False).alias("full"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.length(col(title)) <= most, col(title)).otherwise(F.aggregate(rest, start, add, lambda s: s["t"]))


def first_line(x) -> Column:
    return stripped(F.element_at(F.split(stripped(x), "\n"), 1))


def product_name(ai_title, title) -> Column:
    name = F.coalesce(F.nullif(col(ai_title), F.lit("")), F.nullif(col(title), F.lit("")), F.lit(""))
    return F.left(F.trim(F.element_at(F.split(name, r" \| "), 1)), F.lit(80))


def colour_key(name) -> Column:
    """The first colour word, else the whole name marked as such."""
    n = F.coalesce(col(name), F.lit(""))
    found = F.lower(F.regexp_extract(n, f"(?i){LEFT}({'|'.join(COLOUR_WORDS)}){RIGHT}", 1))
    return let(found, lambda f: F.when(f != "", f).otherwise(F.concat(F.lit("x:"), F.lower(F.trim(n)))))


def variant_label(name) -> Column:
    n = col(name)
    dims = F.regexp_extract(n, DIMENSIONS, 0)
    return F.left(F.trim(F.regexp_replace(let(dims, lambda d: F.when(d != "", d).otherwise(n)), r"\s+", " ")), F.lit(40))


def variant_title(ai_title, label) -> Column:
    return F.concat(col(ai_title), F.lit(" | "), col(label))


def delivery_line(low, high) -> Column:
    """The promise of a source estimate of days, a day more at both ends; undated if it is missing or odd."""
    a, b = (col(x).try_cast("int") for x in (low, high))
    text = F.when(a == b, (b + 1).cast("string")).otherwise(F.concat_ws("-", a + 1, b + 1))
    ok = (a >= 1) & (b >= a) & (b <= 30)
    return F.when(ok, F.concat(F.lit(f"{DELIVERY} | "), text, F.lit(" Working Days"))).otherwise(DELIVERY)


def _trimmed(lines: Column, front: bool) -> Column:
    """Without blank lines at the front or the end."""
    def kept(x: Column) -> Column:
        full = F.transform(x, lambda line, i: F.when(F.trim(line) != "", i))
        at = F.array_min(full) if front else F.array_max(full)
        return let(F.struct(x.alias("x"), at.alias("at")), lambda s: F.when(s["at"].isNull(), F.slice(s["x"], 1, 0)).otherwise(
            F.slice(s["x"], s["at"] + 1, F.size(s["x"]) - s["at"]) if front else F.slice(s["x"], 1, s["at"] + 1)))

    return let(lines, kept)


def normal_description(text, delivery) -> Column:
    """Delivery line first, payment line last, in place of whatever stood for them."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: ~(x.contains("🚚") | x.contains("FREE Local Delivery")))
    lines = F.concat(F.array(col(delivery), F.lit("")), _trimmed(lines, True))

    def unpaid(x: Column) -> Column:
        first = F.array_min(F.transform(x, lambda line, i: F.when(line.contains("💳") | line.contains("PayNow"), i)))
        return let(F.struct(x.alias("x"), first.alias("at")), lambda s: F.filter(s["x"], lambda line, i: s["at"].isNull() | (i != s["at"])))

    lines = F.concat(_trimmed(let(lines, unpaid), False), F.array(F.lit(""), F.lit(PAYMENT)))
    return F.when(F.coalesce(col(text), F.lit("")) == "", col(text)).otherwise(F.array_join(lines, "\n"))


def fixed_description(delivery, names) -> Column:
    """The delivery line, the fixed lines, and between them the names of options, twelve at most."""
    def options(kept: Column) -> Column:
        n = F.size(kept)
        more = F.when(n > 12, F.concat(F.lit(", and "), (n - 12).cast("string"), F.lit(" more"))).otherwise("")
        return F.when(n > 0, F.concat(F.lit(OPTIONS), F.array_join(F.slice(kept, 1, 12), ", "), more))

    named = F.filter(F.coalesce(col(names), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.concat_ws("\n", col(delivery), F.lit(OPENING), let(named, options), *map(F.lit, (*CLOSING, f"\n{PAYMENT}")))


def without_sizes(text) -> Column:
    return F.array_join(F.filter(F.split(col(text), "\n"), lambda x: ~F.trim(x).rlike(SIZES_LINE)), "\n")


def product_text(*parts) -> Column:
    return F.array_join(F.filter(F.array(*map(col, parts)), lambda x: x.isNotNull() & (x != "")), "\n\n")


def image_url(x, cdn: str) -> Column:
    return F.when(col(x).rlike("^https?:"), before(x, "?")).otherwise(F.concat(F.lit(cdn), col(x)))


def image_hash(url) -> Column:
    name = F.substring_index(F.substring_index(F.substring_index(col(url), "/file/", -1), "?", 1), "@", 1)
    return F.regexp_replace(name, r"\.[A-Za-z]+$", "")


def srcset_first(x) -> Column:
    return F.element_at(F.split(F.trim(F.element_at(F.split(col(x), ","), 1)), r"\s+"), 1)


def review_status(n_images, status, timed_out) -> Column:
    """``ok`` with any image; else what stopped the harvest."""
    return F.when(col(n_images) > 0, "ok").when(col(timed_out), "timeout").when(col(status).isNull(), "error").when(col(status) == 0, "empty").otherwise("blocked")


def unfenced(x) -> Column:
    return stripped(F.regexp_replace(stripped(x), r"(?s)^```(?:json)?\s*|\s*```$", ""))


def unwrapped(x) -> Column:
    """Plain text of an answer: without fences, and of a JSON object its description, if it has one."""
    t = unfenced(x)
    inner = F.nullif(F.when(t.startswith("{"), F.get_json_object(t, "$.description")), F.lit(""))
    return F.coalesce(inner, t)


def verdict_good(x) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)VERDICT:\s*GOOD"), F.lit(False))


def title_issues(title) -> Column:
    """``segs, chars, has_dim, issues``: a listing title's figures and the codes of what is wrong with it, in the order
    of the rules below."""
    t = F.coalesce(col(title), F.lit(""))
    every = F.filter(F.transform(F.split(t, r"\|"), lambda x: F.trim(x)), lambda x: x != "")

    def judged(seg: Column) -> Column:
        low = F.lower(t)
        rules = {
            "few-segments": F.size(seg) < SEGMENTS[0], "many-segments": F.size(seg) > SEGMENTS[1], "long": F.length(t) > TITLE_LENGTH,
            "repeats": F.size(F.array_distinct(F.transform(seg, F.lower))) < F.size(seg), "banned-word": F.exists(F.array(*map(F.lit, BANNED_TITLE_WORDS)), lambda b: low.contains(b)),
            "emoji": t.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"), "symbol": t.rlike(r"[!@#$%*&]"),
        }
        issues = F.array(*[F.when(bad, code) for code, bad in rules.items()])
        return F.struct(F.size(seg).alias("segs"), F.length(t).alias("chars"), t.rlike(r"(?i)\d+\s*(cm|mm|x\s*\d+)").alias("has_dim"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))

    return let(every, judged)


def trigrams(x) -> Column:
    """The set of three-letter pieces of each lower-cased word with two spaces before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(col(x), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, one)))


def similarity(a, b) -> Column:
    """Shared trigrams as a share of all; 0 for two empty sets. Takes columns of trigram sets."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.coalesce(F.try_divide(both, F.size(col(a)) + F.size(col(b)) - both), F.lit(0.0))


def ascii_preview(x) -> Column:
    return F.regexp_replace(col(x), r"[^\x00-\x7F]", "?")


def shop_username(url) -> Column:
    name = F.regexp_extract(col(url), r"^https?://[^/]+/([^/?#]+)", 1)
    return F.when((name != "") & ~name.isin("shop", "product", "search", "mall"), name)


def download_name(stem, n, content_type) -> Column:
    return F.concat_ws("", col(stem), F.lit("-"), col(n).cast("string"), F.when(F.coalesce(col(content_type), F.lit("")).contains("png"), ".png").otherwise(".jpg"))


def fill_template(template: str, values: dict, once: tuple[str, ...] = ()) -> Column:
    """The template with its marks in braces filled in turn, null as nothing: every place of a mark, or, of marks in
    ``once``, the first alone."""
    out = F.lit(template)
    for name, x in values.items():
        mark, own = F.lit("{" + name + "}"), F.coalesce(col(x).cast("string"), F.lit(""))
        at = F.locate("{" + name + "}", out) if name in once else None
        filled = F.replace(out, mark, own)
        if at is not None:
            filled = F.when(at > 0, F.concat(F.left(out, at - 1), own, F.substring(out, at + len(name) + 2, F.length(out)))).otherwise(out)
        out = filled
    return out


def is_source_url(url, hosts: tuple[str, ...] = ("shopee.sg", "sg.shp.ee")) -> Column:
    """Whether a URL names one of the source's hosts, anywhere in it."""
    u = F.coalesce(col(url), F.lit(""))
    out = F.lit(False)
    for h in hosts:
        out = out | u.contains(h)
    return out


def is_proxied_image(url, suffixes: tuple[str, ...] = ("shopee.sg", "susercontent.com", "shopeemobile.com"), own: str | None = None) -> Column:
    """Whether an image may be fetched for a worker: its host ends in one of the suffixes (as text: ``evilshopee.sg``
    ends in the first, too), or is one's own."""
    host = F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^https?://([^/?#:]+)", 1)
    out = F.lit(False)
    for s in suffixes:
        out = out | host.endswith(s)
    return out | (host == own) if own else out
