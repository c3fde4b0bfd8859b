"""Registered queries of functions and small operators, over whole tables. Inputs are built from keys, so that the SQL
can state what must come out without the function's own patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soukspark import config, scratch
from soukspark.catalogue_queries import _Q, _judged, _q, query
from soukspark.config import Flags
from soukspark.functions import arrays, jsons, num, text
from soukspark.functions import html as page
from soukspark.operators import hooks, listings, queue, reports, sourcing
from soukspark.plans import adapters
from soukspark.plans.adapters import plain, view
from soukspark.sources import readers

_ORDERS = "select o_orderkey as id, cast(o_orderkey % 1000 as int) as k, o_totalprice as price from {orders}"
_O = f"o as ({plain(_ORDERS)})"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, _ORDERS)


def _joined(*cs: str) -> list:
    return [F.array_join(c, ",").alias(c) for c in cs]


def _strings(*xs) -> F.Column:
    return F.array(*[x if isinstance(x, F.Column) else F.lit(x) for x in xs])


def _tag(prefix: str, c: str = "k") -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# -- items ---------------------------------------------------------------------------------------------------------


@query(f"""with i as ({plain(adapters.ITEMS)}), b as (select distinct item_id from i where ord % 17 = 0) select ord, i.item_id, b.item_id is not null blocked from i left join b on i.item_id = b.item_id""")
def j4_s2_blocked_items(spark: SparkSession, d: str) -> DataFrame:
    """The block list as a join: of ids of some items, with repeats."""
    items = view(spark, d, adapters.ITEMS)
    export = items.select("ord", F.col("item_id").alias("itemId"), F.col("shop_id").cast("string").alias("shopId"), F.col("shop_name").alias("shopName"), "name", "url", "price", F.col("sold_text").alias("historicalSoldEstimated"), F.col("reviews").alias("reviewCount"), "rating", "location", F.array().cast("array<string>").alias("images"), F.col("is_mock").alias("_mock"))
    return readers.as_items(export, items.where("ord % 17 = 0").select(F.col("item_id").alias("id"))).select("ord", "item_id", "blocked")


_FAR = _judged(Flags()).replace(f"'{config.OVERSEAS[0]}'", f"'{config.OVERSEAS[1]}'").replace(f"'{config.NEAR[0]}'", f"'{config.NEAR[1]}'")


@query(f"with {_FAR} select ord, reason from judged where reason is not null")
def p4_near_abroad(spark: SparkSession, d: str) -> DataFrame:
    """The cascade where the neighbouring country counts as abroad."""
    return sourcing.judged(view(spark, d, adapters.ITEMS), Flags(near_abroad=True)).where("reason is not null").select("ord", "reason")


@query(f"with i as ({plain(adapters.ITEMS)}) select item_id, min(ord) ord from i group by 1")
def ad3_first_of_each_item(spark: SparkSession, d: str) -> DataFrame:
    return readers.first_of_each(view(spark, d, adapters.ITEMS).select("item_id", "ord"), "item_id")


@query(f"""with {_O} select id, id / 100000.0::double price, coalesce(nullif(k % 5, 0), nullif(k % 7, 0), 0)::double real, greatest(1, least(50, case when k % 60 = 0 then 20 else k % 60 end))::int batch,
  '$' || (k // 10) || '.' || (k % 10) tenth, 'x' || k || repeat(' ', 5 - length('x' || k)) "right", repeat(' ', greatest(0, 2 - length(k::varchar))) || k "left" from o""")
def fn5_fn10_o11_numbers(spark: SparkSession, d: str) -> DataFrame:
    zero = F.nullif(F.col("k") % 5, F.lit(0))
    return _orders(spark, d).select(
        "id", num.unscaled("id").alias("price"), num.first_real(zero, F.col("k") % 7).alias("real"), num.clamp_batch(F.col("k") % 60).alias("batch"),
        F.concat(F.lit("$"), num.fixed(F.col("k") / 10.0, 1)).alias("tenth"), num.padded(_tag("x"), 5).alias("right"), num.padded("k", 2, True).alias("left"),
    )


# -- strings -------------------------------------------------------------------------------------------------------


@query(f"""with {_O} select id, k slot, 'a' || k || chr(10) || chr(10) || 'c' joined, 'Desk ' || k product_name, case when k % 2 = 0 then 'https://x/p' || k else 'https://cdn/h' || k end image,
  'h' || k hash, 'https://a/' || k || '.jpg' src, case when k % 5 > 0 then 'ok' when k % 3 = 0 then 'timeout' when k % 4 = 0 then 'error' when k % 4 = 1 then 'empty' else 'blocked' end status from o""")
def fs7_fs22_strings(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, 0).otherwise(403)
    return _orders(spark, d).select(
        "id", text.slot_of(F.concat(_tag("https://x/y#v", "id"), _tag("-"))).alias("slot"), text.product_text(_tag("a"), F.lit(""), F.lit("c")).alias("joined"),
        text.product_name(F.when(F.col("k") % 2 == 0, F.concat(_tag("Desk "), F.lit(" | Oak | Big"))), F.concat(_tag("Desk "), F.lit(" | Old"))).alias("product_name"),
        text.image_url(F.when(F.col("k") % 2 == 0, F.concat(_tag("https://x/p"), F.lit("?w=1"))).otherwise(_tag("h")), "https://cdn/").alias("image"),
        text.image_hash(F.concat(_tag("https://x/file/h"), F.lit("@w.webp?x"))).alias("hash"), text.srcset_first(F.concat(_tag(" https://a/"), F.lit(".jpg 1x, https://b 2x"))).alias("src"),
        text.review_status(F.col("k") % 5, status, F.col("k") % 3 == 0).alias("status"),
    )


@query(f"""with {_O} select id, case when k % 3 = 0 then '{{"a": ' || k || '}}' when k % 3 = 1 then 'Text ' || k else 'plain ' || k end plain, k % 2 = 0 good, 'caf? ' || k preview,
  case k % 3 when 0 then 'shop' || k end as username, 'desk-' || k || case when k % 2 = 0 then '.png' else '.jpg' end file, 'n' || k || ' {{B}} n' || k || ' ' || (k - 1) || ' {{C}} ' filled from o""")
def fs24_fs37_answers(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("k") % 3 == 0, F.concat(F.lit('```json\n{"a": '), F.col("k").cast("string"), F.lit("}\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit('```\n{"description": "Text '), F.col("k").cast("string"), F.lit('"}```'))).otherwise(F.concat(_tag(" plain "), F.lit("\n")))
    url = F.when(F.col("k") % 3 == 0, F.concat(_tag("https://m.example/shop"), F.lit("?a=1"))).when(F.col("k") % 3 == 1, F.lit("https://m.example/product/1/2")).otherwise(F.lit("none"))
    kind = F.when(F.col("k") % 2 == 0, "image/png")
    return _orders(spark, d).select(
        "id", text.unwrapped(body).alias("plain"), text.verdict_good(F.when(F.col("k") % 2 == 0, "so: verdict:  Good").when(F.col("k") % 4 == 1, "VERDICT: BAD")).alias("good"),
        text.ascii_preview(_tag("café ")).alias("preview"), text.shop_username(url).alias("username"), text.download_name(F.lit("desk"), "k", kind).alias("file"),
        text.fill_template("{N} {B} {N} {C} {C} {D}", {"N": _tag("n"), "C": F.col("k") - 1, "D": F.lit(None)}, once=("C",)).alias("filled"),
    )


_SEG = "'Seg ' || k || ' ' || repeat('x', 40)"


@query(f"""with {_O} select id, {_SEG} || repeat(' | ' || repeat('y', 30), case when k < 10 then 5 when k < 1000 then 5 end) short, 'First ' || k line,
  'D' || k || chr(10) || chr(10) || 'Body ' || k || chr(10) || 'end' || chr(10) || chr(10) || '{config.PAYMENT}' description,
  1 + least(k % 15, 12) pieces, k % 15 > 12 more from o""")
def fs11_fs16_copy(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(_tag("Seg "), F.lit(" " + "x" * 40), F.lit((" | " + "y" * 30) * 8))
    body = F.concat(F.lit("🚚 old line\n\n"), _tag("Body "), F.lit("\n💳 old\nend\n\n"))
    names = F.transform(F.sequence(F.lit(0), F.col("k") % 15), lambda i: F.concat(F.lit("N"), i.cast("string")))
    names = F.slice(names, 1, F.col("k") % 15)
    fixed = text.fixed_description(F.lit("D"), names)
    line = F.try_element_at(F.filter(F.split(fixed, "\n"), lambda x: x.startswith("📦")), F.lit(1))
    return _orders(spark, d).select(
        "id", text.cut_title(title).alias("short"), text.first_line(F.concat(F.lit("\n  "), _tag("First "), F.lit(" \nsecond"))).alias("line"), text.normal_description(body, _tag("D")).alias("description"),
        F.coalesce(F.size(F.filter(F.split(line, r"[ ,]+"), lambda x: x.rlike("^N[0-9]+$"))) + 1, F.lit(1)).alias("pieces"), F.coalesce(line.contains(" more"), F.lit(False)).alias("more"),
    )


# -- links, guards, arrays -----------------------------------------------------------------------------------------


@query(f"""with {_O} select id, k % 4 < 3 listing, k % 3 = 0 source, k % 5 in (0, 1) proxied, case when k % 6 = 0 then 'https://full/' || k else 'https://s/' || k end resolved, k % 2 = 0 and k % 4 = 3 fault from o""")
def p12_p14_links(spark: SparkSession, d: str) -> DataFrame:
    """Which links are listings, sources and images of the markets; short links lead where they lead."""
    rows = _orders(spark, d)
    end = F.element_at(F.array(F.lit("www.carousell.sg/p/x"), F.lit("carousell.com/SELL/"), F.lit("carousell.app.link/x"), F.lit("carousell.sg/u/x")), (F.col("k") % 4 + 1).cast("int"))
    source = F.element_at(F.array(F.lit("https://shopee.sg/x"), F.lit("https://other/x"), F.lit(None)), (F.col("k") % 3 + 1).cast("int"))
    image = F.element_at(F.array(F.lit("https://down.susercontent.com/f"), F.lit("https://own.example/f"), F.lit("https://x/shopee.sg"), F.lit(""), F.lit("http://a.b")), (F.col("k") % 5 + 1).cast("int"))
    rows = rows.select("id", "k", F.concat(F.lit("https://"), end).alias("sold_url"), source.alias("source"), image.alias("image"), _tag("https://s/").alias("url"), F.when(F.col("k") % 2 == 0, "done").otherwise("active").alias("status"))
    links = rows.where("k % 6 = 0").select(F.col("url").alias("short"), _tag("https://full/").alias("target")).distinct()
    faults = listings.link_faults(rows).select("id", F.lit(True).alias("fault"))
    out = listings.resolved(rows, links).join(faults, "id", "left")
    return out.select("id", listings.valid_link("sold_url").alias("listing"), text.is_source_url("source").alias("source"), text.is_proxied_image("image", own="own.example").alias("proxied"), F.col("url").alias("resolved"), F.coalesce("fault", F.lit(False)).alias("fault"))


@query(f"""with {_O} select id, case when k % 2 = 0 then null when k % 3 = 0 and k % 5 = 0 then 'no-edt,reviews-blocked' when k % 3 = 0 then 'no-edt' when k % 5 = 0 then 'reviews-blocked' end warnings,
  case when k % 11 = 0 then 'unloaded' when k % 13 = 0 then 'no-url' when k % 17 = 0 then 'duplicate' when k % 2 = 0 then 'refresh' when k % 3 = 1 then 'lead-time-too-long' else 'ok' end outcome,
  concat_ws(',', case when k % 7 = 0 then 'category' end, case when k % 4 = 1 then 'seller' end, case when k % 9 < 4 then 'rating' end, case when k % 200 < 15 or k % 200 > 150 then 'cost' end) extra from o""")
def p15_p16_p26_guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    edt = F.element_at(F.array(F.lit(0), F.lit(14), F.lit(13)), (k % 3 + 1).cast("int"))
    rows = _orders(spark, d).select(
        "id", "k", edt.alias("edt_max"), F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "ok").when(k % 5 == 2, "empty").when(k % 5 == 3, "").alias("review_status"), (k % 11 == 0).alias("unloaded"),
        F.when(k % 13 != 0, _tag("u")).alias("listing_url"), F.when(k % 17 == 0, "block").when(k % 2 == 0, "refresh").otherwise("new").alias("action"),
        F.when(k % 7 == 0, "Toys").otherwise("Beds").alias("category"), F.when(k % 4 == 0, "East, Singapore").when(k % 4 == 1, "Far").alias("shop_location"), (k % 9).cast("double").alias("rating"), (k % 200).cast("double").alias("cost"),
    )
    rows = rows.withColumn("guards", arrays.guard_warnings("edt_max", "review_status", k % 2 == 0))
    out = listings.extra_warnings(listings.outcome(rows), ["Beds", "Safes"])
    return out.select("id", F.array_join("guards", ",").alias("warnings"), "outcome", F.array_join("warnings", ",").alias("extra"))


@query(f"""with {_O} select id, case when k % 2 = 0 then 'a' else 'a,b,c' end stocked, case when k % 3 = 0 then 'n' || k || ',m' else 'm' end hashes, array_to_string(list_transform(range(case when k % 90 >= 30 then 30 else k % 90 end), lambda i: 'i' || i || ',c' || i), ',') reviews,
  'r,s,d' || k described, case when k % 5 = 0 then 'Scene number ' || k || ' here,Another long scene' else 'Living room,Bedroom' end scenes, case k % 4 when 0 then 'a' when 1 then 'a,b' else 'a,c' end picked, case when k % 4 >= 2 then 'd1' end dims,
  'the longest line of number ' || k longest, case when k % 2 = 0 then 'p,z' else 'p' end priced, '2:c,0:a' as remapped from o""")
def p18_p23_arrays(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    model = lambda n, p: F.struct(F.lit(n).alias("name"), (F.lit(p).cast("double") if not isinstance(p, F.Column) else p).alias("price"))
    models = F.array(model("a", 1.0), model("b", 2.0), model("c", 3.0))
    ratings = F.transform(F.slice(F.sequence(F.lit(0), k % 90), 1, k % 90), lambda i: F.struct(_strings(F.concat(F.lit("i"), i.cast("string"))).alias("images"), _strings(F.concat(F.lit("c"), i.cast("string"))).alias("covers")))
    scenes = F.when(k % 5 == 0, F.concat(F.lit("1. Scene number "), k.cast("string"), F.lit(" here\n- Another long scene\nshort"))).when(k % 5 == 1, "short\n* only one long scene")
    images = F.when(k % 4 == 0, _strings("a")).when(k % 4 == 1, _strings("a", "b")).otherwise(_strings("a", "b", "c"))
    answers = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role")) for i, r in ((0, "cover"), (9, "dimension"), (1, "dimension"), (2, "dimension"))])
    prices = F.array(model("p", 2.0), model("z", 0.0), model("n", None))
    back = arrays.remapped(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role")) for i, r in ((1, "c"), (5, "x"), (-1, "y"), (0, "a"))]), F.array(F.lit(0), F.lit(2)))
    return _orders(spark, d).select(
        "id", F.array_join(F.transform(arrays.in_stock(models, F.when(k % 2 == 0, _strings("b", "c"))), lambda m: m["name"]), ",").alias("stocked"),
        F.array_join(arrays.new_hashes(_strings(_tag("n"), F.lit("m"), _tag("n"), F.lit("g")), F.when(k % 3 == 0, _strings("g")).otherwise(_strings(F.lit("g"), _tag("n")))), ",").alias("hashes"),
        F.array_join(arrays.review_images(ratings), ",").alias("reviews"), F.array_join(arrays.description_images(_strings("r", "s"), _strings(F.lit("s"), _tag("d"), F.lit("r"))), ",").alias("described"),
        F.array_join(arrays.scene_lines(scenes, 4, ("Living room", "Bedroom")), ",").alias("scenes"), F.array_join(arrays.cover_and_dims(images, F.lit(2)), ",").alias("picked"),
        F.when(k % 4 >= 2, arrays.dimension_image(answers, _strings("d0", "d1", "d2"))).alias("dims"), arrays.longest_line(F.concat(F.lit("short\n  the longest line of number "), k.cast("string"), F.lit("  \nsome other line here"))).alias("longest"),
        F.array_join(F.transform(arrays.priced_models(prices, True), lambda m: m["name"]), ",").alias("_page"), F.array_join(F.transform(arrays.priced_models(prices, False), lambda m: m["name"]), ",").alias("_item"),
        F.array_join(F.transform(back, lambda a: F.concat_ws(":", a["i"].cast("string"), a["role"])), ",").alias("remapped"),
    ).withColumn("priced", F.when(F.col("id") % 1000 % 2 == 0, F.col("_page")).otherwise(F.col("_item"))).drop("_page", "_item")


@query("""with x as (select page_id, page_id % 3 r from pages) select page_id, case when r = 2 then null else 'Thing ' || page_id end title, case when r = 2 then null else 'Text of ' || page_id end description,
  case when r = 2 then null when r = 0 then 'https://img.mart/' || page_id || '.jpg,https://cdn.x/file/h' || page_id else 'https://cdn.x/file/h' || page_id end images, case when r = 0 then 'Thing ' || page_id || ' | Mart City' else '' end meta from x""")
def fh1_fh7_page_products(spark: SparkSession, d: str) -> DataFrame:
    """Product facts of pages: own tags in a third, structured data in a third (the tags there are the site's), none in
    the rest. The pages' own HTML follows what is put in front."""
    key = F.col("page_id").cast("string")
    put = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    og = put("<meta content='Text of ", key, " - Buy Thing now' name='og:description'><meta property=\"og:title\" content=\"Thing ", key, " | Mart City\"><meta property=\"og:image\" content=\"https://img.mart/", key, ".jpg?x\"><meta property=\"og:image\" content=\"https://else/b.jpg\"><img src=\"https://cdn.x/file/h", key, "?z\"><img src=\"https://cdn.x/file/h", key, "\">")
    ld = put("<script type=\"application/ld+json\">{bad</script><script type='application/ld+json'>[{\"@type\": \"Other\", \"name\": \"no\"}, {\"@type\": \"Product\", \"name\": \"Thing ", key, "\", \"description\": \"Text of ", key, "\"}]</script><img src=\"https://cdn.x/file/h", key, "\">")
    r = F.col("page_id") % 3
    pages = view(spark, d, "select page_id, html from {pages}").withColumn("html", F.concat(F.when(r == 0, og).when(r == 1, ld).otherwise(""), F.coalesce("html", F.lit(""))))
    out = pages.select("page_id", page.product("html", "Mart City", "mart", (r"https://cdn\.x/file/[^\"' ]+",)).alias("p"), page.meta("html", "og:title").alias("meta"))
    return out.select("page_id", "p.title", "p.description", F.array_join("p.images", ",").alias("images"), "meta")


# -- JSON ----------------------------------------------------------------------------------------------------------


@query("""with e as (select event_id, json_extract_string(props, '$.k') k from events) select event_id, 'T' || k || chr(10) || 'in ' || k rich, 'https://x/' || k || ',abcdefgh_12345678' images, k::bigint shop, (k::int % 5 + 2)::int edt, k::double / 20 rating,
  'Cat ' || k category, 'Item ' || k title, k::double / 10 price, k::bigint sold, 'm' || k models, 'Sofa ' || k || ':12.5,Bed:3.0' offers, 2 copies from e""")
def fj1_fj7_s8_s9_json(spark: SparkSession, d: str) -> DataFrame:
    """Every walk and path over JSON built around the events' own properties."""
    k = F.get_json_object("props", "$.k")
    of = lambda s: F.concat(*[k if p == "K" else F.lit(p) for p in s.split("~")])
    rows = view(spark, d, "select event_id, props from {events}", piece=1 << 18).select(
        "event_id", k.alias("k"),
        of('{"text": "T~K~", "a": [{"image_url": "https://x/~K~"}, {"Photo": "abcdefgh_12345678", "img": "short"}], "b": {"paragraph": "in ~K~", "title": "no"}}').alias("rich"),
        of('{"a": [{"x": {"shopid": 0}}, {"shopid": ~K~}]}').alias("shop"),
        of('[{"channel_delivery_info": {"estimated_delivery_time_max": 0}}, {"channel_delivery_info": {"estimated_delivery_time_min": 1, "estimated_delivery_time_max": 99}}, {"channel_delivery_info": {"is_fastest_edt_channel": true, "estimated_delivery_time_min": 1, "estimated_delivery_time_max": 77}}]').alias("edt"),
        of('{"item_rating": {}, "product_review": {"rating_star": ~K~}, "categories": [{"name": "Cat ~K~"}]}').alias("facts"),
        of('{"data": {"item": {"name": "Item ~K~", "price_min": 0, "price": ~K~e4, "historical_sold": 0, "sold": ~K~, "models": [{"name": "m~K~", "price": 100000}, {"name": "free", "price": 0}]}}}').alias("item"),
        of('{"results": [{"title": "Sofa ~K~", "price": "S$12.50"}, {"title": "Sofa ~K~", "price": "12.5"}, {"n": {"title": "Bed", "priceFormatted": "S$3"}}, {"title": "Free", "price": "0"}]}').alias("offers"),
        of('{"a": {"itemid": ~K~, "models": []}, "b": [{"item_id": "~K~", "models": [1]}, {"itemid": ~K~}]}').alias("copies"),
    )
    edt = jsons.delivery_estimate("edt")["edt_max"]
    item = jsons.item_payload("item", "https://cdn/")
    return rows.select(
        "event_id", jsons.rich_text_of("rich")["text"].alias("rich"), F.array_join(jsons.rich_text_of("rich")["images"], ",").alias("images"), F.coalesce(jsons.shop_id_of("shop"), F.lit(0)).alias("shop"), (edt - 75 + F.col("k").cast("int") % 5).alias("edt"),
        (jsons.rating("facts") / 20).alias("rating"), jsons.category("facts").alias("category"), item["title"].alias("title"), item["price"].alias("price"), item["sold"].alias("sold"), F.array_join(F.transform(item["models"], lambda m: m["name"]), ",").alias("models"),
        F.array_join(F.transform(jsons.offers_of("offers"), lambda x: F.concat_ws(":", x["title"], x["price"].cast("string"))), ",").alias("offers"), F.size(jsons.item_copies("copies", "k")).alias("copies"),
    )


# -- listings ------------------------------------------------------------------------------------------------------

_LIST = "select o_orderkey as id, concat('u', cast(o_orderkey % 3000 as string)) as listing_url, concat('Item ', cast(o_orderkey as string)) as title, case when o_orderkey % 4 <> 0 then concat('AI ', cast(o_orderkey as string)) end as ai_title, case when o_orderkey % 7 = 0 then 'deleted' when o_orderkey % 5 = 0 then 'done' else 'active' end as status, concat('w', cast(o_custkey % 50 as string)) as assigned_worker_id, o_totalprice as sell_price, o_orderdate as created_at from {orders}"
_L = f"l as ({plain(_LIST)})"


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, _LIST)


@query(f"""with {_L}, s as (select id, row_number() over (partition by id % 500 * 3 order by id desc) r, id % 500 * 3 e from l where id % 2 = 0) select l.id, s.e is not null changed, case when s.e is null then l.assigned_worker_id else 'w' || (s.id % 9) end assigned_worker_id,
  case when s.e is null then l.ai_title when s.id % 3 > 0 then 'New ' || s.id end ai_title, case when s.e is null then 1.0 else s.id::double end source_cost, case when s.e is null then 'old' else 'n' || s.id end images, l.title from l left join s on l.id = s.e and s.r = 1""")
def t9_l1_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Listings after some were scraped again, some of them more than once."""
    none = F.lit(None).cast("string")
    rows = _listings(spark, d)
    held = rows.select("id", "title", "assigned_worker_id", none.alias("own_account"), "ai_title", none.alias("ai_description"), _strings("old").alias("images"), F.array().cast("array<string>").alias("guard_warnings"), F.lit(1.0).alias("source_cost"), F.lit(10.0).alias("sell_price"))
    again = rows.where("id % 2 = 0").select(
        (F.col("id") % 500 * 3).alias("existing_id"), F.lit("refresh").alias("action"), F.col("id").alias("ord"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string")).alias("assigned_worker_id"), none.alias("own_account"),
        F.when(F.col("id") % 3 > 0, _tag("New ", "id")).alias("ai_title"), none.alias("ai_description"), _strings(_tag("n", "id")).alias("images"), F.lit(None).cast("array<string>").alias("guard_warnings"), F.col("id").cast("double").alias("source_cost"), F.lit(20.0).alias("sell_price"),
    )
    return listings.refreshed(held, again).select("id", "changed", "assigned_worker_id", "ai_title", "source_cost", F.array_join("images", ",").alias("images"), "title")


@query(f"""with {_L}, n as (select id, case when id % 10 = 0 then null else 'u' || (id % 6000) end listing_url from l), f as (select *, row_number() over (partition by listing_url order by id) r from n where listing_url is not null)
  select id, listing_url from f where r = 1 and listing_url not in (select listing_url from l where status <> 'deleted' and id % 2 = 0) union all select id, listing_url from n where listing_url is null""")
def k6_listings_inserted(spark: SparkSession, d: str) -> DataFrame:
    """What an insert of rows adds to the listings with even numbers."""
    rows = _listings(spark, d)
    new = rows.select(F.col("id").alias("ord"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("u"), (F.col("id") % 6000).cast("string"))).alias("listing_url"))
    return listings.fresh(rows.where("id % 2 = 0"), new).select(F.col("ord").alias("id"), "listing_url")


@query(f"with {_L} select id, assigned_worker_id, title, row_number() over (partition by assigned_worker_id order by created_at, id)::int place from l where status = 'active'")
def o8_listings_of_staff(spark: SparkSession, d: str) -> DataFrame:
    """Each staff member's active listings; places are read off the order in which they come."""
    from pyspark.sql import Window

    rows = listings.of_worker(_listings(spark, d))
    place = F.row_number().over(Window.partitionBy("assigned_worker_id").orderBy("created_at", "id"))
    return rows.select("id", "assigned_worker_id", "title", place.alias("place"))


@query(f"""with {_L}, p as (select id from l where coalesce(ai_title, '') = '' order by created_at, id limit 2), i as (select id from l where id % 3 > 0 order by id limit 3)
  select id, 'regenerate' as why from p union all select id, 'scrape' from i union all select id, 'found' from l where lower(title || ' ' || coalesce(ai_title, '')) like '%tem 12%'""")
def p24_p27_o7_picked(spark: SparkSession, d: str) -> DataFrame:
    """What is up next, and what a search finds."""
    rows = _listings(spark, d)
    said = lambda df, why: df.select("id", F.lit(why).alias("why"))
    inbox = rows.select("id", F.when(F.col("id") % 3 == 0, True).alias("consumed"))
    return said(listings.to_regenerate(rows), "regenerate").unionAll(said(listings.oldest_pending(inbox), "scrape")).unionAll(said(listings.search(rows, "tEM 12"), "found"))


@query(f"""with {_L} select id, case when id % 4 = 0 then 'Item ' || id else 'AI ' || id end ai_title from l""")
def t15_x6_regenerated(spark: SparkSession, d: str) -> DataFrame:
    return hooks.regenerate(_listings(spark, d)).select("id", "ai_title")


@query(f"""with {_L}, s as (select id, id % 4 slot from l) select s.id, 'https://x/' || s.id || '#v' || s.id || '-' || slot listing_url, ({list(config.TITLE_TAGS)!r})[((slot + 1) % 10)::int + 1] || ' T | ' || case (slot + 1) % 2 when 0 then 'a | b' else 'b | a' end ai_title, 'shot' || slot || ',dims' images, sell_price from s join l using (id)""")
def l5_listings_by_backdrop(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("id", F.concat(_tag("https://x/", "id"), F.lit("#c0")).alias("url"), "title", F.lit("T | a | b").alias("ai_title"), F.lit("d").alias("ai_description"), F.lit(1.0).alias("source_cost"), "sell_price", _strings("cover", "dims").alias("images"))
    shots = rows.select("id", (F.col("id") % 4).cast("int").alias("slot"), F.concat(F.lit("shot"), (F.col("id") % 4).cast("string")).alias("shot_url"))
    return listings.by_backdrop(rows, shots).select("id", "listing_url", "ai_title", F.array_join("images", ",").alias("images"), "sell_price")


@query("""with x as (select l_orderkey item, l_linenumber o, l_linenumber % 3 = 0 priced, l_linenumber % 2 = 0 described from lineitem) select item, (min(o) filter (priced))::double price,
  coalesce('d' || min(o) filter (described), case when min(o) filter (priced) is not null then '' end) description, 'i' || min(o) images from x group by 1""")
def j15_merged_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select l_orderkey as item, l_linenumber as ord from {lineitem}")
    copies = rows.select("item", "ord", F.when(F.col("ord") % 3 == 0, F.col("ord").cast("double")).alias("price"), F.when(F.col("ord") % 2 == 0, _tag("d", "ord")).otherwise("").alias("description"), _strings(_tag("i", "ord")).alias("images"))
    return listings.merged_copies(copies).select("item", "price", "description", F.array_join("images", ",").alias("images"))


@query("""with m as (select l_orderkey product, l_linenumber n, l_linenumber % 4 t from lineitem) select product, n::int n, case when n % 2 = 0 then 'own' || n when t < 3 then 's' || t end image from m""")
def j14_swatches(spark: SparkSession, d: str) -> DataFrame:
    """Models whose image is missing take that of the option at their place, of options of one name the last."""
    parts = scratch.parts(spark.read.parquet(f"{d}/lineitem.parquet"), 250_000)
    rows = view(spark, d, "select l_orderkey as product, l_linenumber as n from {lineitem}").repartition(parts, "product")
    models = rows.select("product", _tag("m", "n").alias("name"), "n", F.when(F.col("n") % 2 == 0, _tag("own", "n")).alias("image"), (F.col("n") % 4).alias("tier_index"))
    options = rows.select("product").distinct().select("product", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    options = options.withColumn("images", F.when(F.col("pos") == 1, _strings("s0", "s1", "s2")).otherwise(_strings("old", "old", "old")))
    return listings.swatches(models, options, parts).select("product", F.col("n").cast("int").alias("n"), "image")


@query("""with r as (select l_orderkey capture, l_linenumber * 1000000 + l_partkey o, l_partkey % 5 h from lineitem), f as (select capture, 'c' || h href, min(o)::int ord from r group by 1, 2) select * from f qualify row_number() over (partition by capture order by ord) <= 3""")
def ad10_chats(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select l_orderkey as capture, cast(l_linenumber * 1000000 + l_partkey as int) as ord, concat('c', cast(l_partkey % 5 as string)) as href from {lineitem}")
    return listings.chats(rows, 3).select("capture", "href", "ord")


@query(f"""with {_L} select l.id probe_id, 'Item ' || l.id title, l.listing_url, l.id + 1 matched_id, 0.75::double score, '2024-06-01 12:00:00' logged_at from l where l.id % 3 = 0""")
def k11_duplicate_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d)
    found = rows.where("id % 3 = 0").select(F.col("id").alias("probe_id"), (F.col("id") + 1).alias("id"), F.lit(0.75).alias("score"))
    return listings.duplicate_log(found, rows, adapters.NOW).withColumn("logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"))


@query("""with r as (select l_linenumber % 3 m, l_partkey ms, (l_suppkey * 4) as cost, l_partkey % 2 = 0 has_dim, l_partkey % 5 = 0 failed from lineitem) select 'm' || m model, avg(ms)::double avg_ms, sum(cost)::bigint as cost, count(*) filter (has_dim) with_dim, count(*) filter (failed) failed from r group by 1""")
def a21_bake_off(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select concat('m', cast(l_linenumber % 3 as string)) as model, l_partkey as ms, l_suppkey * 4 as cost, l_partkey % 2 = 0 as has_dim, l_partkey % 5 = 0 as failed from {lineitem}")
    return reports.bake_off(rows)


@query("""with m as (select l_orderkey id, count(*) filter (l_linenumber % 2 = 0) passed from lineitem group by 1) select id, passed, 4 - passed rejected from m""")
def a19_shot_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select l_orderkey as id, case when l_linenumber % 2 = 0 then 'x' end as shot_url from {lineitem}")
    return hooks.shot_counts(rows, 4)


@query(f"""with {_Q} select id, listing_url, title, price, times_listed, attempts from q where state = 'pending'""")
def p11_o5_public_queue(spark: SparkSession, d: str) -> DataFrame:
    """What may be seen of pending rows: no cost, no holder."""
    return queue.public(_q(spark, d).where("state = 'pending'"))
