"""Scalar functions on the literal cases that define them."""

import json

import pytest
from pyspark.sql import functions as F

from soukspark import config
from soukspark.functions import arrays, html, jsons, num, text


def values(spark, rows, ddl, *exprs):
    df = spark.createDataFrame(rows, ddl)
    out = df.select(*[e.alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    return [tuple(r) if len(exprs) > 1 else r[0] for r in out]


def test_sold_numbers(spark):
    cases = {"1k+": 1000, "10k+": 10000, "500+": 500, "<100": 0, "": 0, "1.2k": 1200, "1,234": 1234, "2m": 2000000, None: 0, "77": 77, "n/a": 0, "1.2.3": 0}
    assert values(spark, [(x,) for x in cases], "x string", num.sold_to_number("x")) == list(cases.values())


def test_prices(spark):
    got = values(spark, [(20.0,), (50.0,), (100.0,), (0.0,), (None,)], "c double", num.sell_price("c"), num.margin_floor("c"))
    assert got == [(50, 45), (80, 75), (150, 150), (30, 25), (None, None)]


def test_numbers(spark):
    got = values(spark, [("0", "5"), ("x", None), (None, "nan")], "a string, b string", num.first_real("a", "b"), num.number_or_zero("a"), num.clamp_batch("b"))
    assert got == [(5.0, 0.0, 5), (0.0, 0.0, 20), (0.0, 0.0, 20)]
    assert values(spark, [("0",), ("-3",), ("99",), ("7",)], "n string", num.clamp_batch("n")) == [20, 1, 50, 7]
    assert values(spark, [(2.5,), (-2.5,), (0.5,)], "x double", num.half_up("x")) == [3, -2, 1]


def test_upper_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert df.agg(num.upper_median("x")).first()[0] == 3.0
    assert df.limit(0).agg(num.upper_median("x")).first()[0] is None


def test_product_ids_and_urls(spark):
    rows = [("https://a.b/Name-i.12.34?x=1",), ("https://a.b/product/5/6?y",), ("https://a.b/other?z",), ("https://a.b/Nm-i.1.2extra",), (None,)]
    got = values(spark, rows, "u string", text.product_id("u"), text.canonical_url("u", "https://m"))
    assert got == [("12.34", "https://m/product/12/34"), ("5.6", "https://m/product/5/6"), ("https://a.b/other", "https://a.b/other"), ("1.2", "https://a.b/Nm-i.1.2extra"), (None, None)]


def test_component_encoding(spark):
    assert values(spark, [("a b!~*'()&é",)], "x string", text.encode_component("x")) == ["a%20b!~*'()%26%C3%A9"]


def test_rotated_titles(spark):
    nine = " | ".join("ABCDEFGHI")
    df = spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(nine).alias("t"))
    got = [r[0] for r in df.select(text.rotate_title("t", "k")).collect()]
    assert len(set(got)) == 40 and all(" A | " in g for g in got)
    assert got[0] == f"{config.TITLE_TAGS[0]} {nine}" and got[1].startswith("[NEW IN] A | C | D") and got[1].endswith("I | B")
    assert values(spark, [("only", 3), ("Item 100 | x", 0), (None, 1)], "t string, k int", text.rotate_title("t", "k")) == ["[LAST FEW] only", "[READY STOCK] Item 100 | x", "[NEW IN] "]


def test_cut_titles(spark):
    long = " | ".join(["x" * 100] * 4)
    assert values(spark, [(long,), ("short | y",), ("z" * 300,)], "t string", text.cut_title("t")) == [" | ".join(["x" * 100] * 2), "short | y", "z" * 300]


def test_colours_and_labels(spark):
    rows = [("Queen Grey 4 inch",), ("Gray",), ("LNavy mat",), (" Size M ",), ("blackish",), (None,)]
    assert values(spark, rows, "n string", text.colour_key("n")) == ["grey", "gray", "lnavy", "x:size m", "x:blackish", "x:"]
    rows = [("Desk 120 x 60 x 75 cm White",), ("  A   b ",), ("q" * 50,)]
    assert values(spark, rows, "n string", text.variant_label("n")) == ["120 x 60 x 75 cm", "A b", "q" * 40]


def test_delivery_and_descriptions(spark):
    rows = [(3, 4), (3, 3), (0, 4), (4, 3), (29, 31), (None, 3)]
    d = config.DELIVERY
    assert values(spark, rows, "a int, b int", text.delivery_line("a", "b")) == [f"{d} | 4-5 Working Days", f"{d} | 4 Working Days", d, d, d, d]
    body = "\n\n🚚 old\nLine\n💳 pay\nMore\nPayNow again\n\n"
    assert values(spark, [(body,), ("",), (None,)], "t string", text.normal_description("t", F.lit("D"))) == [f"D\n\nLine\nMore\nPayNow again\n\n{config.PAYMENT}", "", None]
    got = values(spark, [([f"v{k}" for k in range(14)],), (None,), ([None, ""],)], "n array<string>", text.fixed_description(F.lit("D"), "n"))
    assert "📦 Options available: v0, " in got[0] and ", v11, and 2 more" in got[0] and "📦" not in got[1] and got[1] == got[2]
    assert got[1].split("\n")[:3] == ["D", "", "Brand new and unused, delivered straight to your door."]
    assert values(spark, [("a\n📦 Sizes available: x\n📦 Options available: y",)], "t string", text.without_sizes("t")) == ["a\n📦 Options available: y"]


def test_small_strings(spark):
    assert values(spark, [("https://c/file/abc.jpg?x",), ("https://c/file/abc@resize_w",)], "u string", text.image_hash("u")) == ["abc", "abc"]
    assert values(spark, [("u1 1x, u2 2x",)], "s string", text.srcset_first("s")) == ["u1"]
    assert values(spark, [("```json\n{}\n```",), ("x",)], "s string", text.unfenced("s")) == ["{}", "x"]
    assert values(spark, [("Verdict: good",), ("BAD",), (None,)], "s string", text.verdict_good("s")) == [True, False, False]
    assert values(spark, [("https://m.x/shopname?y",), ("https://m.x/product/1/2",)], "u string", text.shop_username("u")) == ["shopname", None]
    assert values(spark, [("日x",)], "s string", text.ascii_preview("s")) == ["?x"]
    assert values(spark, [("a", None), (None, "b"), ("", "")], "a string, b string", text.product_text("a", "b")) == ["a", "b", ""]
    assert values(spark, [("x#v12-7",), ("x#v12-q",)], "u string", text.slot_of("u")) == [7, None]
    assert values(spark, [(1, 200, False), (0, 0, False), (0, 403, False), (0, None, True), (0, None, False)], "n int, s int, t boolean", text.review_status("n", "s", "t")) == ["ok", "empty", "blocked", "timeout", "error"]
    assert values(spark, [("p", 2)], "a string, b int", text.fill_template("{A} x {B}", {"A": "a", "B": "b"})) == ["p x 2"]


def test_title_lint(spark):
    good = " | ".join(f"Segment {k}" for k in range(8))
    got = values(spark, [(good,), ("Cheap 120 cm! | 🚚 | A | a",), (None,)], "t string", text.title_issues("t"))
    assert got[0]["issues"] == [] and got[0]["segs"] == 8
    assert got[1]["issues"] == ["few-segments", "repeats", "banned-word", "emoji", "symbol"] and got[1]["has_dim"]


def test_similarity(spark):
    rows = [("word", "two words"), ("", ""), (None, "a"), ("same", "SAME")]
    got = values(spark, rows, "a string, b string", text.similarity(text.trigrams("a"), text.trigrams("b")))
    assert got == [pytest.approx(4 / 11), 0.0, 0.0, 1.0]


MODEL = "m array<struct<name: string, price: double, image: string>>"


def test_arrays(spark):
    rows = [(["a", "b"], ["a", "r1", None, "r2", "r3"]), ([], ["r"]), (None, ["r"]), (["a"], None)]
    assert values(spark, rows, "i array<string>, r array<string>", arrays.with_review_photos("i", "r")) == [["a", "r1", "r2", "b"], [], None, ["a"]]
    rows = [([("White", 69.99, "w"), ("Black", 69.99, "b"), (" Brown ", 69.99, None), ("x", 0.0, None)],), ([("One", 5.0, None)],), (None,)]
    got = values(spark, rows, MODEL, arrays.variant_groups("m"))
    assert [g["name"] for g in got[0]] == ["White", "Black", "Brown"] and got[1:] == [None, None]
    assert values(spark, rows, MODEL, arrays.max_cost(F.lit(None), F.lit(2.0), "m")) == [69.99, 5.0, 2.0]
    assert values(spark, [(["a", "b", "c"], "a", 2), (["a"], "a", 0), (["a", "b"], "b", 5)], "p array<string>, o string, k int", arrays.second_photo("p", "o", "k")) == ["b", None, "a"]
    assert values(spark, [(["a", "b", "c"], 2), (["a", "b", "c"], 0), (["a"], 3)], "i array<string>, d int", arrays.cover_and_dims("i", "d")) == [["a", "c"], ["a", "b"], ["a"]]
    assert values(spark, [(5, "ok", False), (None, "blocked", False), (0, None, True), (1, "", False)], "e int, s string, r boolean", arrays.guard_warnings("e", "s", "r")) == [None, ["no-edt", "reviews-blocked"], None, None]
    assert values(spark, [("c", None, " x ", "p, q,,")], "a string, b string, c string, e string", arrays.image_list("a", "b", "c", extra="e")) == [["c", "x", "p", "q"]]
    assert values(spark, [("1. bright plain room here\n- short\n* another good long line",), ("x",)], "s string", arrays.scene_lines("s", 4, ("f1", "f2"))) == [["bright plain room here", "another good long line"], ["f1", "f2"]]
    assert values(spark, [("short\n  a line that is longer  \nthe other longest one",), ("x",)], "s string", arrays.longest_line("s")) == ["a line that is longer", None]
    assert values(spark, [([("A", 1.0, None), ("B", 2.0, None)], ["A"]), ([("A", 1.0, None)], None)], f"{MODEL}, o array<string>", F.size(arrays.in_stock("m", "o"))) == [1, 1]
    got = values(spark, [([(0, "x"), (5, "y"), (-1, "z")], [7, 9])], "a array<struct<i: int, r: string>>, b array<int>", arrays.remapped("a", "b"))
    assert [(a["i"], a["r"]) for a in got[0]] == [(7, "x")]
    assert values(spark, [([(["b", "a"], ["v"]), (["a"], None)],)], "r array<struct<images: array<string>, covers: array<string>>>", arrays.review_images("r")) == [["b", "a", "v"]]


def test_rich_text(spark):
    h = "a" * 30
    cases = [
        (json.dumps("plain"), "plain", []), ("null", "", []), ("0", "", []), (None, "", []), ("{bad", "", []),
        (json.dumps({"paragraph_list": [{"type": 1, "text": "one"}, {"type": 2, "image": {"image_id": h}}]}), "one", [h]),
        (json.dumps({"extended": [{"text": "b"}, {"content": "a"}, {"image_hash": h, "img": "short"}, {"photo": "https://x/y.jpg"}]}), "b\na", [h, "https://x/y.jpg"]),
    ]
    got = values(spark, [(c[0],) for c in cases], "v string", jsons.rich_text_of("v"))
    assert [(g["text"], g["images"]) for g in got] == [(t, i) for _, t, i in cases]
    loop = {"text": "x"}
    loop["again"] = loop
    assert jsons.rich_text(loop) == ("x", [])


def test_json_paths(spark):
    item = {"data": {"item": {"name": "T", "price_min": 250000, "price_max": 0, "price": 300000, "sold": 4, "images": ["h"] * 12, "models": [{"name": "a", "price": 100000}, {"name": "b", "price": 0}]}}}
    got = values(spark, [(json.dumps(item),), ("{}",)], "x string", jsons.item_payload("x", "cdn/"))
    assert (got[0]["title"], got[0]["price"], got[0]["price_max"], got[0]["sold"], len(got[0]["images"]), len(got[0]["models"])) == ("T", 2.5, 3.0, 4, 9, 1) and got[1] is None
    ch = lambda f, a, b: {"channel_delivery_info": {"is_fastest_edt_channel": f, "estimated_delivery_time_min": a, "estimated_delivery_time_max": b}}
    rows = [(json.dumps([ch(False, 1, 5), ch(True, 1, 2)]),), (json.dumps([ch(False, 1, 0), ch(False, 3, 4)]),), ("[]",)]
    assert [tuple(x) for x in values(spark, rows, "x string", jsons.delivery_estimate("x"))] == [(1, 2), (3, 4), (None, None)]
    nested = json.dumps({"a": [{"itemid": 7, "models": [1]}, {"b": {"itemid": "7", "models": []}}, {"itemid": 8, "models": []}], "z": {"shopid": 44}})
    assert values(spark, [(nested,)], "x string", F.size(jsons.item_copies("x", F.lit("7"))), jsons.shop_id_of("x")) == [(2, 44)]


def test_html(spark):
    cdn = (r"https?://cdn\.x/file/[^\s\"'<>?#&]+",)
    page = """<meta content='Desc here - Buy Thing now' name='og:description'><meta property="og:title" content="Thing | Mart City">
      <meta property="og:image" content="https://img.mart/a.jpg?x"><meta property="og:image" content="https://else/b.jpg"><img src="https://cdn.x/file/h1?z"><img src="https://cdn.x/file/h1">"""
    ld = """<meta property="og:title" content="Mart City home"><script type="application/ld+json">{bad</script>
      <script type="application/ld+json">[{"@type": "Other"}, {"@type": "Product", "name": "N", "description": "D"}]</script>"""
    got = values(spark, [(page,), (ld,), ("",), (None,)], "h string", html.product("h", "Mart City", "mart", cdn))
    assert (got[0]["title"], got[0]["description"], got[0]["images"]) == ("Thing", "Desc here", ["https://img.mart/a.jpg", "https://cdn.x/file/h1"])
    assert (got[1]["title"], got[1]["description"]) == ("N", "D") and got[2] is None and got[3] is None


def test_offers_and_answers(spark):
    found = jsons.offers({"title": "A", "price": 0, "x": [{"title": "A", "price": "S$1,234.50"}, {"title": "A", "priceFormatted": "1234.5"}], "y": {"title": "B" * 95, "price": 3}})
    assert found == [("A", 1234.5), ("B" * 90, 3.0)]
    assert jsons.offers(None) == [] and jsons.offers([{"title": "A", "price": "..."}, {"price": 3}]) == []
    rows = [("\n ```json\n{\"description\": \"d\"}\n```",), ('{"a": 1}',), ("{not json",), (None,)]
    assert values(spark, rows, "a string", text.unwrapped("a")) == ["d", '{"a": 1}', "{not json", None]
    assert values(spark, [("p",)], "a string", text.fill_template("{A}{A} {B}{B}", {"A": "a", "B": "a"}, once=("A",))) == ["p{A} pp"]
    assert values(spark, [(0.5,), (1.005,), (None,), (-2.345,)], "a double", num.fixed("a", 2)) == ["0.50", "1.01", None, "-2.35"]
    assert values(spark, [("abcdef",), ("a",), (None,)], "a string", num.padded("a", 3)) == ["abcdef", "a  ", None]
