"""Operators: the cascade against a plain loop, the queue's invariants, joins, readers, streams."""

import json
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from soukspark import catalogue_queries, function_queries  # noqa: F401  the latter registers with the former
from soukspark.config import Flags
from soukspark.operators import fuzzy, hooks, listings, load, queue, sourcing
from soukspark.plans import adapters, ratio_band
from soukspark.sources import readers, sinks
from soukspark.streaming import inbox, leases

SMALL = "/root/testdata/sf0.001"
ITEM = "ord long, item_id string, shop_id long, shop_name string, name string, url string, price double, sold_text string, reviews long, rating double, location string, is_mock boolean, blocked boolean"


def item(ord, **more):
    base = {"item_id": str(ord), "shop_id": ord, "shop_name": "S", "name": "n", "url": f"https://x/product/1/{ord}", "price": 50.0, "sold_text": "1k+", "reviews": 100, "rating": 4.9, "location": "Singapore", "is_mock": False, "blocked": False}
    row = base | more
    return (ord, *[row[c.split()[0]] for c in ITEM.split(", ")[1:]])


CASES = [
    (item(1), None), (item(2, is_mock=True), "mock"), (item(3, blocked=True), "blocked"), (item(4, location="Mainland China", name="SG stock"), "not-local"),
    (item(5, location="", name="Desk SG stock"), None), (item(6, location="", shop_name="desk.sg"), None), (item(7, location="", shop_id=5), None), (item(8, location=""), "not-local"),
    (item(9, url=""), "no-url"), (item(10, url="https://x/a-i.9.9", reviews=0), "zero-reviews"), (item(11, url="https://x/product/9/9"), None), (item(12, url="https://x/a-i.9.9?p"), "duplicate"),
    (item(13, sold_text="<100", shop_id=113), "sold"), (item(14, sold_text="<100", shop_id=1), None), (item(15, price=99.99, reviews=40, shop_id=115), None), (item(16, price=99.99, reviews=39, shop_id=116), "reviews"),
    (item(17, price=100.0, reviews=24, rating=4.8, sold_text="", shop_id=117), None), (item(18, price=100.0, reviews=29, rating=4.79, shop_id=118), "reviews"), (item(19, price=200.0, reviews=16, shop_id=119, rating=4.8), None),
    (item(20, price=200.0, reviews=30, rating=4.49, shop_id=120, sold_text="<100"), "rating"), (item(21, price=5.0), "price-min"), (item(22, price=900.0), "price-max"), (item(23, price=5.0, url="https://x/product/1/21"), "duplicate"),
    (item(24, location=None, name="xésg", shop_name=None), None), (item(25, price=None, reviews=None, shop_id=None), "zero-reviews"), (item(26, location="MALÁSIA"), None),
]


def test_cascade_cases(spark):
    df = spark.createDataFrame([c[0] for c in CASES], ITEM)
    got = {r.ord: r.reason for r in sourcing.cascade(df, Flags(min_price=10, max_price=500)).collect()}
    assert got == {c[0][0]: c[1] for c in CASES}


def test_first_passing_copy_wins_as_in_a_loop(spark):
    rng = random.Random(1)
    rows = [item(k, url=f"https://x/product/1/{rng.randrange(8)}", reviews=rng.choice([0, 10, 100]), price=rng.choice([5.0, 50.0]), shop_id=k % 3 + 100, sold_text=rng.choice(["<100", "1k+"])) for k in range(80)]
    flags = Flags(min_price=10, trust_shops=False)
    got = {r.ord: r.reason for r in sourcing.cascade(spark.createDataFrame(rows, ITEM).repartition(5), flags).collect()}
    seen = set()
    for r in rows:
        ord, url, price, sold, reviews = r[0], r[5], r[6], r[7], r[8]
        if url in seen:
            want = "duplicate"
        elif reviews < 1:
            want = "zero-reviews"
        elif sold == "<100":
            want = "sold"
        elif reviews < 40:
            want = "reviews"
        else:
            seen.add(url)
            want = "price-min" if price < 10 else None
        assert got[ord] == want


def test_entry_and_oracles(spark):
    """Every query with SQL equals it on the smallest tables."""
    con = duckdb.connect()
    for t in (*adapters.TABLES, "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    assert __spark_entry__.entry(spark).count() > 0
    sql = catalogue_queries.oracle_sql()
    for name, f in catalogue_queries.queries().items():
        got = f(spark, SMALL)
        if name not in sql:
            assert got.count() > 0
            continue
        c = sorted(got.columns)
        want = con.execute(sql[name]).df()
        assert sorted(want.columns) == c, name
        rows = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df[c].astype(object).where(df[c].notna(), None).values.tolist())
        assert rows(got.toPandas()) == rows(want), name


def test_ratio_band_joins_by_hash(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(k, rng.uniform(0.1, 900)) for k in range(300)] + [(999, None), (998, 0.0)], "a long, x double")
    right = spark.createDataFrame([(k, rng.uniform(0.1, 900)) for k in range(300)] + [(999, -1.0)], "b long, y double")
    out = ratio_band.within_share(left, right, "x", "y", 0.1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.a, r.b) for r in out.collect()}
    lefts, rights = left.collect(), right.collect()
    assert got == {(p.a, q.b) for p in lefts for q in rights if p.x and q.y and q.y > 0 and p.x * 0.9 <= q.y <= p.x * 1.1}
    assert out.count() == len(got)


def test_fuzzy_best(spark):
    rows = spark.createDataFrame([(1, "blue wooden desk", 100.0), (2, "blue wooden desks", 105.0), (3, "blue wooden desk", 200.0), (4, "red chair", 100.0), (5, None, 100.0)], "id long, title string, cost double")
    best = fuzzy.best_match(fuzzy.pairs(rows, rows).where("probe_id <> id")).collect()
    assert {(r.probe_id, r.id) for r in best} == {(1, 2), (2, 1)}


def test_fuzzy_links_lose_none(spark):
    import random

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["blue", "wooden", "desk", "desks", "chair", "Ü"], k=rng.choice([1, 2, 3, 4]))), rng.choice([100.0, 105.0, 109.0, 111.0, 300.0])) for k in range(120)]
    rows += [(200 + k, "the same long title", 100.0) for k in range(30)] + [(300, None, 100.0), (301, "", 1.0), (302, "blue", 0.0), (303, "blue", None)]
    df = spark.createDataFrame(rows, "id long, title string, cost double")
    found = [tuple(r) for r in fuzzy.pairs(df, df).where("probe_id <> id").collect()]
    got = {r.id: r for r in fuzzy.links(df).collect()}
    assert len(got) == len(rows)
    for k, title, cost in rows:
        mine = [(-s, i) for p, i, s in found if p == k]
        assert got[k].n_links == len(mine)
        assert (got[k].best_id, got[k].best_score) == ((min(mine)[1], -min(mine)[0]) if mine else (None, None))
        same = [i for i, t, c in rows if c == cost and cost and t and sorted(set(t.lower().split())) == sorted(set(title.lower().split()))] if title and cost else []
        assert got[k].class_id == (min(same) if same else None)
    assert fuzzy.links(df.limit(0)).count() == 0


def test_fuzzy_costs_that_many_share_are_dealt_over_blocks(spark, monkeypatch):
    """Titles of like words at one cost: only similar pairs leave the blocks, of which one cost fills several."""
    import random

    rng = random.Random(6)
    words = ["desk", "desks", "lamp", "lamps", "台灯", "été", "𝔸𝔹", "oak"]
    rows = [(k, " ".join(rng.choices(words, k=4)), rng.choice([50.0, 50.0, 50.0, 55.0, 61.0])) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, title string, cost double")

    def grams(title):
        return {x for w in title.lower().split() for x in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))}

    sets = [grams(t) for _, t, _ in rows]
    want = {}
    for (i, _, x), a in zip(rows, sets, strict=True):
        for (j, _, y), b in zip(rows, sets, strict=True):
            if len(a & b) / len(a | b) >= 0.6 and x * 0.9 <= y <= x * 1.1:
                want[i, j] = len(a & b) / len(a | b)
    monkeypatch.setattr(fuzzy, "BLOCK", 300)
    monkeypatch.setattr(fuzzy, "AT_ONCE", 7)
    got = fuzzy.pairs(df, df)
    assert {(r.probe_id, r.id): r.score for r in got.collect()} == want and got.count() == len(want) > 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # with the buckets' sizes; candidates are never rows
    n = {r.id: r.n_links for r in fuzzy.links(df).collect()}
    assert n == {k: sum(i == k != j for i, j in want) for k, _, _ in rows}


# -- the queue -----------------------------------------------------------------------------------------------------

NOW = "2024-06-01 12:00:00"
QUEUE = "id long, source string, listing_url string, title string, price double, times_listed int, state string, account string, attempts int, holder string, held_since timestamp, done_at timestamp, done_url string, refusal string"


def queue_of(spark, n, account="A"):
    return spark.createDataFrame([(k, "s", f"u{k}", f"t{k}", 1.0, k, "pending", account, 0, None, None, None, None, None) for k in range(1, n + 1)], QUEUE)


def test_claims_take_the_most_listed_and_never_twice(spark):
    q = queue_of(spark, 100)
    staff = spark.createDataFrame([("w0", "A"), ("w1", "A"), ("w2", "B"), ("w3", None)], "id string, own_account string")
    taken = []
    for w in ("w0", "w1", "w0"):
        got = queue.claim(q, staff, w, 10, NOW)
        taken += [r.id for r in got.where("taken").collect()]
        q = spark.createDataFrame(got.drop("taken").collect(), got.drop("taken").schema)
    assert set(taken[:10]) == set(range(91, 101)) and len(set(taken)) == 30 == len(taken)
    assert q.count() == 100 and q.where("attempts = 1").count() == 30
    for w in ("w2", "w3", "nobody"):
        assert queue.claim(q, staff, w, 10, NOW).where("taken").count() == 0
    late = queue.claim(q, staff, "w1", 100, "2024-06-01 16:00:01").where("taken")
    assert late.count() == 100
    assert queue.claim(q, staff, "w1", 100, "2024-06-01 16:00:00").where("taken").count() == 70


def test_queue_changes(spark):
    rows = [(1, "A", "claimed", "w"), (2, "B", "pending", None), (3, "C", "done", "x"), (4, "D", "claimed", "y"), (5, "A", "claimed", "w")]
    urls = {1: "p", 2: "p", 3: "p", 4: "p", 5: None}
    q = spark.createDataFrame([(i, "s", urls[i], "t", 1.0, 1, s, a, 2, w, datetime(2024, 6, 1, 11), None, None, None) for i, a, s, w in rows] + [(6, "s", None, "t", 1.0, 1, "pending", "B", 0, None, None, None, None, None)], QUEUE)
    state = lambda df: {r.id: (r.state, r.refusal) for r in df.collect()}
    got = state(queue.reject(q, "w", [1, 5], NOW))
    assert got == {1: ("rejected", None), 2: ("rejected", "rejected [via another account]"), 3: ("done", None), 4: ("claimed", None), 5: ("rejected", None), 6: ("pending", None)}
    assert queue.reject(q, "z", [1], NOW).where("changed").count() == 0
    ids = spark.createDataFrame([(1,), (4,), (4,), (None,)], "id long")
    assert state(queue.complete(q, "w", ids, NOW, "link")) == state(queue.complete(q, "w", [1, 4], NOW, "link"))
    done = queue.complete(q, "w", [1, 4], NOW, "link")
    assert [(r.id, r.state, r.done_url) for r in done.where("changed").collect()] == [(1, "done", "link")]
    freed = queue.release(q, "w").where("changed").collect()
    assert {(r.id, r.state, r.holder, r.attempts) for r in freed} == {(1, "pending", None, 2), (5, "pending", None, 2)}
    first = queue.clone(q, "E", "A")
    assert first.count() == 2
    again = q.unionByName(first.withColumn("id", F.lit(9)), allowMissingColumns=True)
    assert [r.listing_url for r in queue.clone(again, "E", "A").collect()] == [None]


def test_public_rows_hide_costs(spark):
    assert "source_cost" not in queue.public(queue_of(spark, 3).withColumn("source_cost", F.lit(1))).columns


def test_queue_mode_table(spark):
    staff = spark.createDataFrame([("t", True, True), ("f", True, False), ("n", True, None), ("off", False, True)], "id string, active boolean, by_queue boolean")
    asked = spark.createDataFrame([("t", False), ("f", False), ("t", True), ("f", True), ("n", False), ("off", False), ("gone", True)], "worker_id string, mode boolean")
    got = [(r.worker_id, r.status, r.by_queue) for r in queue.gate(asked, staff).collect()]
    assert sorted(got) == sorted([("t", 200, True), ("f", 200, False), ("t", 200, True), ("f", 200, True), ("n", 200, False), ("off", 403, True), ("gone", 404, True)])


def test_finished_listings(spark):
    rows = spark.createDataFrame([(1, "w", "active", None), (2, "w", "done", "l"), (3, "v", "active", None), (4, "w", "active", None), (5, "w", "active", None)], "id long, assigned_worker_id string, status string, sold_url string")
    asked = spark.createDataFrame([(1, "w", False, "x"), (2, "w", False, "x"), (3, "w", False, "x"), (4, "w", True, None), (9, "w", False, None)], "listing_id long, worker_id string, skip boolean, url string")
    got = {r.id: (r.outcome, r.status, r.sold_url) for r in queue.finish_listings(rows, asked).collect()}
    assert got == {1: ("200", "done", "x"), 2: ("409", "done", "l"), 3: ("403", "active", None), 4: ("deleted", "active", None), 5: (None, "active", None), 9: ("404", None, None)}


# -- loading, listings ---------------------------------------------------------------------------------------------


def test_insert_ignore(spark):
    have = spark.createDataFrame([("a", "1")], "k string, acc string")
    rows = spark.createDataFrame([(2, "b", "1"), (1, "b", "1"), (3, "a", "1"), (4, "a", "2"), (5, None, "1"), (6, None, "1")], "ord long, k string, acc string")
    assert sorted(r.ord for r in load.insert_ignore(have, rows, ["k", "acc"]).collect()) == [1, 4, 5, 6]


def test_covers(spark):
    answers = spark.createDataFrame([(1, 0, "cover", False, "a"), (1, 1, "cover", True, "b"), (1, 2, "cover", True, "a"), (1, 3, "skip", False, "c"), (1, 4, "cover", False, "d"), (1, 5, "cover", None, None)], "product long, i int, role string, needs_clean boolean, url string")
    covers = listings.cover_map(answers)
    assert {(r.url, r.needs_clean, r.ord) for r in covers.collect()} == {("a", True, 0), ("b", True, 1), ("d", False, 4)}
    assert [r.cover for r in listings.clean_gate(covers, None).collect()] == ["d"]
    cleaned = spark.createDataFrame([(1, "a", "a2"), (1, "b", None)], "product long, url string, cleaned_url string")
    usable = listings.clean_gate(covers, cleaned)
    products = spark.createDataFrame([(1, "u", "t", "T | x | y", "d", 20.0, ["r1", "r2", "r3"])], "product long, url string, title string, ai_title string, ai_description string, cost double, review_images array<string>")
    dims = spark.createDataFrame([(1, "d")], "product long, dims_url string")
    out = listings.by_cover(products, usable, dims).orderBy("listing_url").collect()
    assert [(r.listing_url, r.images, r.sell_price) for r in out] == [("u#c0", ["a2", "r1", "r2", "d"], 50), ("u#c1", ["d", "r1", "r2"], 50)]


def test_merged_copies_and_swatches(spark):
    rows = [("x", 1, None, "first", []), ("x", 2, 5.0, "", ["i"]), ("x", 3, 6.0, "later", ["j"])]
    out = listings.merged_copies(spark.createDataFrame(rows, "item string, ord long, price double, description string, images array<string>")).first()
    assert (out.price, out.description, out.images) == (5.0, "first", ["i"])
    models = spark.createDataFrame([(1, 0, "a", None, 0), (1, 1, "b", "own", 1), (1, 2, "c", None, 9)], "product long, pos int, name string, image string, tier_index int")
    options = spark.createDataFrame([(1, ["s0", "s1"])], "product long, images array<string>")
    assert {(r.name, r.image) for r in listings.swatches(models, options).collect()} == {("a", "s0"), ("b", "own"), ("c", None)}


@pytest.mark.parametrize("n", [0, 1, 20, 21, 81, 200, 201])
def test_batches_tile_the_pool(spark, n):
    pool = spark.range(n).select(F.lit(1).cast("long").alias("product"), F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("url"))
    sizes = [r["count"] for r in listings.batches(pool).groupBy("batch").count().collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 20) and (not sizes or max(sizes) - min(sizes) <= 1)


def test_a_failing_batch_leaves_the_others(spark):
    pool = listings.batches(spark.range(60).select(F.lit(1).cast("long").alias("product"), F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("url"))).coalesce(1)

    def model(part):
        if (part["i"] == 7).any():
            raise ValueError
        return hooks.stub_classifier(part).assign(i=lambda f: f["i"])

    assert hooks.classify(pool, model).count() == 40
    assert hooks.classify(pool, hooks.stub_classifier).count() == 60


def test_outcomes(spark):
    rows = [(True, "u", 3, "new"), (None, "", 3, "new"), (False, "u", 3, "block"), (False, "u", 14, "new"), (False, "u", 14, "refresh"), (False, "u", None, "new")]
    out = listings.outcome(spark.createDataFrame(rows, "unloaded boolean, listing_url string, edt_max int, action string"))
    assert [r.outcome for r in out.collect()] == ["unloaded", "no-url", "duplicate", "lead-time-too-long", "refresh", "ok"]


# -- readers and writers -------------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"itemId": "1", "name": "x", "price": 2.5, "_mock": True}, {"itemId": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"itemId": "3", "historicalSoldEstimated": "1k+"}]}))
    got = readers.exports(spark, [f"{tmp_path}/b.json", f"{tmp_path}/a.json"])
    assert [r.itemId for r in got.orderBy("ord").collect()] == ["3", "1", "2"]
    (tmp_path / "block.txt").write_text("# note\n12 why\n34#x\n\nabc\n56\n7x\n")
    block = readers.blocklist(spark, f"{tmp_path}/block.txt")
    assert {r.id for r in block.collect()} == {"12", "34", "56"} and readers.blocklist(spark, None).count() == 0
    assert readers.as_items(got, block).count() == 3
    (tmp_path / "c.csv").write_text('listing_url,title\nu1,"a ""q"", b"\nu2,\n')
    assert [r.title for r in readers.csv(spark, f"{tmp_path}/c.csv").orderBy("ord").collect()] == ['a "q", b', None]
    for name in ("shop-1.json", "shop-2.json"):
        (tmp_path / name).write_text(json.dumps({"shopid": 1, "username": "u", "items": [{"itemid": 5, "price": 1.0}, {"itemid": 5, "price": 2.0}]}))
    assert readers.newest(spark, str(tmp_path), "shop-*.json").endswith("shop-2.json")
    shop = readers.shop_catalogue(spark, f"{tmp_path}/shop-1.json")
    assert [(r.itemid, r.price) for r in readers.first_of_each(shop, "itemid").collect()] == [(5, 1.0)]
    (tmp_path / "k.json").write_text(json.dumps({"keywords": ["a", "b", "a"], "limit": 3}))
    assert {(r.keyword, r.limit) for r in readers.keywords(spark, f"{tmp_path}/k.json").collect()} == {("a", 3), ("b", 3)}
    (tmp_path / "p.png").write_bytes(b"\x01\x02")
    assert readers.data_uris(spark, f"{tmp_path}/p.png").first().uri == "data:image/png;base64,AQI="


def test_writers(spark, tmp_path):
    judged = sourcing.cascade(spark.createDataFrame([c[0] for c in CASES], ITEM))
    sinks.queue_csv(sourcing.kept(judged), f"{tmp_path}/q")
    assert spark.read.csv(f"{tmp_path}/q", header=True).count() == judged.where("reason is null").count()
    sinks.rejects_csv(sourcing.rejects(judged), f"{tmp_path}/r")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "ord long, k string")
    sinks.append(rows.limit(1), f"{tmp_path}/t")
    for _ in range(2):
        sinks.append_new(spark.read.parquet(f"{tmp_path}/t").cache(), rows, ["k"], f"{tmp_path}/t")
        spark.catalog.clearCache()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    sinks.catalogue_json(rows, f"{tmp_path}/j")


# -- streams -------------------------------------------------------------------------------------------------------


def test_lease_steps():
    t = datetime(2024, 6, 1)
    s, ok = leases.step(None, "add", None, t)
    assert ok and leases.step(None, "claim", "w", t) == (None, False)
    s, ok = leases.step(s, "claim", "w", t)
    assert ok and s[3] == 1
    assert not leases.step(s, "claim", "v", t + timedelta(minutes=45))[1] and leases.step(s, "claim", "v", t + timedelta(hours=5))[1]
    assert not leases.step(s, "complete", "v", t)[1]
    done, ok = leases.step(s, "complete", "w", t)
    assert ok and not leases.step(done, "claim", "v", t + timedelta(days=9))[1]


def test_lease_stream(spark, tmp_path):
    t = datetime(2024, 6, 1)
    ddl = "id long, ts timestamp, action string, worker string"
    spark.createDataFrame([(1, t, "add", None), (1, t + timedelta(hours=1), "claim", "w"), (2, t, "claim", "w")], ddl).coalesce(1).write.parquet(f"{tmp_path}/c/1")
    source = spark.readStream.schema(ddl).option("recursiveFileLookup", True).parquet(f"{tmp_path}/c")
    for more in (None, [(1, t + timedelta(hours=2), "claim", "v"), (1, t + timedelta(hours=3), "complete", "w")]):
        if more:
            spark.createDataFrame(more, ddl).coalesce(1).write.parquet(f"{tmp_path}/c/2")
        q = leases.apply(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [(r.id, r.action, r.ok, r.state) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id", "ts").collect()]
    assert got == [(1, "add", True, "pending"), (1, "claim", True, "claimed"), (1, "claim", False, "claimed"), (1, "complete", True, "done"), (2, "claim", False, None)]


def test_inbox_stream(spark, tmp_path):
    ddl = "item_id string, created_at timestamp, title string, tries int, outcome string"
    t = datetime(2024, 6, 1)
    spark.createDataFrame([("a", t, "x", 1, "ok"), ("a", t, "x", 1, "ok"), ("b", t, None, 3, "unloaded")], ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = inbox.attempts(inbox.first_seen(inbox.source(spark, f"{tmp_path}/in", ddl)))
    q = inbox.write_outcomes(rows, f"{tmp_path}/ok", f"{tmp_path}/dead", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 1
    assert [r.unloaded for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [True]


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    done = adapters.view(spark, SMALL, adapters.DONE).select("worker_id", "done_at")
    done.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = inbox.daily_counts(spark.readStream.schema(done.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = queue.daily(done.withColumn("day", queue.local_day("done_at"))).select("worker_id", "day", "n")
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in want.collect()}


def test_small_operators(spark):
    urls = spark.createDataFrame([("https://sg.shp.ee/x",), ("https://evilshopee.sg/i.jpg",), ("https://a.susercontent.com/f",), (None,)], "url string")
    from soukspark.functions import text

    got = urls.select(text.is_source_url("url"), text.is_proxied_image("url")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, True), (False, False)]
    links = spark.createDataFrame([("https://sg.shp.ee/x", "https://m/product/1/2")], "short string, target string")
    assert [r.url for r in listings.resolved(urls.limit(2), links).orderBy("url").collect()] == ["https://evilshopee.sg/i.jpg", "https://m/product/1/2"]
    rows = spark.createDataFrame([("desk", "Singapore", 4.5, 20.0), ("toy", "China", 3.0, 500.0), (None, None, None, None)], "category string, shop_location string, rating double, cost double")
    assert [r.warnings for r in listings.extra_warnings(rows, ["desk"]).collect()] == [[], ["category", "seller", "rating", "cost"], []]
    t = datetime(2024, 6, 1)
    held = spark.createDataFrame([(1, "Blue desk", None, "w", t, "done", "https://m.carousell.sg/p/1"), (2, "x", "Big DESK", None, t, "done", None), (3, "y", "", "w", t, "active", None)], "id long, title string, ai_title string, assigned_worker_id string, created_at timestamp, status string, sold_url string")
    assert sorted(r.id for r in listings.search(held, "desk").collect()) == [1, 2] and [r.id for r in listings.search(held, "desk", True).collect()] == [1]
    assert [r.id for r in listings.to_regenerate(held, 2).collect()] == [1, 3]
    assert [r.id for r in listings.link_faults(held).collect()] == [2]
    inboxes = spark.createDataFrame([(3, False), (1, True), (2, None)], "id long, consumed boolean")
    assert [r.id for r in listings.oldest_pending(inboxes).collect()] == [2, 3]
    found = spark.createDataFrame([(1, 2, 0.7)], "probe_id long, id long, score double")
    assert listings.duplicate_log(found, held.withColumn("listing_url", F.lit("u")), NOW).first().matched_id == 2


def test_regeneration_and_copy(spark):
    rows = spark.createDataFrame([("Title one\nmore", 3, 4, ["a"], ""), ("T", None, None, None, "kept")], "title string, edt_min int, edt_max int, variant_names array<string>, ai_title string")
    assert [r.ai_title for r in hooks.regenerate(rows).collect()] == ["Title one", "kept"]
    made = hooks.copy_text(rows).collect()
    assert made[0].ai_title == "Title one" and made[0].ai_description.startswith("🚚 Free Doorstep Delivery | 4-5 Working Days")
    shots = spark.createDataFrame([(1, "u"), (1, None)], "id long, shot_url string")
    assert tuple(hooks.shot_counts(shots, 3).first()) == (1, 1, 2)


def test_inserting_twice_adds_nothing(spark):
    old = spark.createDataFrame([("u1", "active"), ("u2", "deleted")], "listing_url string, status string")
    rows = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3"), (4, "u3"), (5, None)], "ord int, listing_url string")
    new = listings.fresh(old, rows)
    assert sorted(r.ord for r in new.collect()) == [2, 3, 5]
    after = old.unionByName(new.select("listing_url", F.lit("active").alias("status")))
    assert [r.ord for r in listings.fresh(after, rows).collect()] == [5]
    assert listings.fresh(old, rows.limit(0)).count() == 0


def test_a_refresh_takes_over_nulls_too(spark):
    row = "existing_id int, action string, ord int, assigned_worker_id string, own_account string, ai_title string, ai_description string, images array<string>, guard_warnings array<string>, source_cost double, sell_price double"
    held = spark.createDataFrame([(1, "t", "w0", "a", "x", "d", ["i"], ["g"], 1.0, 2.0), (2, "u", "w0", "a", "x", "d", ["i"], None, 1.0, 2.0)], "id int, title string, assigned_worker_id string, own_account string, ai_title string, ai_description string, images array<string>, guard_warnings array<string>, source_cost double, sell_price double")
    new = spark.createDataFrame([(1, "refresh", 1, "w1", None, "y", None, None, None, None, 9.0), (1, "refresh", 2, "w2", None, None, None, ["j"], None, None, 8.0), (2, "block", 1, "w1", None, "y", None, None, None, None, 9.0), (7, "refresh", 1, "w1", None, "y", None, None, None, None, 9.0)], row)
    got = {r.id: r for r in listings.refreshed(held, new).collect()}
    assert (got[1].title, got[1].assigned_worker_id, got[1].ai_title, got[1].images, got[1].guard_warnings, got[1].sell_price, got[1].changed) == ("t", "w2", None, ["j"], None, 8.0, True)
    assert (got[2].assigned_worker_id, got[2].changed) == ("w0", False) and len(got) == 2


def test_chats_are_capped_for_each_capture(spark):
    rows = spark.createDataFrame([(c, k, f"h{k % 70}") for c in range(2) for k in range(200)], "capture int, ord int, href string")
    got = listings.chats(rows).collect()
    assert sorted((r.capture, r.ord) for r in got) == [(c, k) for c in range(2) for k in range(50)]


def test_exports_of_many_paths_are_one_scan(spark, tmp_path):
    paths = []
    for k in range(12):
        (tmp_path / f"x={k} +%").mkdir()
        (tmp_path / f"x={k} +%" / "part.json").write_text('[{"itemId": "%d"}]' % k)
        paths.append(f"{tmp_path}/x={k} +%")
    got = readers.exports(spark, paths)
    assert {r.itemId: r.ord for r in got.collect()} == {str(k): k << 40 for k in range(12)}
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
