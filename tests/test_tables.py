"""Tables changed in place, medians in passes, facts kept up to date and calls in flight."""

import datetime as dt
import random
import re
import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from soukspark import function_queries, scratch
from soukspark.config import Flags
from soukspark.functions.text import trigrams
from soukspark.operators import facts, fuzzy, hooks, listings, medians, queue, sourcing, title_index
from soukspark.sources import keyed, readers, sinks
from soukspark.streaming import inbox

QUEUE = "id long, account string, listing_url string, times_listed int, state string, holder string, held_since timestamp, attempts int, refusal string, done_at timestamp, done_url string, price double"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_change_writes_the_partitions_of_its_keys_alone(spark, tmp_path):
    old = dt.datetime(2024, 1, 1)
    rows = [(k, [None, "a", "b"][k % 3], f"u{k // 3}", k % 7, "claimed" if k % 4 == 0 else "pending", "w2" if k % 4 == 0 else None, old if k % 8 == 0 else None, 0, None, None, None, 1.0) for k in range(300)]
    staff = spark.createDataFrame([("w1", "a"), ("w2", "b"), ("w3", None)], "id string, own_account string")
    table = keyed.KeyedTable(spark, f"{tmp_path}/queue", buckets=16)
    start = spark.createDataFrame(rows, QUEUE)
    table.create(start)
    now, want = "2024-06-01 00:00:00", start

    def same(want):
        a, b = (sorted(map(tuple, x.select(*start.columns).collect()), key=repr) for x in (table.rows(), want))
        assert a == b

    before = files(f"{tmp_path}/queue")
    taken = [r.id for r in keyed.claim(table, staff, "w1", 3, now).collect()]
    after = files(f"{tmp_path}/queue")
    gone = set(before) - set(after)
    assert len(taken) == 3 and 1 <= len(gone) <= 3 and all(x.startswith("account=a/") for x in gone)
    assert all(after[x] == before[x] for x in set(before) & set(after))
    want = queue.claim(want, staff, "w1", 3, now).drop("taken")
    same(want)
    assert keyed.claim(table, staff, "w3", 3, now).count() == 0 and keyed.claim(table, staff, "w9", 3, now).count() == 0
    assert files(f"{tmp_path}/queue") == after
    assert keyed.complete(table, "w1", taken[:1], now, "done.example").count() == 1
    want = queue.complete(want, "w1", taken[:1], now, "done.example").drop("changed")
    same(want)
    hit = keyed.reject(table, "w1", taken[1:2], now, "dud").collect()
    want = queue.reject(want, "w1", taken[1:2], now, "dud").drop("changed")
    same(want)
    assert {r.account for r in hit} == {"a", "b", None} or len(hit) >= 1
    keyed.release(table, "w2")
    want = queue.release(want, "w2").drop("changed")
    same(want)


def test_medians_in_passes(spark, monkeypatch):
    rng = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 7 + [9.0] * 7, "wide": [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(999)], None: [float(k) for k in range(50)], "huge": [-1.7e308, 1.7e308, 1.6e308], "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, price double")
    for ranges in (1024, 40):
        monkeypatch.setattr(medians, "RANGES", ranges)
        got = {r.g: r.median for r in medians.upper(df, ["g"], "price").collect()}
        assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}
        assert medians.upper(df.where("g = 'none'"), [], "price").count() == 0
    assert medians.upper(df.where("g = 'ties'"), [], "price").first()[0] == 9.0


def test_a_group_of_a_million_distinct_values(spark):
    """No task sees more of the group than its share of the input and the counts of the ranges."""
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("(id * 7919) % 1000003 / 8 as v")
    assert medians.upper(df, [], "v").first()[0] == sorted((k * 7919) % 1000003 / 8 for k in range(1_000_000))[500_000]


ITEM = "ord long, item_id string, shop_id long, shop_name string, name string, url string, price double, sold_text string, reviews long, rating double, location string, is_mock boolean, blocked boolean"


def test_exports_one_after_another_equal_one_run_over_all(spark):
    """Verdicts of old rows change where a shop gains a fact or an earlier copy comes to pass."""
    rng = random.Random(7)
    pick = rng.choice
    rows = [
        (k, None, pick([None, *range(12)]), "Shop", pick(["Desk", "Desk SG stock", "Lamp hdb"]), pick([None, f"https://x/product/1/{rng.randrange(40)}"]), pick([5.0, 40.0, 120.0, 250.0]), pick(["<100", "500+", "10k+"]), pick([0, 10, 25, 60]),
         pick([3.0, 4.2, 4.9]), pick(["", "Singapore", "Malaysia", "Mainland China"]), rng.random() < 0.1, rng.random() < 0.1)
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, ITEM).repartition(3)
    flags = Flags(min_price=10, max_price=200)
    known, flips = facts.Facts(flags), 0
    for a, b in ((0, 60), (60, 61), (61, 200), (200, 200), (200, 400)):
        before = {r.ord: r.reason for r in known.verdicts.collect()} if known.verdicts is not None else {}
        out = known.add(df.where(f"ord >= {a} and ord < {b}")).collect()
        want = {r.ord: (r.reason, r.good) for r in sourcing.judged(df.where(f"ord < {b}"), flags).collect()}
        assert {r.ord: (r.reason, r.good) for r in known.verdicts.collect()} == want
        assert {r.ord for r in out} == set(range(a, b)) | {k for k, was in before.items() if was != want[k][0]}
        flips += sum(r.known for r in out)
    assert flips
    assert {r.ord: r.reason for r in sourcing.cascade(df, flags).collect()} == {k: v[0] for k, v in want.items()}


def test_each_exports_rows_and_verdicts_are_stored_once(spark, monkeypatch):
    """Two exports of 300 rows that share no shop: twice 600 rows are stored, beside shops and first copies, and what came of
    the first ones can still be read later."""
    df = spark.range(600).selectExpr("id ord", "null item_id", "id div 3 shop_id", "'Shop' shop_name", "'Desk hdb' name", "concat('https://x/product/1/', id) url", "50D price", "'10k+' sold_text", "90L reviews", "4.9D rating", "'Singapore' location", "false is_mock", "false blocked")
    kept, known = [], facts.Facts(Flags())
    monkeypatch.setattr(facts, "stored", lambda rows, name: kept.append((name, t := scratch.stored(rows, name))) or t)
    first = known.add(df.where("ord < 300"))
    n = {name: t.count() for name, t in kept}
    known.add(df.where("ord >= 300"))
    n |= {f"{name} again": t.count() for name, t in kept[len(n) :] if name not in ("shops", "firsts")}
    assert sum(v for k, v in n.items() if k not in ("shops", "firsts")) == 1200
    assert first.count() == 300 and known.verdicts.where("reason is null").count() == 600


def test_stored_tables_leave_no_shuffle_files(spark):
    def left():
        """Files of shuffles, by number."""
        folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return {p.name for p in folder.rglob("shuffle_*.data")}

    before = left()
    held = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    assert len(scratch.stored(held, "counts").collect()) == 700  # which shuffles nothing
    deadline = time.time() + 20
    while (more := left() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not more
    assert spark.conf.get(scratch._CLEANED, "false") == "false"


def test_wide_rows_meet_their_verdicts_once(spark, tmp_path):
    """Also where numbers come twice, with other columns or the same, or are missing; rejects are the same compressed."""
    rows = [(k // 2 if k % 9 else None, None, k % 5, "Shop", ["Desk", "Desk hdb"][k % 2], f"https://x/product/1/{k % 30}", [40.0, 250.0][k % 7 == 0], ["<100", "10k+"][k % 3 > 0], 60, 4.9, ["", "Singapore", "Mainland China", None][k % 4], k % 11 == 0, k % 13 == 0) for k in range(150)]
    df = spark.createDataFrame(rows + rows[:20], ITEM).repartition(3)
    for flags in (Flags(max_price=200), Flags(local_only=False)):
        want = sorted(((r.ord, r.shop_id, r.product_id, r.price_n, r.reason, r.good) for r in sourcing.judged(df, flags).collect()), key=repr)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = sourcing.cascade(df, flags)
            plan = out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(((r.ord, r.shop_id, r.product_id, r.price_n, r.reason, r.good) for r in out.collect()), key=repr) == want
        assert plan.count("Exchange hashpartitioning") <= 2
    for how in ("none", "gzip"):
        sinks.rejects_csv(sourcing.rejects(out), f"{tmp_path}/{how}", how)
    assert list(Path(f"{tmp_path}/gzip").glob("*.csv.gz"))
    read = [sorted(map(tuple, readers.csv(spark, f"{tmp_path}/{how}").drop("ord").collect()), key=repr) for how in ("none", "gzip")]
    assert read[0] == read[1] and len(read[0]) == sum(w[4] is not None for w in want)


def _images(spark, products, n):
    rows = spark.range(products * n).selectExpr(f"id div {n} as product", f"cast(id % {n} as int) as i", "concat('u', id) as url")
    return listings.batches(rows)


def test_calls_are_in_flight_together_and_answers_kept(spark, tmp_path):
    log, seen = f"{tmp_path}/calls", f"{tmp_path}/answers"

    def model(part):
        """Waits, and notes how many calls were under way when it began."""
        with open(log, "a") as f:
            f.write(f"{threading.active_count()} {len(part)}\n")
        if (part["url"] == "u7").any() and not Path(f"{tmp_path}/well").exists():
            raise TimeoutError
        time.sleep(0.2)
        return hooks.stub_classifier(part)

    pool = _images(spark, 2, 220).coalesce(1)
    got = hooks.classify(pool, model, seen).collect()
    calls = [tuple(map(int, x.split())) for x in Path(log).read_text().split("\n")[:-1]]
    # of 220 images of each product 200 are asked about, in 11 calls; the one that failed has no answers
    assert len(calls) == 22 and sum(n for _, n in calls) == 400 and max(n for n, _ in calls) > 4
    lost = next(n for n in (18, 19, 20, 21) if len(got) == 400 - n)
    assert lost and max(r.i for r in got) == 199 and len(list(Path(seen).iterdir())) == 21
    Path(f"{tmp_path}/well").touch()
    again = hooks.classify(pool, model, seen).collect()
    assert len(again) == 400 and set(map(tuple, got)) < set(map(tuple, again))
    assert len(Path(log).read_text().split("\n")[:-1]) == 23  # the failed call alone was made again


def test_the_index_of_titles(spark, tmp_path):
    """Lookups equal the pairs found from scratch, and move the probes to the index, not the index."""
    rng = random.Random(3)
    words = ["oak", "table", "large", "small", "desk", "lamp", "été", "台灯"]
    rows = [(k, " ".join(rng.choices(words, k=5)), float(rng.choice([10, 10.5, 12, 99, 0]))) for k in range(200)] + [(7, "oak desk lamp", 10.0), (8, None, 10.0), (9, "", 10.0)]
    df = spark.createDataFrame(rows, "id long, title string, cost double")
    index = title_index.TitleIndex(spark, "test_titles", f"{tmp_path}/index", buckets=3)
    index.build(df.where("id < 150"))
    index.append(df.where("id >= 150"))
    index.append(df.where("id = 160"))  # once more
    probes = df.where("id % 3 = 0 or id in (7, 8)")
    same = sorted(set(map(tuple, fuzzy.pairs(probes, df).collect())))
    assert sorted(set(map(tuple, index.similar(probes).collect()))) == same and len(same) > 60
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.similar(probes)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda x: max(x.find("+-"), x.find(":-"))
    for part in ("entries", "sets"):
        at = next(k for k, x in enumerate(plan) if f"test_titles_{part}" in x)
        above, low = [], depth(plan[at])
        for x in reversed(plan[:at]):
            if -1 < depth(x) < low:
                above.append(x)
                low = depth(x)
                if "Join" in x:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above), above
    index.register("test_similar")
    asked = probes.select(F.col("id").alias("probe_id"), F.array_sort(trigrams("title")).alias("g"), "cost")
    got = spark.sql("select distinct probe_id, s.id, s.score from {p} p, lateral test_similar(p.g, p.cost) s", p=asked).collect()
    assert sorted(map(tuple, got)) == same
    index.drop()


def test_three_files_a_batch(spark, tmp_path):
    spark.range(0, 70, 1, 7).selectExpr("cast(id as string) item_id", "timestamp '2024-06-01' created_at", "'t' title", "0 tries", "'ok' outcome").write.parquet(f"{tmp_path}/in")
    rows = inbox.source(spark, f"{tmp_path}/in", "item_id string, created_at timestamp, title string, tries int, outcome string")
    inbox.write_outcomes(inbox.attempts(inbox.first_seen(rows)), f"{tmp_path}/ok", f"{tmp_path}/dead", f"{tmp_path}/state").awaitTermination()
    sizes = [spark.read.parquet(str(p)).count() for p in sorted(Path(f"{tmp_path}/ok").glob("batch=*"))]
    assert [s for s in sizes if s] == [30, 30, 10]


def test_small_tables_of_few_files_are_dealt_over_the_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for files in (1, cores):
        spark.range(0, 1000, 1, files).write.parquet(f"{tmp_path}/{files}")
        table = scratch.spread(spark.read.parquet(f"{tmp_path}/{files}"))
        assert table.count() == 1000 and ("RepartitionByExpression" in (plan := str(table._jdf.queryExecution().logical())) or "Repartition" in plan) == (files < cores)


def test_lookups_join_no_candidates_back(spark, tmp_path):
    """Sets are compared in the join itself, by function and by frame alike, and none is shipped with a candidate."""
    rows = [(k, f"{x} wooden desk", c) for k, (x, c) in enumerate((x, c) for x in ("oak", "oaks", "birch", "台灯") for c in (10.0, 10.9, 12.0))]
    df = spark.createDataFrame(rows, "id long, title string, cost double")
    index = title_index.TitleIndex(spark, "test_narrow", f"{tmp_path}/index", buckets=2)
    index.build(df)
    index.register("test_narrow_similar")
    probes = df.select(F.col("id").alias("probe_id"), F.array_sort(trigrams("title")).alias("g"), "cost")
    got = spark.sql("select probe_id, s.id, s.score from {p} p, lateral test_narrow_similar(p.g, p.cost) s", p=probes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fuzzy.pairs(df, df).collect())) == sorted(map(tuple, index.similar(df).collect()))
    plan = index.similar(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "array_intersect" in next(x for x in plan.split("\n") if "Join" in x and "bit_count" in x)
    index.drop()


def test_matches_of_many_probes_take_no_trigrams_along(spark, tmp_path):
    """The table function for many probes finds what the other does, and nothing that is shuffled after the index is met holds an array."""
    rows = [(k, f"{x} wooden desk", c) for k, (x, c) in enumerate((x, c) for x in ("oak", "oaks", "birch", "台灯") for c in (10.0, 10.9, 12.0))]
    df = spark.createDataFrame(rows, "id long, title string, cost double")
    index = title_index.TitleIndex(spark, "test_asked", f"{tmp_path}/index", buckets=2)
    index.build(df)
    index.append(df.where("id < 3"))  # once more
    index.register_asked("test_asked_similar", df)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, (-1, False), strict=True):
        spark.conf.set(k, v)
    try:
        got = spark.sql("select probe_id, s.id, s.score from {p} p, lateral test_asked_similar(p.probe_id) s", p=df.select(F.col("id").alias("probe_id")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fuzzy.pairs(df, df).collect()))
        sizes = exchanged(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) > 2 and sum("array" in s for s in sizes) == 2, sizes  # probes as they are read and on their way to the index
    index.drop()


def exchanged(df):
    """Types of the rows of each shuffle of a plan (one that is not adaptive)."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        x = todo.pop()
        if x.nodeName() == "Exchange":
            out.append(x.schema().simpleString())
        todo += [x.children().apply(k) for k in range(x.children().size())]
    return out


def test_a_model_that_answers_by_row_takes_many_batches_at_once(spark, tmp_path):
    pool = spark.range(900).selectExpr("id div 3 as product", "cast(id % 3 as int) as i", "concat('u', id) as url", "cast(0 as int) as batch").coalesce(1)
    log = f"{tmp_path}/sizes"

    def model(part):
        with open(log, "a") as f:
            f.write(f"{len(part)}\n")
        if len(part) <= 3 and part["url"].iloc[0] == "u30" or len(part) > 3 and (part["url"] == "u30").any():
            raise ValueError("refused")
        return hooks.stub_classifier(part)

    want = {(k // 3, k % 3) for k in range(900)} - {(10, 0), (10, 1), (10, 2)}
    assert {(r.product, r.i) for r in hooks.classify(pool, model).collect()} == want
    calls = len(Path(log).read_text().split())
    assert calls >= 300
    plain = sorted(map(tuple, hooks.classify(pool.where("product <> 10"), model).collect()))
    model.rowwise = True
    Path(log).unlink()
    assert sorted(map(tuple, hooks.classify(pool.where("product <> 10"), model).collect())) == plain
    assert len(Path(log).read_text().split()) < 30
    assert {(r.product, r.i) for r in hooks.classify(pool, model).collect()} == want


def test_sourcing_keeps_its_rows_as_parquet(spark):
    """Narrow rows and facts are columns on disk, not checkpoints of whole rows."""
    row = (1, "1.2", 3, "Shop", "desk SG stock", "https://shop.example/product/1/2", 50.0, "1k+", 90, 4.9, "Singapore", False, False)
    df = spark.createDataFrame([row], "ord long, item_id string, shop_id long, shop_name string, name string, url string, price double, sold_text string, reviews long, rating double, location string, is_mock boolean, blocked boolean")
    got = sourcing.judged(df)
    assert got.first().reason is None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ExistingRDD" not in plan


def test_variants_are_grouped_once_a_product(spark):
    """The words that tell a colour are looked for in one place of the plan, before products become rows."""
    models = [("Oak 120 x 60 cm", 10.0, "a"), ("Navy", 12.0, None), ("Oak large", 9.0, "b"), ("Navy two", 3.0, "c"), ("", 5.0, "d")]
    ddl = "product long, url string, title string, ai_title string, ai_description string, cost double, models array<struct<name: string, price: double, image: string>>, images array<string>"
    rows = [(1, "u1", "t", "T", "d", 12.0, models, ["g"]), (2, "u2", "t", "T", "d", 5.0, models[3:], ["g"])]
    got = listings.by_variant(spark.createDataFrame(rows, ddl))
    assert [(r.listing_url, r.ai_title, r.images) for r in got.collect()] == [
        ("u1#Oak%20120%20x%2060%20cm", "T | 120 x 60 cm", ["a", "c"]), ("u1#Navy", "T | Navy", ["c", "a"]), ("u1#Oak%20large", "T | Oak large", ["a", "c"]), ("u1#Navy%20two", "T | Navy two", ["c", "a"]),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [k for k, x in enumerate(plan) if "walnut" in x]
    assert len(at) == 1 and at[0] > next(k for k, x in enumerate(plan) if "Generate" in x)


def test_long_work_is_dealt_into_pieces_of_a_table(spark, tmp_path):
    """Tasks become more as the table grows, not longer; rows stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    for n in (1000, 400_000):
        spark.range(0, n, 1, 1).selectExpr("id", "md5(cast(id as string)) as x").write.parquet(f"{tmp_path}/{n}")
        table = scratch.spread(spark.read.parquet(f"{tmp_path}/{n}"), 1 << 20)
        size = sum(p.stat().st_size for p in Path(f"{tmp_path}/{n}").glob("*.parquet"))
        assert table.count() == n and table.rdd.getNumPartitions() == max(cores, -(-size // (1 << 20)))
    assert size > 8 << 20


def test_swatches_are_dealt_by_the_rows_of_the_table(spark, tmp_path):
    """The tasks that sort become more as the table grows, not larger; each model gets the image that it got."""
    for n in (1000, 1_500_000):
        spark.range(0, n, 1, 1).selectExpr("id div 4 as l_orderkey", "cast(id % 5 + 1 as int) as l_linenumber").write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        out = function_queries.j14_swatches(spark, f"{tmp_path}/{n}")
        plan = out._jdf.queryExecution().executedPlan().toString()
        want = max(spark.sparkContext.defaultParallelism, -(-n // 250_000))
        assert {int(x) for x in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)} == {want}
        image = F.expr("case when n % 2 = 0 then 'own' || n when n % 4 < 3 then 's' || n % 4 end")
        assert out.count() == n and out.where(~image.eqNullSafe(F.col("image"))).isEmpty()
    assert want == 6
