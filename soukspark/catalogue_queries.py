"""The registered queries of the catalogue operators, over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soukspark import config, scratch
from soukspark.config import Flags
from soukspark.functions import arrays, jsons, num, text
from soukspark.functions import html as page
from soukspark.operators import facts, fuzzy, hooks, listings, load, queue, reports, sourcing
from soukspark.plans import adapters
from soukspark.plans.adapters import NOW, plain, view
from soukspark.sources import keyed

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


# -- the sourcing cascade ------------------------------------------------------------------------------------------

PRICED = Flags(min_price=20, max_price=300)
_SOLD = r"""case when starts_with(lower(trim(sold_text)), '<') then 0.0 else coalesce(round(try_cast(regexp_extract(lower(replace(sold_text, ',', '')), '([\d.]+)\s*([km]?)', 1) as double)
 * case regexp_extract(lower(replace(sold_text, ',', '')), '([\d.]+)\s*([km]?)', 2) when 'k' then 1000 when 'm' then 1000000 else 1 end), 0.0) end"""
_ID = r"""case when regexp_matches(url, '-i\.\d+\.\d+') then regexp_extract(url, '-i\.(\d+)\.(\d+)', 1) || '.' || regexp_extract(url, '-i\.(\d+)\.(\d+)', 2)
 when regexp_matches(url, '/product/\d+/\d+') then regexp_extract(url, '/product/(\d+)/(\d+)', 1) || '.' || regexp_extract(url, '/product/(\d+)/(\d+)', 2) else url end"""
_SELL = "cast(ceil(greatest({0} * 1.5, {0} + 25) / 10) * 10 as bigint)"


def _judged(flags: Flags) -> str:
    title = r"\bsg\b|\bhdb\b|\bbto\b|" + "|".join(config.SG_TITLE_PARTS)
    return rf"""items as ({plain(adapters.ITEMS)}),
    a as (select *, split_part(url, '?', 1) u, {_SOLD} sold, regexp_matches(lower(location), '{config.OVERSEAS[0]}') abroad,
      regexp_matches(lower(location), '{config.NEAR[0]}') or regexp_matches(lower(name), '{title}') or regexp_matches(lower(shop_name), '\.sg\b|\bsg\b|singapore') claims from items),
    b as (select *, replace({_ID.replace("url", "u")}, '?', '') pid from a),
    s as (select shop_id, bool_or(not is_mock and not abroad and claims) local_shop,
      bool_or(not is_mock and sold >= {flags.min_sold} and reviews >= {flags.min_reviews} and rating >= {flags.min_rating}) proven from b group by 1),
    c as (select b.*, local_shop, proven, case when price >= 200 then 0 when price >= 100 then 0 else {flags.min_sold} end bs,
      case when price >= 200 then 20 when price >= 100 then 30 else {flags.min_reviews} end br, case when price >= 100 then 4.5 else {flags.min_rating} end bg from b join s using (shop_id)),
    d as (select *, case when rating >= 4.8 then greatest(15, floor(br * 0.8 + 0.5)) when rating >= 4.5 then br else floor(br * 1.5 + 0.5) end need from c),
    e as (select *, case when is_mock then 'mock' when blocked then 'blocked' when abroad or not (claims or local_shop) then 'not-local' when u = '' then 'no-url' end early,
      case when reviews < 1 then 'zero-reviews' when not proven and sold < bs then 'sold' when not proven and reviews < need then 'reviews' when not proven and rating < bg then 'rating' end q from d),
    f as (select *, min(case when early is null and q is null then ord end) over (partition by pid) first from e),
    judged as (select *, coalesce(early, case when ord > first then 'duplicate' end, q, case when price < {flags.min_price} then 'price-min' when price > {flags.max_price} then 'price-max' end) reason,
      early is null and not coalesce(ord > first, false) and q is null good from f)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, adapters.ITEMS)


@query(f"with {_judged(Flags())} select ord, pid product_id, price, sold, reviews, rating, {_SELL.format('price')} sell from judged where reason is null")
def p1_sourcing_kept(spark: SparkSession, d: str) -> DataFrame:
    out = sourcing.judged(_items(spark, d)).where("reason is null").orderBy(F.desc("sold"), F.desc("reviews_n"), "ord")
    return out.select("ord", "product_id", F.col("price_n").alias("price"), "sold", F.col("reviews_n").cast("long").alias("reviews"), F.col("rating_n").alias("rating"), num.sell_price("price_n").alias("sell"))


@query(f"with {_judged(PRICED)} select ord, pid product_id, reason from judged")
def p1_sourcing_kept_up_to_date(spark: SparkSession, d: str) -> DataFrame:
    """Every item's verdict after two exports, the second judged against what was known after the first."""
    items, known = _items(spark, d), facts.Facts(PRICED)
    # numbers are those of orders: half of them come first
    half = items.approxQuantile("ord", [0.5], 0.01)[0]
    known.add(items.where(F.col("ord") <= half))
    known.add(items.where(F.col("ord") > half))
    return known.verdicts.select("ord", "product_id", "reason")


@query(f"with {_judged(PRICED)} select ord, pid product_id, reason from judged where reason is not null")
def o2_sourcing_rejects(spark: SparkSession, d: str) -> DataFrame:
    return sourcing.rejects(sourcing.judged(_items(spark, d), PRICED)).select("ord", "product_id", "reason")


@query(f"with {_judged(PRICED)} select reason, count(*) n, min(ord) first_ord from judged where reason is not null group by 1")
def a3_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.reasons(sourcing.judged(_items(spark, d), PRICED))


_BANDS = ", ".join(f"({k}, {a}::double, {b}::double, {min(b, a * 2 + 50)}::double)" for k, (a, b) in enumerate(config.COST_BANDS))


@query(f"""with {_judged(PRICED)}, bands(band, lo, hi, top) as (values {_BANDS}) select band::int band, count(*) n, lo low, {_SELL.format('lo')} sell_low, {_SELL.format('top')} sell_high,
  lo >= {PRICED.min_price} and hi <= {PRICED.max_price} + 1 in_queue from judged join bands on price >= lo and price < hi where good group by band, lo, hi, top""")
def a4_price_spread(spark: SparkSession, d: str) -> DataFrame:
    return reports.cost_bands(sourcing.judged(_items(spark, d), PRICED), PRICED)


@query(f"""with {_judged(PRICED)} select count(*) filter (price < 20 or price > 300) excluded, count(*) total,
  cast(floor(coalesce(count(*) filter (price < 20 or price > 300) * 100.0 / nullif(count(*), 0), 0) + 0.5) as bigint) percent from judged where good""")
def a7_price_band_excluded(spark: SparkSession, d: str) -> DataFrame:
    return reports.excluded_by_band(sourcing.judged(_items(spark, d), PRICED), 20, 300)


_COPIES = f"""i0 as ({plain(adapters.ITEMS)}), copies as (select pid, sold, reviews, rating, price from (select split_part({_ID}, '?', 1) pid, {_SOLD} sold, reviews, rating, price,
  row_number() over (partition by split_part({_ID}, '?', 1) order by ord) r from i0 where not is_mock and url <> '') where r = 1)"""
_FIT = "count(*) filter (sold >= {} and reviews >= {} and rating >= {} and price between {} and {})"


@query(f"with {_COPIES} " + " union all ".join(f"select '{p[0]}' preset, {_FIT.format(*p[1:])} n from copies" for p in reports.presets(Flags())))
def a8_threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return reports.sensitivity(sourcing.first_copies(_items(spark, d)))


_LOOSE = [("current", 100, 50, 3.8, 0, 1e9), ("sold -> 500", 500, 50, 3.8, 0, 1e9), ("reviews -> 100", 100, 100, 3.8, 0, 1e9), ("rating -> 4.3", 100, 50, 4.3, 0, 1e9), ("price -> any", 100, 50, 3.8, 0, 1e9)]


@query(f"with {_COPIES} " + " union all ".join(f"select '{p[0]}' setting, {_FIT.format(*p[1:])} n, {_FIT.format(*p[1:])} - {_FIT.format(*_LOOSE[0][1:])} delta from copies" for p in _LOOSE))
def a9_threshold_loosened(spark: SparkSession, d: str) -> DataFrame:
    return reports.loosened(sourcing.first_copies(_items(spark, d)))


@query(f"with {_COPIES} select pid product_id, sold, reviews::double reviews, rating, price from copies")
def ad2_first_copy_of_each(spark: SparkSession, d: str) -> DataFrame:
    return sourcing.first_copies(_items(spark, d))


# -- a shop's catalogue --------------------------------------------------------------------------------------------

_SHOP = f"shop as (select ord, name, price, {_SOLD} sold, reviews from ({plain(adapters.ITEMS)}))"
_WIN = "(sold >= 1000 and reviews >= 200)"
_MED = "coalesce(list_sort({0})[(len({0}) // 2 + 1)::int], 0.0)"


def _shop(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("ord", "name", "price", num.sold_to_number("sold_text").alias("sold"), "reviews")


_SHOP_BANDS = ", ".join(f"({k}, {a}::double, {b}::double, '{c}')" for k, (a, b, c) in enumerate(config.SHOP_BANDS))


@query(f"""with {_SHOP}, bands(k, lo, hi, label) as (values {_SHOP_BANDS}) select k::int k, label, count(ord) n_all, count(*) filter (ord is not null and {_WIN}) n_winners
  from bands left join shop on price >= lo and price < hi group by 1, 2""")
def a5_shop_band_tally(spark: SparkSession, d: str) -> DataFrame:
    return reports.band_tally(_shop(spark, d))


@query(f"""with {_SHOP}, m as (select *, {_WIN} win, {_SELL.format('price')} / greatest(price, 0.01) mult from shop),
  g as (select count(*) n, count(*) filter (win) n_win, list(price) lp, list(price) filter (win) lw, list(mult) filter (win) lm, count(*) filter (win and mult > 3) over_3x,
    count(*) filter (win and price between 15 and 300) sweet, count(*) filter (price < 15) ca, count(*) filter (win and price < 15) cw from m)
  select n, n_win, {_MED.format('lp')} median_all, {_MED.format('lw')} median_win, {_MED.format('lm')} median_markup, over_3x, sweet,
    cast(floor(ca * 100.0::double / greatest(n, 1) + 0.5) as bigint) cheap_pct, cast(floor(cw * 100.0::double / greatest(n_win, 1) + 0.5) as bigint) cheap_pct_win from g""")
def a10_shop_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.shop_summary(_shop(spark, d))


def _top(n: int, extra: str = "") -> str:
    return f"with {_SHOP} select ord, name, price, sold, {_SELL.format('price')} sell, {_SELL.format('price')} / greatest(price, 0.01) markup from shop where {_WIN} {extra} order by sold desc, ord limit {n}"


@query(_top(20))
def o3_shop_top_sold(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_sold(_shop(spark, d))


@query(_top(12, "and price between 15 and 300"))
def p9_shop_sweet_spot(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_sold(_shop(spark, d), 12, True)


@query(f"""with {_SHOP}, g as (select count(*) n, min(price) least, list(price) l from shop) select n, least, {_MED.format('l')} median,
  greatest(greatest(least - 1, 0.0), ceil(greatest(60.0 * 1.5, 60.0 + 24) / 5) * 5)::double undercut from g""")
def a17_competitor_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.competitor_stats(_shop(spark, d), 60.0)


# -- loading -------------------------------------------------------------------------------------------------------

_RANKED = f"""rk as (select listing_url, arg_max(try_cast(times_listed as int), ord) ranked_times, arg_max(try_cast(price as double), ord) filter (ord is not null) rp0 from ({plain(adapters.RANKED)}) group by 1),
  rlast as (select listing_url, try_cast(times_listed as int) ranked_times, round(try_cast(price as double), 2) ranked_price from (select *, row_number() over (partition by listing_url order by ord desc) r from ({plain(adapters.RANKED)})) where r = 1)"""
_IMAGES = "array_to_string(list_filter([trim(cover_image), trim(image_2), trim(image_3)] || string_split(replace(coalesce(extra_images, ''), ' ', ''), ','), lambda x: x is not null and x <> ''), ',')"


def _load_sql(only: bool) -> str:
    price = "coalesce(ranked_price, round(try_cast(price as double), 2))" if only else "round(try_cast(price as double), 2)"
    return f"""with {_RANKED}, cat as ({plain(adapters.CATALOG)}) select ord, listing_url, title, {price} price, {_IMAGES} images, coalesce(ranked_times, 1) times_listed
      from cat {'' if only else 'left'} join rlast using (listing_url) where trim(title) <> '' and trim(listing_url) <> ''"""


def _load(spark: SparkSession, d: str, only: bool) -> DataFrame:
    return load.built(view(spark, d, adapters.CATALOG), view(spark, d, adapters.RANKED), only)


@query(_load_sql(False))
def j1_load_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return load.ordered(_load(spark, d, False)).withColumn("images", F.array_join("images", ","))


@query(_load_sql(True))
def j7_load_ranked_only(spark: SparkSession, d: str) -> DataFrame:
    return load.ordered(_load(spark, d, True)).withColumn("images", F.array_join("images", ","))


@query(f"with x as ({_load_sql(False)}) select * from x order by times_listed desc, ord limit 50")
def o4_load_top(spark: SparkSession, d: str) -> DataFrame:
    return load.ordered(_load(spark, d, False), 50).withColumn("images", F.array_join("images", ","))


@query(f"""with x as ({_load_sql(False)}) select (select count(*) from x) total, (select count(*) from ({plain(adapters.CATALOG)}) where trim(title) = '' or trim(listing_url) = '') skipped,
  (select count(*) from x where times_listed > 1) covered, (select count(*) from x where images = '') without_images""")
def a13_load_summary(spark: SparkSession, d: str) -> DataFrame:
    return load.summary(view(spark, d, adapters.CATALOG), _load(spark, d, False))


@query(f"""with cat as ({plain(adapters.CATALOG)}), t as (select listing_url from ({plain(adapters.RANKED)})), f as (select *, row_number() over (partition by listing_url order by ord) r from cat)
  select ord, listing_url, title from f where r = 1 and not exists (select 1 from t where t.listing_url = f.listing_url)""")
def k3_load_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return load.insert_ignore(view(spark, d, adapters.RANKED), view(spark, d, adapters.CATALOG), ["listing_url"]).select("ord", "listing_url", "title")


_REPRICED = f"""{_RANKED}, q as (select id, listing_url, price have, row_number() over (partition by listing_url order by id) r from ({plain(adapters.QUEUE)})),
  ch as (select id, have, ranked_price want from q join rlast using (listing_url) where r = 1 and abs(have - ranked_price) >= 0.01)"""


@query(f"with {_REPRICED} select * from ch")
def j8_reprice(spark: SparkSession, d: str) -> DataFrame:
    return load.repriced(view(spark, d, adapters.QUEUE), view(spark, d, adapters.RANKED))


@query(f"with {_REPRICED} select * from ch order by abs(want - have) desc, id limit 6")
def o10_reprice_largest(spark: SparkSession, d: str) -> DataFrame:
    return load.largest_changes(load.repriced(view(spark, d, adapters.QUEUE), view(spark, d, adapters.RANKED)))


@query(f"with {_REPRICED} select q0.id, coalesce(want, q0.price) price from ({plain(adapters.QUEUE)}) q0 left join ch using (id)")
def k4_reprice_applied(spark: SparkSession, d: str) -> DataFrame:
    q = view(spark, d, adapters.QUEUE)
    return load.update_prices(q, load.repriced(q, view(spark, d, adapters.RANKED))).select("id", "price")


# -- the work queue ------------------------------------------------------------------------------------------------

_Q, _W = f"q as ({plain(adapters.QUEUE)})", f"w as ({plain(adapters.STAFF)})"
_TS = f"timestamp '{NOW}'"
_FREE = f"(state = 'pending' or state = 'claimed' and held_since < {_TS} - interval '4' hour)"
WORKER = "w8"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, adapters.QUEUE)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("id", "state", "holder", stamp("held_since"), "attempts", "refusal", stamp("done_at"), *more)


_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query(f"""with {_Q}, {_W}, best as (select id from q where account = (select own_account from w where id = '{WORKER}') and {_FREE} order by times_listed desc, id limit 20)
  select q.id, case when b.id is null then state else 'claimed' end state, case when b.id is null then holder else '{WORKER}' end holder,
    {_STAMP.format(f'case when b.id is null then held_since else {_TS} end')} held_since, attempts + (b.id is not null)::int attempts, refusal, {_STAMP.format('done_at')} done_at, b.id is not null taken from q left join best b on q.id = b.id""")
def t2_queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return _shown(queue.claim(_q(spark, d), view(spark, d, adapters.STAFF), WORKER, 20, NOW), "taken")


def _table_in_place(spark: SparkSession, d: str) -> keyed.KeyedTable:
    table = keyed.KeyedTable(spark, scratch.folder(spark, "queue"), buckets=8)
    table.create(_q(spark, d))
    return table


@query(_SQL["t2_queue_claim"])
def t2_queue_claim_in_place(spark: SparkSession, d: str) -> DataFrame:
    table = _table_in_place(spark, d)
    taken = keyed.claim(table, view(spark, d, adapters.STAFF), WORKER, 20, NOW).select("id", F.lit(True).alias("_t"))
    return _shown(table.rows().join(taken, "id", "left").withColumn("taken", F.coalesce("_t", F.lit(False))), "taken")


@query(_SQL["k4_reprice_applied"])
def k4_reprice_in_place(spark: SparkSession, d: str) -> DataFrame:
    table = _table_in_place(spark, d)
    keyed.reprice(table, view(spark, d, adapters.RANKED))
    return table.rows().select("id", "price")


@query(f"with {_Q} select id, account, r::int \"rank\" from (select *, row_number() over (partition by account order by times_listed desc, id) r from q where {_FREE}) where r <= 10")
def w4_queue_claim_each_account(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_all(_q(spark, d), 10, NOW).select("id", "account", "rank")


def _held_by(spark: SparkSession, d: str) -> tuple[DataFrame, str, DataFrame]:
    """The queue as one worker sees it who holds every claimed row, and the rows handed out to it most often."""
    q = _q(spark, d)
    held = q.withColumn("holder", F.when(F.col("state") == "claimed", WORKER).otherwise(F.col("holder")))
    return held, WORKER, q.where("attempts = 5").select("id")


_H = f"h as (select * exclude (holder), case when state = 'claimed' then '{WORKER}' else holder end holder from q)"
_HIT = f"(attempts = 5 and state = 'claimed' and holder = '{WORKER}')"


@query(f"""with {_Q}, {_H} select id, case when {_HIT} then 'done' else state end state, holder, {_STAMP.format('held_since')} held_since, attempts, refusal,
  {_STAMP.format(f'case when {_HIT} then {_TS} else done_at end')} done_at, case when {_HIT} then 'https://m.example/p/1' else done_url end done_url, coalesce({_HIT}, false) changed from h""")
def t3_queue_complete(spark: SparkSession, d: str) -> DataFrame:
    return _shown(queue.complete(*_held_by(spark, d), NOW, "https://m.example/p/1"), "done_url", "changed")


@query(f"""with {_Q}, {_H}, mine as (select distinct listing_url from h where {_HIT}), m as (select *, coalesce({_HIT}, false) changed, state = 'pending' and listing_url in (select * from mine) other from h)
  select id, case when changed or other then 'rejected' else state end state, holder, {_STAMP.format('held_since')} held_since, attempts,
  case when changed then 'no margin' when other then 'no margin [via another account]' else refusal end refusal, {_STAMP.format(f'case when changed or other then {_TS} else done_at end')} done_at, changed from m""")
def t4_queue_reject(spark: SparkSession, d: str) -> DataFrame:
    return _shown(queue.reject(*_held_by(spark, d), NOW, "no margin"), "changed")


@query(f"""with {_Q}, m as (select *, coalesce(holder = '{WORKER}' and state = 'claimed', false) changed from q) select id, case when changed then 'pending' else state end state,
  case when not changed then holder end holder, {_STAMP.format('case when not changed then held_since end')} held_since, attempts, refusal, {_STAMP.format('done_at')} done_at, changed from m""")
def t5_queue_release(spark: SparkSession, d: str) -> DataFrame:
    return _shown(queue.release(_q(spark, d), WORKER), "changed")


@query(f"""with {_Q} select listing_url, title, times_listed, 'acct1' account, 'pending' state, 0::int attempts from q where account = 'acct0' and state <> 'rejected'
  and not exists (select 1 from q t where t.account = 'acct1' and t.listing_url = q.listing_url and t.state = 'done')""")
def t6_queue_clone(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d).where("account <> 'acct1' or state = 'done'")
    return queue.clone(q, "acct1", "acct0").select("listing_url", "title", "times_listed", "account", "state", "attempts")


_COUNTS = "count(*) total, " + ", ".join(f"count(*) filter (state = '{s}') {s}" for s in ("pending", "claimed", "done", "rejected"))


@query(f"with {_Q} select {_COUNTS}, count(*) filter (state = 'claimed' and held_since < {_TS} - interval '4' hour) lease_expired, count(*) filter (attempts > 3 and state <> 'done') repeatedly_reclaimed from q")
def a1_queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return queue.stats(_q(spark, d), NOW)


@query(f"with {_Q} select account, {_COUNTS} from q group by 1")
def a2_queue_by_account(spark: SparkSession, d: str) -> DataFrame:
    return queue.stats(_q(spark, d), NOW, True)


@query(f"with {_Q}, {_W}, n as (select account, count(*) n from q where state = 'pending' group by 1) select id worker_id, coalesce(n, 0) depth from w left join n on account = own_account")
def a12_queue_depth(spark: SparkSession, d: str) -> DataFrame:
    return queue.depth(_q(spark, d), view(spark, d, adapters.STAFF))


@query(f"with x as ({plain(adapters.DONE)}) select worker_id, count(*) count_today from x where day = date '2024-01-10' group by 1")
def a11_done_today(spark: SparkSession, d: str) -> DataFrame:
    return queue.done_today(view(spark, d, adapters.DONE), "2024-01-10")


@query(f"with x as ({plain(adapters.DONE)}) select worker_id, strftime(day, '%Y-%m-%d') as day, count(*) n from x group by 1, 2")
def t14_daily_progress(spark: SparkSession, d: str) -> DataFrame:
    done = view(spark, d, adapters.DONE).withColumn("day", queue.local_day("done_at"))
    return queue.daily(done).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""with {_W}, r as (select 'w' || user_id worker_id, user_id % 2 = 0 mode from (select distinct user_id from events) union all select 'nobody', false)
  select worker_id, case when w.id is null then 404 when not active then 403 else 200 end status, coalesce(mode, false) or coalesce(w.by_queue, false) by_queue from r left join w on worker_id = w.id""")
def p10_worker_gate(spark: SparkSession, d: str) -> DataFrame:
    ids = view(spark, d, "select distinct user_id from {events}").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"), (F.col("user_id") % 2 == 0).alias("mode"))
    return queue.gate(ids.unionAll(spark.createDataFrame([("nobody", False)], "worker_id string, mode boolean")), view(spark, d, adapters.STAFF))


@query("select event_id id from events where not (event_type = 'view' and ts < timestamp '2024-02-05 00:00:00' - interval '30' day)")
def t7_inbox_retained(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select event_id as id, event_type = 'view' as consumed, ts as created_at from {events}")
    return queue.retained(rows, "2024-02-05 00:00:00").select("id")


# -- listings ------------------------------------------------------------------------------------------------------

_M = f"m as ({plain(adapters.MODELS)})"
_COLOUR = lambda n: f"case when regexp_extract(lower({n}), '\\b({'|'.join(config.COLOUR_WORDS)})\\b', 1) <> '' then regexp_extract(lower({n}), '\\b({'|'.join(config.COLOUR_WORDS)})\\b', 1) else 'x:' || lower(trim({n})) end"


def _models(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, adapters.MODELS)


def _products(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("pos", "name", "price", "image")
    rows = _models(spark, d).groupBy("product").agg(F.array_sort(F.collect_list(one)).alias("ms"))  # lines of an order
    return rows.select(
        "product", F.concat(F.lit("https://shop.example/product/1/"), F.col("product").cast("string")).alias("url"), F.concat(F.lit("Thing "), F.col("product").cast("string")).alias("title"),
        F.concat(F.lit("Thing "), F.col("product").cast("string"), F.lit(" | Solid | Easy | Big")).alias("ai_title"), F.lit("One\n📦 Sizes available: all\nTwo").alias("ai_description"),
        F.transform("ms", lambda m: F.struct(m["name"].alias("name"), m["price"].alias("price"), m["image"].alias("image"))).alias("models"), F.array(F.lit("g1"), F.lit("g2"), F.lit("g3")).alias("images"), F.array(F.lit("r1"), F.lit("g1"), F.lit("r2"), F.lit("r3")).alias("review_images"),
    ).withColumn("cost", arrays.max_cost(F.lit(None).cast("double"), F.lit(None).cast("double"), "models"))


_MANY = f"{_M}, n as (select product, count(*) filter (price > 0) n from m group by 1)"


@query(f"""with {_MANY}, v as (select m.*, row_number() over (partition by product order by pos, name, price, image) - 1 k, {_COLOUR('trim(name)')} colour from m join n using (product) where n >= 2 and price > 0),
  f as (select product, colour, arg_min(image, k) filter (image is not null) own, min(k) filter (image is not null) fk from v group by 1, 2),
  g0 as (select product, own, min(fk) fk from f where own is not null group by 1, 2), p as (select product, list(own order by fk) pal from g0 group by 1)
  select product, 'https://shop.example/product/1/' || product || '#' || replace(name, ' ', '%20') listing_url, 'Thing ' || product || ' | Solid | Easy | Big | ' ||
    case when regexp_matches(name, '\\d+\\s*[x]\\s*\\d+') then regexp_extract(name, '\\d+\\s*[x]\\s*\\d+\\s*(cm)?') else name end ai_title, 'One' || chr(10) || 'Two' ai_description, price source_cost, {_SELL.format('price')} sell_price,
    case when own is null then 'g1,g2' else array_to_string(list_filter([own, list_filter(list_transform(range(1, len(pal) + 1), lambda s: pal[((k + s) % len(pal))::int + 1]), lambda x: x <> own)[1]], lambda x: x is not null), ',') end images
  from v left join f using (product, colour) left join p using (product)""")
def l3_listings_by_variant(spark: SparkSession, d: str) -> DataFrame:
    return listings.by_variant(_products(spark, d)).withColumn("images", F.array_join("images", ",")).drop("title")


@query(f"""with {_MANY}, c as (select product, max(price) cost from m group by 1) select product, 'https://shop.example/product/1/' || product listing_url, case when cost > 0 then cost end source_cost,
  case when cost > 0 then {_SELL.format('cost')} end sell_price, 'g1,r1,r2,g2,g3' images from n join c using (product) where n < 2""")
def l4_listings_single(spark: SparkSession, d: str) -> DataFrame:
    return listings.single(_products(spark, d)).select("product", "listing_url", "source_cost", "sell_price", F.array_join("images", ",").alias("images"))


@query(f"with {_M} select product, count(*) n_variants, count(distinct {_COLOUR('name')}) n_colours from m group by 1")
def a20_variant_colours(spark: SparkSession, d: str) -> DataFrame:
    return listings.colours(_models(spark, d))




@query(f"""with x as (select l_orderkey o, l_linenumber n, min(l_partkey) k from lineitem group by 1, 2), y as (select o, n, k, ['B', 'C', 'D'] t from x)
  select o product, n, ({list(config.TITLE_TAGS)!r})[(k % 10)::int + 1] || ' Item ' || o || ' | ' || array_to_string(t[(k % 3)::int + 1:] || t[:(k % 3)::int], ' | ') title from y""")
def fs10_titles_rotated(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select l_orderkey as product, l_linenumber as n, min(l_partkey) as k from {lineitem} group by 1, 2")
    title = F.concat(F.lit("Item "), F.col("product").cast("string"), F.lit(" | B | C | D"))
    return rows.select("product", "n", text.rotate_title(title, F.col("k").cast("int")).alias("title"))


@query(f"""with i as ({plain(adapters.ITEMS)}) select ord, case when url like '%/product/%' then split_part(url, '?', 1) else 'https://shop.example/product/1/' || regexp_extract(url, '-i\\.1\\.(\\d+)', 1) end listing_url,
  regexp_extract(url, '(\\d+)(\\?.*)?$', 1) item from i""")
def fs4_urls_canonical(spark: SparkSession, d: str) -> DataFrame:
    item = F.substring_index(text.loose_product_id("url"), ".", -1)
    return _items(spark, d).select("ord", text.canonical_url("url", "https://shop.example").alias("listing_url"), item.alias("item"))


@query("""with x as (select l_orderkey o, l_linenumber n, l_partkey p, l_suppkey s, l_partkey % 33 a, l_partkey % 33 + l_suppkey % 5 - 1 b from lineitem) select o, n, p, s,
  case when a >= 1 and b >= a and b <= 30 then '🚚 Free Doorstep Delivery | ' || case when a = b then (b + 1)::varchar else (a + 1) || '-' || (b + 1) end || ' Working Days' else '🚚 Free Doorstep Delivery' end delivery from x""")
def fs13_delivery_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "select l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s from {lineitem}")
    low = F.col("p") % 33
    return rows.withColumn("delivery", text.delivery_line(low, low + F.col("s") % 5 - 1))


@query(f"""with {_W}, s as (select id, 'https://shop.example/product/1/' || substr(id, 2) || '#c0' url from w), b as (select id, split_part(url, '#', 1) base, unnest(range(12)) slot from s),
  f as (select *, row_number() over (partition by id order by slot) r from b where not (substr(id, 2)::int % 5 = slot)) select id, slot::int slot, (slot % 4)::int backdrop, (slot // 4 % 3)::int angle from f where r <= 6""")
def j13_backdrop_slots(spark: SparkSession, d: str) -> DataFrame:
    w = view(spark, d, adapters.STAFF).select("id", F.substring(F.col("id"), F.lit(2), F.length("id")).cast("int").alias("n"))
    base = F.concat(F.lit("https://shop.example/product/1/"), F.col("n").cast("string"))
    taken = w.select(F.concat(base, F.lit("#v"), F.col("id"), F.lit("-"), (F.col("n") % 5).cast("string")).alias("listing_url"), F.lit("active").alias("status"))
    return listings.free_slots(w.select("id", F.concat(base, F.lit("#c0")).alias("url")), taken, 4, 3, 6)


@query(f"""with {_M}, x as (select product, (pos % 100000)::int i, ('0x' || substr(md5(image), 1, 8))::bigint h from m where image is not null)
  select product, i, case h % 3 when 0 then 'cover' when 1 then 'dimension' else 'skip' end as role, h // 3 % 4 = 0 needs_clean from x""")
def x5_classified_images(spark: SparkSession, d: str) -> DataFrame:
    pool = _models(spark, d).where("image is not null").select("product", (F.col("pos") % 100_000).cast("int").alias("i"), F.col("image").alias("url"))
    return hooks.classify(listings.batches(pool), hooks.stub_classifier)


@query("""with x as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) title, url from pages) select page_id, title, split_part(split_part(url, '?', 1), '#', 1) base from x""")
def s10_page_titles(spark: SparkSession, d: str) -> DataFrame:
    pages = view(spark, d, "select * from {pages}")
    return pages.select("page_id", page.title("html").alias("title"), text.before(text.before("url", "?"), "#").alias("base"))


@query("select event_id, cast(json_extract_string(props, '$.k') as double) k from events")
def fj5_event_props(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "select * from {events}").select("event_id", jsons.first_path("props", "$.missing", "$.k").try_cast("double").alias("k"))


# -- near duplicates -----------------------------------------------------------------------------------------------

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i::int, 3)))))"
_PAIRS = f"""t as (select *, {_GRAMS.format('title')} g from ({plain(adapters.TITLES)}) where cost > 0), pr as (select a.id probe_id, b.id,
  coalesce(len(list_intersect(a.g, b.g))::double / nullif(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 0), 0) score from t a join t b on b.cost between a.cost * 0.9 and a.cost * 1.1),
  found as (select * from pr where score >= 0.6)"""


@query(f"""with {_PAIRS}, o as (select probe_id, count(*) n, round(max(score), 6) top from found where probe_id <> id group by 1)
  select x.id, min(y.id) class_id, coalesce(any_value(n), 0) n_links, any_value(top) top from ({plain(adapters.TITLES)}) x
  left join t tx on x.id = tx.id and len(tx.g) > 0 left join t y on tx.cost = y.cost and list_sort(tx.g) = list_sort(y.g) left join o on x.id = probe_id group by 1""")
def j6_fuzzy_links(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.links(view(spark, d, adapters.TITLES)).select("id", "class_id", "n_links", F.round("best_score", 6).alias("top"))


@query(f"with {_PAIRS} select probe_id, id, round(score, 6) score from (select *, row_number() over (partition by probe_id order by score desc, id) r from found where probe_id <> id) where r = 1")
def o9_fuzzy_best(spark: SparkSession, d: str) -> DataFrame:
    rows = fuzzy.links(view(spark, d, adapters.TITLES)).where("n_links > 0")
    return rows.select(F.col("id").alias("probe_id"), F.col("best_id").alias("id"), F.round("best_score", 6).alias("score"))


@query(f"""with {_Q}, l as (select id, listing_url, case when state = 'claimed' then 'active' when state = 'rejected' then 'deleted' else state end status from q),
  x as (select listing_url, arg_min(id, id) id, arg_min(status, id) status from l where status <> 'deleted' group by 1), c as (select distinct listing_url from q)
  select listing_url, x.id existing_id, case when x.id is null then 'new' when x.status = 'active' then 'refresh' else 'block' end action from c left join x using (listing_url)""")
def j5_existing_listings(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    status = F.when(F.col("state") == "claimed", "active").when(F.col("state") == "rejected", "deleted").otherwise(F.col("state"))
    return fuzzy.existing(q.select("listing_url").distinct(), q.withColumn("status", status))


# -- sales ---------------------------------------------------------------------------------------------------------

@query("""with s as (select e.event_id, e.user_id % 20 listing_id, round(e.value * 100) cents from events e where event_type = 'purchase')
  select case when listing_id < 15 then 'w' || listing_id % 4 end worker_id, count(*) sold, cast(sum(cents) as bigint) revenue from s group by 1""")
def j17_worker_attribution(spark: SparkSession, d: str) -> DataFrame:
    sales = view(spark, d, "select user_id % 20 as listing_id, cast(round(value * 100) as bigint) as price from {events} where event_type = 'purchase'")
    own = spark.range(15).select(F.col("id"), F.concat(F.lit("w"), (F.col("id") % 4).cast("string")).alias("assigned_worker_id"))
    return reports.attribution(sales, own)


@query("""with s as (select strftime(cast(ts + interval '8' hour as date), '%Y-%m-%d') as day, 'c' || user_id % 3 category, cast(round(value * 100) as bigint) p from events where event_type = 'purchase')
  select day, category, cast(sum(p) as bigint) revenue, cast(sum(p - 5) as bigint) profit from s group by 1, 2""")
def a22_revenue_by_day(spark: SparkSession, d: str) -> DataFrame:
    sales = view(spark, d, "select ts, concat('c', cast(user_id % 3 as string)) as category, cast(round(value * 100) as bigint) as price, 5L as source_cost from {events} where event_type = 'purchase'")
    return reports.revenue(sales.withColumn("day", F.date_format(queue.local_day("ts"), "yyyy-MM-dd")))


@query(f"""with {_SHOP}, g as (select name template, count(*) times_listed, list(price) l from shop group by 1) select template, times_listed, {_MED.format('l')} price from g""")
def a23_template_medians(spark: SparkSession, d: str) -> DataFrame:
    return reports.template_medians(_shop(spark, d).withColumnRenamed("name", "template"))


# -- single functions ----------------------------------------------------------------------------------------------


@query(f"""with i as ({plain(adapters.ITEMS)}) select ord, {_SOLD} sold, {_SELL.format('price')} sell, cast(ceil(greatest(price * 1.5, price + 24) / 5) * 5 as bigint) floor_price,
  {_SELL.format('price')} / greatest(price, 0.01) markup, repeat('#', greatest(0, floor(reviews / 400.0::double * 30 + 0.5))::int) bar from i""")
def fn1_fn9_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    return rows.select("ord", num.sold_to_number("sold_text").alias("sold"), num.sell_price("price").alias("sell"), num.margin_floor("price").alias("floor_price"), num.markup("price").alias("markup"), num.text_bar("reviews", F.lit(400), 30).alias("bar"))


@query(rf"""with {_judged(Flags())} select ord, abroad, claims, local_shop, proven, bs::int bar_sold, br::int bar_reviews, bg::double bar_rating, need::bigint needed from d""")
def p2_p6_bars_and_places(spark: SparkSession, d: str) -> DataFrame:
    rows = sourcing.prepared(_items(spark, d), Flags()).withColumn("bar", sourcing.bar(Flags()))
    rows = rows.join(sourcing.shop_facts(rows, Flags()), F.col("shop_id") == F.col("_shop"))
    return rows.select("ord", "abroad", "claims", "local_shop", F.col("proven_shop").alias("proven"), F.col("bar.sold").alias("bar_sold"), F.col("bar.reviews").alias("bar_reviews"), F.col("bar.rating").alias("bar_rating"), sourcing.reviews_needed(F.col("rating_n"), F.col("bar.reviews")).cast("long").alias("needed"))


@query(f"""with {_M} select product, pos, case when regexp_matches(name, '\\d+ x \\d+') then regexp_extract(name, '\\d+ x \\d+ cm') else name end as label, {_COLOUR('name')} colour from m""")
def fs8_fs9_labels(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("product", "pos", text.variant_label("name").alias("label"), text.colour_key("name").alias("colour"))


@query(f"""with {_M} select product, max(price) cost, cast(ceil(greatest(max(price) * 1.5, max(price) + 25) / 10) * 10 as bigint) sell, min(price) least from m group by 1""")
def a15_a16_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = _products(spark, d)
    return rows.select("product", "cost", num.sell_price("cost").alias("sell"), F.array_min(F.transform("models", lambda m: m["price"])).alias("least"))


_BANNED = " or ".join(f"contains(lower(t), '{w}')" for w in config.BANNED_TITLE_WORDS)


@query(f"""with x as (select doc_id, list_transform(string_split(text, '. '), lambda s: trim(s)) s from documents), y as (select doc_id, array_to_string(s, ' | ') t from x),
  z as (select doc_id, t, list_filter(list_transform(string_split(t, '|'), lambda s: trim(s)), lambda s: s <> '') g from y)
  select doc_id, len(g)::int segs, length(t)::int chars, regexp_matches(t, '(?i)\\d+\\s*(cm|mm|x\\s*\\d+)') has_dim, concat_ws(',', case when len(g) < 8 then 'few-segments' end, case when len(g) > 10 then 'many-segments' end,
    case when length(t) > 225 then 'long' end, case when len(g) > len(list_distinct(list_transform(g, lambda s: lower(s)))) then 'repeats' end, case when {_BANNED} then 'banned-word' end,
    case when regexp_matches(t, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]') then 'emoji' end, case when regexp_matches(t, '[!@#$%*&]') then 'symbol' end) issues from z""")
def fs26_title_lint(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "select doc_id, text from {documents}")
    title = F.array_join(F.transform(F.split("text", r"\. "), lambda s: F.trim(s)), " | ")
    out = docs.select("doc_id", title.alias("t")).select("doc_id", text.title_issues("t").alias("x"))
    return out.select("doc_id", "x.segs", "x.chars", "x.has_dim", F.array_join("x.issues", ",").alias("issues"))


@query(f"""with {_M}, s as (select product, 'src' || (product % 11) src from m group by 1), a as (select product, pos % 100000 i, case when pos % 3 = 0 then 'skip' else 'cover' end as role, pos % 4 = 0 needs_clean, image url from m),
  c as (select product, url, bool_or(needs_clean) needs_clean, min(i) ord from a where role = 'cover' and url is not null group by 1, 2)
  select product, url, needs_clean, ord::int ord, case when needs_clean then case when ord % 2 = 0 then url || '-clean' end else url end cover from c where not needs_clean or ord % 2 = 0""")
def a18_p25_covers(spark: SparkSession, d: str) -> DataFrame:
    answers = _models(spark, d).select("product", (F.col("pos") % 100_000).cast("int").alias("i"), F.when(F.col("pos") % 3 == 0, "skip").otherwise("cover").alias("role"), (F.col("pos") % 4 == 0).alias("needs_clean"), F.col("image").alias("url"))
    covers = listings.cover_map(answers)
    cleaned = covers.where("needs_clean").select("product", "url", F.when(F.col("ord") % 2 == 0, F.concat("url", F.lit("-clean"))).alias("cleaned_url"))
    return listings.clean_gate(covers, cleaned).select("product", "url", "needs_clean", "ord", "cover")


@query(f"""with i as ({plain(adapters.ITEMS)}) select ord, split_part(url, '?', 1) base, {_ID.replace("else url", "else split_part(url, '?', 1)")} pid from i""")
def fs1_fs2_product_ids(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("ord", text.before("url", "?").alias("base"), text.product_id("url").alias("pid"))


@query(f"""with {_M}, p as (select product, max(price) cost, ['g1', 'g2'] g from m group by 1), k as (select *, unnest(range(3)) k from p)
  select product, 'u#c' || k listing_url, ({list(config.TITLE_TAGS)!r})[(k % 10)::int + 1] || ' T | ' || case k % 2 when 0 then 'x | y' else 'y | x' end ai_title, cost source_cost, {_SELL.format('cost')} sell_price,
  array_to_string(['c' || k] || ['r1', 'r2'] || ['dim'], ',') images from k""")
def l2_listings_by_cover(spark: SparkSession, d: str) -> DataFrame:
    products = _products(spark, d).select("product", F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("T | x | y").alias("ai_title"), F.lit("d").alias("ai_description"), "cost", F.array(F.lit("r1"), F.lit("r2"), F.lit("r3")).alias("review_images"))
    covers = products.select("product", F.explode(F.array(*[F.struct(F.lit(f"c{k}").alias("cover"), F.lit(k * 5).alias("ord")) for k in range(3)])).alias("x")).select("product", "x.*")
    out = listings.by_cover(products, covers, products.select("product", F.lit("dim").alias("dims_url")))
    return out.select("product", "listing_url", "ai_title", "source_cost", "sell_price", F.array_join("images", ",").alias("images"))


@query("""select event_id, strftime(cast(ts + interval '8' hour as date), '%Y-%m-%d') as day from events""")
def fd1_local_days(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "select * from {events}").select("event_id", F.date_format(queue.local_day("ts"), "yyyy-MM-dd").alias("day"))


@query(f"""with {_M}, x as (select product, (pos % 100000)::int i, count(*) over (partition by product) n from m) select product, i, (i % greatest(ceil(n / 2.0)::int, 1))::int batch from x""")
def w6_batches(spark: SparkSession, d: str) -> DataFrame:
    pool = _models(spark, d).select("product", (F.col("pos") % 100_000).cast("int").alias("i"))
    return listings.batches(pool, 2)


@query(f"""with {_Q}, l as (select id, state, listing_url, 'w' || (id % 5) worker, case when state = 'claimed' then 'active' else state end status from q), r as (select id, 'w' || (id % 4) w, id % 6 = 0 skip from q where id % 2 = 0)
  select l.id, case when r.id is null then null when worker <> w then '403' when status <> 'active' then '409' when skip then 'deleted' else '200' end outcome,
    case when r.id is not null and worker = w and status = 'active' and not skip then 'done' else status end status from l left join r on l.id = r.id""")
def t8_finished_listings(spark: SparkSession, d: str) -> DataFrame:
    who = lambda n: F.concat(F.lit("w"), (F.col("id") % n).cast("string"))
    q = _q(spark, d)
    rows = q.select("id", F.when(F.col("state") == "claimed", "active").otherwise(F.col("state")).alias("status"), who(5).alias("assigned_worker_id"), F.lit(None).cast("string").alias("sold_url"))
    asked = q.where("id % 2 = 0").select(F.col("id").alias("listing_id"), who(4).alias("worker_id"), (F.col("id") % 6 == 0).alias("skip"), F.lit("x").alias("url"))
    return queue.finish_listings(rows, asked).select("id", "outcome", "status")
