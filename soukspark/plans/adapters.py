"""Marketplace-shaped views over the benchmark tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soukspark.scratch import spread

NOW = "2024-06-01 12:00:00"

ITEMS = """
select ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber as ord,
  cast(l_partkey * 10 + l_linenumber as string) as item_id,
  cast(l_orderkey * 10 + l_linenumber % 3 as bigint) as shop_id,
  concat('Shop ', cast(l_suppkey as string)) as shop_name,
  case when l_linenumber = 7 then concat(p_name, ' SG stock') else p_name end as name,
  case when l_partkey % 2 = 0 then concat('https://shop.example/product/1/', cast(l_partkey * 10 + l_linenumber as string), '?p=1')
       else concat('https://shop.example/thing-i.1.', cast(l_partkey * 10 + l_linenumber as string)) end as url,
  cast(floor(l_extendedprice / 3 + 0.5) / 100 as double) as price,
  case when l_quantity < 10 then '<100' when l_quantity < 20 then '100+' when l_quantity < 30 then '500+' when l_quantity < 45 then '1k+' else '10k+' end as sold_text,
  cast(l_quantity * l_linenumber - 3 as bigint) as reviews,
  cast(floor(l_tax * 1800 + 350.5) / 100 as double) as rating,
  case l_suppkey % 5 when 0 then 'Singapore' when 1 then '' when 2 then 'Malaysia' when 3 then 'Mainland China' else 'Thailand' end as location,
  l_orderkey % 97 = 0 as is_mock,
  l_partkey % 131 = 0 as blocked
from {lineitem} join {part} on l_partkey = p_partkey"""

CATALOG = """
select o_orderkey as ord, concat('u', cast(o_orderkey % 5000 as string)) as listing_url,
  case when o_orderkey % 41 = 0 then '' else concat('Item ', cast(o_orderkey as string)) end as title,
  case when o_orderkey % 13 = 0 then '' else concat('c', cast(o_orderkey as string), '.jpg') end as cover_image,
  cast(null as string) as image_2, ' b.jpg ' as image_3,
  case when o_orderkey % 3 = 0 then 'x.jpg, y.jpg' else '' end as extra_images,
  case when o_orderkey % 17 = 0 then 'n/a' else cast(o_orderkey % 977 as string) end as price
from {orders}"""

RANKED = """
select o_orderkey as ord, concat('u', cast(o_orderkey % 1500 * 2 as string)) as listing_url,
  cast(o_orderkey % 193 + 2 as string) as times_listed,
  case when o_orderkey % 7 = 0 then '?' else cast(o_orderkey % 500 as string) end as price
from {orders}"""

QUEUE = f"""
select id, source, listing_url, title, price, times_listed, state, account, attempts,
  case when state <> 'pending' then concat('w', cast(worker as string)) end as holder,
  case when state <> 'pending' then timestamp '{NOW}' - interval '1' minute * (id % 600) end as held_since,
  cast(null as timestamp) as done_at, cast(null as string) as done_url, cast(null as string) as refusal
from (select o_orderkey as id, 'import' as source, concat('u', cast(o_orderkey - o_orderkey % 3 as string)) as listing_url,
    concat('Item ', cast(o_orderkey as string)) as title, o_totalprice as price,
    cast(cast(substr(o_orderpriority, 1, 1) as int) * 10 + o_orderkey % 50 as int) as times_listed,
    case when o_orderkey % 11 = 0 then 'rejected' when o_orderstatus = 'P' then 'pending' when o_orderstatus = 'O' then 'claimed' else 'done' end as state,
    concat('acct', cast(o_orderkey % 3 as string)) as account, cast(o_orderkey % 6 as int) as attempts, o_custkey as worker
  from {{orders}}) q"""

STAFF = """
select concat('w', cast(c_custkey as string)) as id, c_name as name, c_custkey % 10 <> 0 as active,
  case c_custkey % 3 when 0 then true when 1 then false end as by_queue,
  case when c_custkey % 7 = 0 then null else concat('acct', cast(c_custkey % 3 as string)) end as own_account
from {customer}"""

#: Completions, with the local day eight hours ahead of UTC.
DONE = """
select event_id as id, concat('w', cast(user_id as string)) as worker_id, ts as done_at,
  cast(ts + interval '8' hour as date) as day
from {events} where event_type = 'purchase'"""

#: Page titles with a cost, for near-duplicate pairs.
TITLES = "select page_id as id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, cast(length(html) as double) as cost from {pages}"

#: Variants of a product: one model a line of an order.
MODELS = """
select l_orderkey as product, l_linenumber * 100000 + l_partkey as pos,
  concat(p_name, case l_linenumber % 3 when 0 then '' when 1 then ' 120 x 60 cm' else ' Size M' end) as name,
  cast(floor(l_extendedprice / 3 + 0.5) / 100 as double) as price,
  case when l_linenumber % 4 = 0 then cast(null as string) else concat('img', cast(l_partkey % 50 as string)) end as image
from {lineitem} join {part} on l_partkey = p_partkey"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


class _Names(dict):
    def __missing__(self, name: str) -> str:
        return name


def view(spark: SparkSession, sf_dir: str, sql: str, piece: int | None = None) -> DataFrame:
    frames = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), piece) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **frames)


def plain(sql: str) -> str:
    """The same view where tables go by their names."""
    return sql.format_map(_Names())
