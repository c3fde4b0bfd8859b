"""Registered queries that run streams over the given tables to their end, each with the SQL it is held against."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soukspark import scratch
from soukspark.catalogue_queries import query
from soukspark.plans import adapters
from soukspark.plans.adapters import NOW, plain, view
from soukspark.streaming import claims, tries


@contextmanager
def state_store(spark: SparkSession, tasks: int):
    """State in RocksDB, in so many partitions; what the session had is set again afterwards."""
    names = {"spark.sql.streaming.stateStore.providerClass": claims.STORE, "spark.sql.shuffle.partitions": str(tasks)}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drained(rows: DataFrame, name: str) -> DataFrame:
    """What a stream appends until nothing is left to read."""
    spark, out = rows.sparkSession, scratch.folder(rows.sparkSession, name)
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _replayed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    path = scratch.folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


# -- the work queue ------------------------------------------------------------------------------------------------

_TAKES = 3
#: A day: all staff claim, some finish their first row, some reject their second, and five hours later half claim again.
_DAY = f"""added as ({plain(adapters.QUEUE)}),
  a as (select id, account, listing_url url, times_listed, row_number() over (partition by account order by times_listed desc, id) r from added),
  s as (select id worker, cast(substr(id, 2) as bigint) n, own_account account from ({plain(adapters.STAFF)}) t where own_account is not null),
  w as (select *, row_number() over (partition by account order by n) k from s),
  c as (select a.*, worker, n, (r - 1) % {_TAKES} nth from a left join w on a.account = w.account and w.k = cast(floor((r - 1) / {_TAKES}) as bigint) + 1)"""


def _commands(spark: SparkSession, d: str) -> DataFrame:
    """The day's commands; whose row is which is known from the order that claims go by."""
    queue, staff = view(spark, d, adapters.QUEUE), view(spark, d, adapters.STAFF)
    sql = _DAY.replace(plain(adapters.QUEUE), "select * from {queue}").replace(plain(adapters.STAFF), "select * from {staff}")
    held = spark.sql(f"with {sql} select id, worker, n, nth from c where worker is not null", queue=queue, staff=staff)
    t0, none = F.to_timestamp(F.lit(NOW)), F.lit(None)
    number = F.expr("cast(substr(id, 2) as bigint)")

    def at(after: str, ms="0L"):
        return t0 + F.expr(f"interval {after}") + F.expr(f"make_dt_interval(0, 0, 0, {ms} / 1000.0)")

    def rows(df, ts, action, **has):
        names = [c.split() for c in claims.COMMAND.split(", ")]
        of = {"source": F.lit("import"), "ts": ts, "seq": F.lit(0), "action": F.lit(action)} | has
        return df.select(*[of.get(n, none).cast(t).alias(n) for n, t in names])

    parts = [
        rows(queue, at("0 hours"), "add", seq=F.col("id"), account=F.col("account"), id=F.col("id"), url=F.col("listing_url"), times_listed=F.col("times_listed")),
        rows(staff.withColumn("k", number), at("1 minute", "k"), "claim", seq=number, worker=F.col("id"), n=F.lit(_TAKES)),
        rows(held.where("nth = 0 and n % 3 = 0"), at("1 hour"), "complete", seq=F.col("id"), worker=F.col("worker"), id=F.col("id")),
        rows(held.where("nth = 1 and n % 5 = 1"), at("2 hours"), "reject", seq=F.col("id"), worker=F.col("worker"), id=F.col("id")),
        rows(staff.withColumn("k", number).where("k % 2 = 0"), at("6 hours", "k"), "claim", seq=number, worker=F.col("id"), n=F.lit(_TAKES)),
        rows(spark.range(1), at("2 days"), "tick"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(f"""with {_DAY},
  rejected as (select distinct url from c where worker is not null and nth = 1 and n % 5 = 1 and url is not null),
  e as (select *, case when worker is null then case when url in (select url from rejected) then 'sibling' else 'pending' end
    when nth = 0 and n % 3 = 0 then 'done' when nth = 1 and n % 5 = 1 then 'rejected' else 'claimed' end said from c),
  g as (select *, case when said in ('pending', 'claimed') then row_number() over (partition by account, said in ('pending', 'claimed') order by times_listed desc, id) end q from e),
  v as (select worker again, account, row_number() over (partition by account order by n) k from s where n % 2 = 0)
  select id, case when again is not null then 'claimed' when said = 'sibling' then 'rejected' else said end state,
    cast((case when worker is null then 0 else 1 end) + (case when again is null then 0 else 1 end) as int) attempts, coalesce(again, case when said <> 'pending' then worker end) worker
  from g left join v on g.account = v.account and v.k = cast(floor((q - 1) / {_TAKES}) as bigint) + 1""")
def t2_t4_x3_queue_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Where every row of the queue stands after a day of claims, completions, rejections and ended leases."""
    with state_store(spark, 4):
        commands = claims.addressed(_replayed(spark, _commands(spark, d), "commands"), view(spark, d, adapters.STAFF))
        return claims.snapshot(_drained(claims.outcomes(commands), "outcomes"))


# -- attempts at pages ---------------------------------------------------------------------------------------------

_ATTEMPTS = """select concat('w', cast(user_id % 50 as string)) as worker_id, cast(user_id % 1000 as string) as item_id,
  cast(event_id * 1000 as bigint) as ms, cast(event_id as bigint) as seq, event_id % 5 <> 0 as visible,
  case when event_type = 'purchase' then concat('p', cast(event_id as string)) end as payload from {events}"""
_SENT = f"""with a as ({plain(_ATTEMPTS)}), b as (select *, count(*) filter (payload is null and visible) over (partition by worker_id, item_id order by ms, seq) n from a),
  c as (select *, row_number() over (partition by worker_id, item_id order by ms, seq) r from b where payload is not null or visible and n >= {tries.TRIES})
  select worker_id, item_id, ms, seq, payload, payload is null unloaded from c where r = 1"""


@query(_SENT)
def t10_attempts_sent(spark: SparkSession, d: str) -> DataFrame:
    return tries.sent(view(spark, d, _ATTEMPTS))


@query(_SENT)
def t10_attempts_streamed(spark: SparkSession, d: str) -> DataFrame:
    with state_store(spark, 4):
        return _drained(tries.streamed(_replayed(spark, view(spark, d, _ATTEMPTS), "attempts")), "sent")
