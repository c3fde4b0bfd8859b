"""The work queue as snapshots: each operation is a function from a snapshot to the next one.

A row's states: pending, claimed, done, rejected. ``now`` is always given. Where many people work at once, one writer
an account applies the operations (``streaming.leases`` keeps the same rules as state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukspark.config import LEASE_HOURS, RETENTION_DAYS


def at(now: str | Column) -> Column:
    return F.to_timestamp(F.lit(now)) if isinstance(now, str) else now


def expired(now: str | Column, hours: int = LEASE_HOURS) -> Column:
    return (F.col("state") == "claimed") & (F.col("held_since") < at(now) - F.make_dt_interval(hours=F.lit(hours)))


def claimable(queue: DataFrame, now: str) -> DataFrame:
    return queue.where((F.col("state") == "pending") | expired(now))


def best(queue: DataFrame, staff: DataFrame, worker: str, n: int, now: str) -> DataFrame:
    """Ids of the first n rows that a worker may claim: of its account, most listed first."""
    own = staff.where(F.col("id") == worker).select(F.col("own_account").alias("account"))
    return claimable(queue, now).join(own, "account", "left_semi").orderBy(F.desc("times_listed"), "id").limit(n).select("id")


def claim(queue: DataFrame, staff: DataFrame, worker: str, n: int, now: str) -> DataFrame:
    """The snapshot after a claim; the rows it took carry ``taken``. A worker without an account takes none."""
    got = best(queue, staff, worker, n, now).withColumn("taken", F.lit(True))
    return _claimed(queue.join(got, "id", "left"), F.lit(worker), now)


def claim_all(queue: DataFrame, n: int, now: str) -> DataFrame:
    """The first n claimable rows of every account: what one worker an account would take."""
    rank = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("times_listed"), "id"))
    return claimable(queue, now).withColumn("rank", rank).where(F.col("rank") <= n)


def _claimed(rows: DataFrame, worker: Column, now: str) -> DataFrame:
    taken = F.coalesce("taken", F.lit(False))
    put = lambda c, v: F.when(taken, v).otherwise(F.col(c))
    return rows.withColumns({"taken": taken, "state": put("state", F.lit("claimed")), "holder": put("holder", worker), "held_since": put("held_since", at(now)), "attempts": put("attempts", F.col("attempts") + 1)})


def _own(queue: DataFrame, worker: str, ids: list[int] | DataFrame) -> DataFrame:
    """``queue`` with ``changed``: rows named in ``ids`` (a list, or a table of any size with ``id``) that the worker holds."""
    own = (F.col("holder") == worker) & (F.col("state") == "claimed")
    if not isinstance(ids, DataFrame):
        return queue.withColumn("changed", F.coalesce(own & F.col("id").isin(ids), F.lit(False)))
    rows = queue.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    return rows.withColumn("changed", F.coalesce(own & F.col("_asked"), F.lit(False))).drop("_asked")


def complete(queue: DataFrame, worker: str, ids: list[int] | DataFrame, now: str, url: str | None = None) -> DataFrame:
    """The snapshot after a worker finished rows that it holds; those carry ``changed``."""
    rows = _own(queue, worker, ids)
    put = lambda c, v: F.when(F.col("changed"), v).otherwise(F.col(c))
    return rows.withColumns({"state": put("state", F.lit("done")), "done_at": put("done_at", at(now)), "done_url": put("done_url", F.coalesce(F.lit(url).cast("string"), "done_url"))})


def reject(queue: DataFrame, worker: str, ids: list[int] | DataFrame, now: str, why: str | None = None) -> DataFrame:
    """The snapshot after a worker rejected rows that it holds (``changed``), and with them pending rows of the same
    URLs. Rows without a URL have no such others."""
    rows = _own(queue, worker, ids)
    urls = rows.where("changed and listing_url is not null").select("listing_url").distinct().withColumn("_sibling", F.lit(True))
    rows = rows.join(urls, "listing_url", "left")
    other = ~F.col("changed") & (F.col("state") == "pending") & F.coalesce("_sibling", F.lit(False))
    reason = F.when(F.col("changed"), F.lit(why).cast("string")).when(other, F.lit(f"{why if why is not None else 'rejected'} [via another account]")).otherwise(F.col("refusal"))
    hit = F.col("changed") | other
    return rows.withColumns({"refusal": reason, "done_at": F.when(hit, at(now)).otherwise(F.col("done_at")), "state": F.when(hit, "rejected").otherwise(F.col("state"))}).drop("_sibling")


def release(queue: DataFrame, worker: str) -> DataFrame:
    """The snapshot after a worker gave back all it holds (``changed``); attempts stay."""
    hit = F.coalesce((F.col("holder") == worker) & (F.col("state") == "claimed"), F.lit(False))
    rows = queue.withColumn("changed", hit)
    gone = lambda c: F.when(~F.col("changed"), F.col(c))
    return rows.withColumns({"state": F.when(F.col("changed"), "pending").otherwise(F.col("state")), "holder": gone("holder"), "held_since": gone("held_since")})


def clone(queue: DataFrame, account: str, source: str) -> DataFrame:
    """Fresh pending rows for an account from all that the source account has not rejected, unless the account has the
    URL. Rows without a URL are copied every time."""
    rows = queue.where((F.col("account") == source) & (F.col("state") != "rejected"))
    have = queue.where(F.col("account") == account).select("listing_url")
    fresh = rows.join(have, "listing_url", "left_anti")
    return fresh.select("source", "listing_url", "title", "price", "times_listed", F.lit(account).alias("account"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def stats(queue: DataFrame, now: str, by_account: bool = False) -> DataFrame:
    measures = [F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "claimed", "done", "rejected")]]
    more = [F.count_if(expired(now)).alias("lease_expired"), F.count_if((F.col("attempts") > 3) & (F.col("state") != "done")).alias("repeatedly_reclaimed")]
    return queue.groupBy("account").agg(*measures).orderBy("account") if by_account else queue.agg(*measures, *more)


def done_today(done: DataFrame, day: str) -> DataFrame:
    return done.where(F.col("day") == F.lit(day).cast("date")).groupBy("worker_id").agg(F.count("*").alias("count_today"))


def daily(done: DataFrame) -> DataFrame:
    return done.groupBy("worker_id", "day").agg(F.count("*").alias("n"))


def local_day(ts: str | Column, zone: str = "Asia/Singapore") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def depth(queue: DataFrame, staff: DataFrame) -> DataFrame:
    """Pending rows of each worker's account; none without one."""
    n = queue.where("state = 'pending'").groupBy(F.col("account").alias("own_account")).agg(F.count("*").alias("n"))
    return staff.join(n, "own_account", "left").select(F.col("id").alias("worker_id"), F.coalesce("n", F.lit(0)).alias("depth"))


def gate(requests: DataFrame, staff: DataFrame) -> DataFrame:
    """Requests (``worker_id``, ``mode`` asked for) with ``status`` (200, 403 inactive, 404 unknown) and queue mode."""
    known = staff.select(F.col("id").alias("worker_id"), "active", "by_queue", F.lit(True).alias("_known"))
    out = requests.join(known, "worker_id", "left")
    status = F.when(F.col("_known").isNull(), 404).when(~F.coalesce("active", F.lit(False)), 403).otherwise(200)
    return out.select("worker_id", status.alias("status"), (F.coalesce("mode", F.lit(False)) | F.coalesce("by_queue", F.lit(False))).alias("by_queue"))


def public(queue: DataFrame) -> DataFrame:
    """What staff may see: nothing about costs, in the order to work in."""
    return queue.orderBy(F.desc("times_listed"), "id").select("id", "listing_url", "title", "price", "times_listed", "attempts")


def retained(inbox: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Without rows that were consumed and are older than so many days."""
    old = F.coalesce(F.col("consumed") & (F.col("created_at") < at(now) - F.make_dt_interval(days=F.lit(days))), F.lit(False))
    return inbox.where(~old)


def finish_listings(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Listings with the ``outcome`` of requests (``listing_id, worker_id, skip, url``): null untouched, 404, 403 another
    worker's, 409 not active, 200 done, or ``deleted``; the outcome of unknown listings comes as rows of null status."""
    r = requests.select(F.col("listing_id").alias("id"), F.col("worker_id").alias("_w"), "skip", F.col("url").alias("_url"), F.lit(True).alias("_asked"))
    out = listings.withColumn("_known", F.lit(True)).join(r, "id", "full")
    outcome = F.when(F.col("_asked").isNull(), None).when(F.col("_known").isNull(), "404").when(~F.col("assigned_worker_id").eqNullSafe(F.col("_w")), "403")
    outcome = outcome.when(F.col("status") != "active", "409").when(F.coalesce("skip", F.lit(False)), "deleted").otherwise("200")
    ok = F.col("outcome") == "200"
    out = out.withColumn("outcome", outcome)
    done = {"status": F.when(ok, "done").otherwise(F.col("status")), "sold_url": F.when(ok, F.coalesce("_url", "sold_url")).otherwise(F.col("sold_url"))}
    return out.withColumns(done).drop("_w", "skip", "_url", "_asked", "_known")
