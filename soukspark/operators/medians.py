"""Exact medians of groups of any size, by selection in passes.

A pass counts each group's values in ranges between its least and its largest value (of equal width, or of equal ratio where
these are far apart); the range that holds the middle one is looked at by the next pass. Every pass is one map-side combined aggregate, so a group's values are never in one task;
what a group comes to is as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukspark.scratch import cut

RANGES = 1024


def _range(v: Column, lo: Column, hi: Column) -> Column:
    """Which range a value between ``lo`` and ``hi`` falls in; never falls as values rise."""
    share = lambda x, a, b: F.when(b > a, F.least(F.floor((x - a) / ((b - a) / RANGES)).cast("int"), F.lit(RANGES - 1)))
    # near together, so their difference is exact enough; else by their logarithms, those below 0 turned round
    linear, above, below = share(v, lo, hi), share(F.ln(v), F.ln(lo), F.ln(hi)), share(-F.ln(-v), -F.ln(-lo), -F.ln(-hi))
    two = lambda c: F.when(c, 0).otherwise(1)
    near = F.when((hi - lo) / RANGES > 0, linear).otherwise(two(v == lo))
    positive = F.when(lo == 0, two(v == 0)).when(hi / lo > 4, above).otherwise(near)
    negative = F.when(hi == 0, two(v < 0)).when(lo / hi > 4, below).otherwise(near)
    return F.when((lo < 0) & (hi > 0), F.signum(v).cast("int")).when(lo >= 0, positive).otherwise(negative)


def upper(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and ``median``: of each group's values that are not null the element at half their number, counted from 0 in
    ascending order. A group without values has no row. Values must be finite; null groups are groups."""
    names = [f"_g{k}" for k in range(len(by))]
    rows = cut(rows.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null"))
    same = [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names]
    found = None
    # of each group the range that holds its median, the values in it, and the median's place among them
    open_ = cut(rows.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).withColumn("at", F.expr("n div 2")))
    while not open_.isEmpty():
        done = open_.where("lo = hi").select(*names, F.col("lo").alias("median"))
        found = done if found is None else found.unionAll(done)
        open_ = open_.where("lo < hi")
        part = open_.select(*[F.col(n).alias(f"r{n}") for n in names], "lo", "hi", "at")
        inside = rows.join(part, [*same, F.col("v").between(F.col("lo"), F.col("hi"))]) if names else rows.crossJoin(part).where("v between lo and hi")  # one row
        ranges = inside.groupBy(*names, "at", _range(F.col("v"), F.col("lo"), F.col("hi")).alias("k"))
        ranges = ranges.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = ranges.withColumn("before", before).where("before <= at and at < before + n")
        open_ = cut(ranges.select(*names, "lo", "hi", "n", (F.col("at") - F.col("before")).alias("at")))
    if found is None:
        found = rows.select(*names, F.col("v").alias("median")).limit(0)
    return cut(found).select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "median")
