"""A join on a ratio of two amounts, as a hash join on logarithmic buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(x: str | Column, share: float) -> Column:
    return F.floor(F.log(x) / math.log(1 + share)).cast("long")


def within_share(probe: DataFrame, build: DataFrame, probe_amount: str, build_amount: str, share: float, equal: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose build amount is within ``share`` of the probe amount, as ``amount BETWEEN p*(1-s) AND p*(1+s)``, and
    whose columns in ``equal`` are equal.

    Amounts that are null or not above 0 match nothing. Columns of the two sides must differ. The band spans
    log(1-s) to log(1+s) in units of log(1+s); a bucket more on either side takes up rounding.
    """
    low = math.floor(math.log(1 - share) / math.log(1 + share)) - 1
    near = F.explode(F.array(*[F.lit(k).cast("long") for k in range(low, 3)]))
    p = probe.where(F.col(probe_amount) > 0).withColumn("_off", near).withColumn("_pb", bucket(probe_amount, share) + F.col("_off"))
    b = build.where(F.col(build_amount) > 0).withColumn("_bb", bucket(build_amount, share))
    inside = F.col(build_amount).between(F.col(probe_amount) * (1 - share), F.col(probe_amount) * (1 + share))
    same = F.col("_pb") == F.col("_bb")
    for x, y in equal:
        same = same & (F.col(x) == F.col(y))
    return p.join(b, same & inside).drop("_off", "_pb", "_bb")
