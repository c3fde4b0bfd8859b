"""Connected components by alternating large-star and small-star passes (Kiveris et al., 2014).

All passes are joins and map-side combined aggregates. Nothing is gathered on the driver but one count
and one checksum a pass. Smallest neighbours are written before they are joined back, so that both sides of those
joins are plain shuffles and adaptive execution may split a hub node's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukspark.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another; the sums of 20 bits each leave room for 2^43 edges."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64("b", "a")), F.sum(F.pmod(h, F.lit(1 << 20)))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; root is the smallest node reachable.

    Edges may repeat, point either way or be loops; edges with a null end count as none. An empty table
    gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    e = cut(e.where("a <> b and not x and not y").select("a", "b").distinct())
    seen = _mark(e)
    while seen[0]:
        e = cut(_small(_large(e)))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
