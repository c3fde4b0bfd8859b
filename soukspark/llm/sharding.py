"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions.

The published loop multiplies a 64-bit state modulo 2^64. Spark's ANSI arithmetic does not wrap, so the state is
held as two 32-bit halves, with products that never leave 63 bits. Appending a shard moves only the rows that it
takes; there is no ring table, and only the key and the shard count decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukspark.llm.common import free_name

#: The multiplier of the published generator is 2862933555777941757; its upper half and its lower half less 2^32.
_HIGH = 2862933555777941757 >> 32
_LOW = (2862933555777941757 & 0xFFFFFFFF) - (1 << 32)
_MASK = (1 << 32) - 1
#: Parts into which each shard is numbered; a part is one task's window.
PARTS = 1024


def jump(key: Column, shards: list[int]) -> Column:
    """A struct of the shard (int) of a long key for each count in ``shards``, from one walk.

    The walk jumps at least one shard a step, so as many steps as the largest count are enough; after the
    last jump nothing is computed.
    """
    most = max(shards)

    def step(s, _):
        hi, lo = s["hi"], s["lo"]
        product = lo * F.lit(_LOW)
        low = product.bitwiseAND(F.lit(_MASK)) + 1
        high = lo * F.lit(_HIGH) + hi * F.lit(_LOW) + F.shiftright(product, 32) + lo + F.shiftright(low, 32)
        high, low = high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        found = [F.when(s["j"] < n, s["j"]).otherwise(s[f"b{n}"]).alias(f"b{n}") for n in shards]
        return F.when(s["j"] >= most, s).otherwise(F.struct(high.alias("hi"), low.alias("lo"), j.alias("j"), *found))

    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(F.lit(_MASK)).alias("hi"),
        key.bitwiseAND(F.lit(_MASK)).alias("lo"),
        F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(f"b{n}") for n in shards],
    )
    end = lambda s: F.struct(*[F.when(s["j"] < n, s["j"]).otherwise(s[f"b{n}"]).cast("int").alias(f"b{n}") for n in shards])
    # the first jump starts from shard 0, so n - 1 further ones reach the end
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step, end)


def assign(docs: DataFrame, n_shards: int, key: str = "doc_id", ties: list[str] | None = None, numbered: bool = True) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (int; the shard among n_shards and among one more) and, if
    ``numbered``, ``slot`` (long, gapless from 0 in each shard). Underscores come in front of taken names.

    Keys that are whole numbers are hashed as they are, others by XXH64; a null key counts as 0. Rows of one key
    share a shard, whose numbering is dealt over parts by all of ``ties`` (default: every column that can be
    ordered), so that a key with many rows does not make one window; among rows that are equal in ``ties``,
    any order may hold. Where key and ties are all columns there are, rows that are equal are counted before they are
    numbered and make no window either; otherwise they share one. An empty table gives an empty table.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    shard, grown, slot, part, both, base = (free_name(docs, x) for x in ("shard", "grown_shard", "slot", "part", "both", "base"))
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(0).cast("long"))
    out = docs.withColumn(both, jump(number, [n_shards, n_shards + 1]))
    out = out.select(*docs.columns, F.col(f"{both}.b{n_shards}").alias(shard), F.col(f"{both}.b{n_shards + 1}").alias(grown))
    if not numbered:
        return out
    ties = ties or [c for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    out = out.withColumn(part, F.pmod(F.xxhash64(key, *ties), F.lit(PARTS)).cast("int"))
    # PARTS rows for each shard, whatever the input
    counts = out.groupBy(shard, part).agg(F.count("*").alias(base))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long"))
    inside = Window.partitionBy(shard, part).orderBy(key, *ties)
    if {key, *ties} == set(docs.columns):
        # rows that are equal are one row of the window, with their number
        n, step = free_name(docs, "n"), free_name(docs, "step")
        out = out.groupBy(*out.columns).agg(F.count("*").alias(n))
        first = F.coalesce(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
        out = out.withColumn(slot, first).withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
        out = out.withColumn(slot, F.col(slot) + F.col(step))
    else:
        out = out.withColumn(slot, F.row_number().over(inside).cast("long") - 1)
    out = out.join(F.broadcast(counts), [shard, part])
    return out.select(*docs.columns, shard, grown, (F.col(slot) + F.col(base)).alias(slot))


def write_shards(assigned: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, rows in slot order within each file."""
    assigned.repartition(F.col(shard), F.floor(F.col(slot) / 1_000_000)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
