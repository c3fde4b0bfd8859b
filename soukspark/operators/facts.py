"""The sourcing cascade kept up to date: a new export is judged against stored facts, and only rows whose verdict may have
changed are judged again.

Stored are the rows in narrow form, with what was said of each, and partial aggregates: of every shop whether one of its
rows claims to be local or is proven, of every product its first passing copy. All of them only grow with rows that come
later, so a new export merges into them; rows of shops that gained a fact and of products whose first copy changed are
judged again. Each export's rows and verdicts are stored once; what became of older rows lies beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukspark.config import Flags
from soukspark.operators import sourcing
from soukspark.scratch import discard, stored

VERDICT = ["ord", "shop_id", "product_id", "reason", "good"]


def _key(shop: str) -> Column:
    """A shop as text, in which an unknown one is one shop, too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(shop).cast("string")), F.lit("-"))


class Facts:
    """What is known after the exports so far: ``rows`` (narrow), ``shops``, ``firsts`` and ``verdicts``. Each export's rows
    must have an ``ord`` above those before."""

    def __init__(self, flags: Flags = Flags()):
        self.flags = flags
        self.rows: list[DataFrame] = []
        self.said: list[DataFrame] = []
        self.shops = self.firsts = self.verdicts = self.later = None

    def add(self, items: DataFrame) -> DataFrame:
        """Takes an export in; ``VERDICT`` rows that are new or came out otherwise than before, with ``was`` and ``known``
        (whether the row was there before)."""
        new = stored(sourcing.narrow(items, self.flags).withColumn("_shop", _key("shop_id")), "new")
        added = sourcing.shop_facts(new, self.flags, "_shop").select("_shop", "local_shop", "proven_shop")
        if not self.rows:
            self.shops = stored(added, "shops")
            self.firsts = stored(self._firsts(new), "firsts")
            self.verdicts = stored(self._verdict(new), "judged")
            self.rows, self.said = [new], [self.verdicts]
            return self.verdicts.select("*", F.lit(None).cast("string").alias("was"), F.lit(False).alias("known"))
        had = self.shops, self.firsts
        self.shops = stored(had[0].unionByName(added).groupBy("_shop").agg(F.bool_or("local_shop").alias("local_shop"), F.bool_or("proven_shop").alias("proven_shop")), "shops")
        gained = self.shops.join(had[0].withColumnsRenamed({"local_shop": "_l", "proven_shop": "_p"}), "_shop").where("local_shop <> _l or proven_shop <> _p").select("_shop")
        old = reduce(DataFrame.unionByName, self.rows)
        # rows that may pass now and did not before: of shops that gained a fact, and the new ones
        turned = stored(old.join(gained, "_shop", "left_semi"), "turned")
        self.firsts = stored(had[1].unionByName(self._firsts(turned.unionByName(new))).groupBy("_id").agg(F.min("_first").alias("_first")), "firsts")
        changed = self.firsts.join(had[1].withColumnRenamed("_first", "_f"), "_id", "left").where("_f is null or _first <> _f").select(F.col("_id").alias("product_id"))
        again = old.join(gained, "_shop", "left_anti").join(changed, "product_id", "left_semi")
        judged, otherwise = stored(self._verdict(new), "judged"), stored(self._verdict(turned.unionByName(again)), "otherwise")
        was = self.verdicts.select("ord", F.col("reason").alias("was"))
        out = judged.select("*", F.lit(None).cast("string").alias("was"), F.lit(False).alias("known"))
        out = out.unionByName(otherwise.join(was, "ord").where("not (reason <=> was)").withColumn("known", F.lit(True)))
        self.later = otherwise if self.later is None else stored(self.later.join(otherwise.select("ord"), "ord", "left_anti").unionByName(otherwise), "later")
        self.rows.append(new)
        self.said.append(judged)
        self.verdicts = reduce(DataFrame.unionByName, self.said).join(self.later.select("ord"), "ord", "left_anti").unionByName(self.later)
        for table in had:
            discard(table)
        return out

    def _firsts(self, rows: DataFrame) -> DataFrame:
        passing = sourcing.passing(rows.join(self.shops, "_shop"), self.flags)
        return passing.groupBy(F.col("product_id").alias("_id")).agg(F.min("ord").alias("_first"))

    def _verdict(self, rows: DataFrame) -> DataFrame:
        return sourcing.verdict(rows.join(self.shops, "_shop"), self.firsts, self.flags).select(*VERDICT)
