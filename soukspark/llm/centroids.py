"""Centroid clustering (k-means over integer vectors) by the threshold algorithm.

For every dimension the centroids lie in a list sorted by their component there. A vector walks outward from its own
value in all lists at once; a centroid met for the first time is measured exactly. What the lists have not shown yet is
at least as far in each dimension as the frontier there, so once the sum over the frontiers strictly exceeds the best
exact distance, no centroid is left that could be nearer or as near. All numbers are integers, so ties are true ties.

The centroids, k times the dimension, are all that tasks are given and all that comes back: every task adds up its
vectors by cluster, and Spark adds up the tasks' sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukspark.llm.ann import matrix
from soukspark.llm.common import cut, widened

#: Vectors that walk at once.
ROWS = 512
#: Components must be smaller than this, so that distances fit 64 bits up to 256 dimensions.
LARGEST = 1 << 26


class Lists:
    """Centroids in a sorted list for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid, ties to the smaller one, and its squared distance."""
        number, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            number[at : at + ROWS], best[at : at + ROWS] = self._walk(x[at : at + ROWS])
        return number, best

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (k, dim), (n, _) = self.c.shape, x.shape
        far, top = np.iinfo(np.int64).max, LARGEST * 4
        dims = np.arange(dim)
        # the next centroid on either side; past an end the gap is larger than any
        right = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in range(dim)], 1) if dim else np.zeros((n, 0), np.int64)
        left = right - 1
        seen = np.zeros((n, k), bool)
        number, best = np.full(n, k), np.full(n, far)
        live = np.arange(n)
        for _ in range(k):
            y, lo, hi = x[live], left[live], right[live]
            below = np.where(lo >= 0, y - self.values[dims, np.maximum(lo, 0)], top)
            above = np.where(hi < k, self.values[dims, np.minimum(hi, k - 1)] - y, top)
            down = below <= above
            met = self.order[dims, np.where(down, lo, np.minimum(hi, k - 1))]
            frontier = (np.minimum(below, above) ** 2).sum(1)
            left[live], right[live] = lo - down, hi + ~down
            new = np.zeros((len(live), k), bool)
            new[np.arange(len(live))[:, None], met] = True
            r, c = np.nonzero(new & ~seen[live])
            d = ((y[r] - self.c[c]) ** 2).sum(1)
            seen[live[r], c] = True
            # nearest first, of equal ones the smaller number: the first of each row counts
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            r, first = np.unique(r, return_index=True)
            row, c, d = live[r], c[first], d[first]
            won = (d < best[row]) | (d == best[row]) & (c < number[row])
            best[row[won]], number[row[won]] = d[won], c[won]
            live = live[(frontier <= best[live]) & ~seen[live].all(1)]
            if not len(live):
                break
        return number, best


def usable(vectors: DataFrame, embedding: str, dim: int, scale: int) -> DataFrame:
    """All columns of the vectors of ``dim`` components, none null or non-finite, and ``_v``: floor(scale * x) of each."""
    v = F.col(embedding).cast("array<double>")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    within = F.forall("_v", lambda x: F.abs(x) < LARGEST)
    rows = vectors.where(good).withColumn("_v", whole)
    return rows.withColumn("_v", F.when(within, F.transform("_v", lambda x: x.cast("long"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more"))))


def starts(rows: DataFrame, key: str, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k keys with the smallest SHA-256 of ``salt`` and the key; ties: by components. A null key
    comes last. k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256)
    found = rows.select(h.alias("h"), "_v").orderBy(F.asc_nulls_last("h"), "_v").limit(k).collect()
    return [list(r._v) for r in found]


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, s``: of each cluster its vectors' number and componentwise sums, added up task by task."""
    k, dim = centroids.shape

    def of(batches):
        lists, n, s = Lists(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            number, _ = lists.nearest(x)
            n += np.bincount(number, minlength=k)
            np.add.at(s, number, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = rows.select("_v").mapInArrow(of, "cluster int, n long, s array<long>")
    # a task's row for each cluster at most: one aggregate adds up all tasks'
    sums = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums)


def updated(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean, by exact integers; one without vectors stays."""
    out = [list(c) for c in centroids]
    for r in _sums(rows, np.array(centroids, np.int64)).collect():  # k rows
        out[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(len(out[r.cluster]))]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` with ``cluster`` and ``distance`` (squared) in place of ``_v``."""
    keep = [c for c in rows.columns if c != "_v"]
    schema = widened(rows.select(*keep), "cluster int, distance long")
    c = np.array(centroids, np.int64)

    def of(batches):
        lists = Lists(c)
        for batch in batches:
            number, best = lists.nearest(matrix(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(number.astype(np.int32)), pa.array(best)], schema.fieldNames())

    return rows.select(*keep, "_v").mapInArrow(of, schema)


def cluster(vectors: DataFrame, k: int, rounds: int, key: str = "vec_id", embedding: str = "embedding", dim: int = 64, scale: int = 256, salt: str = "") -> tuple[DataFrame, list[list[int]]]:
    """``key, cluster, distance`` (squared, to the nearest centroid) of every vector that takes part, and the centroids.

    Components x count as floor(scale * x). Vectors that are null, of another length, or with null or non-finite
    components take no part; vectors of zeros do. Rows that repeat a key each count, as do rows with a null key.
    The first centroids are vectors of ``starts``, as many as there are vectors if there are fewer than k. Ties go to
    the smaller number; a centroid without vectors stays. An empty table gives no rows and no centroids. Other columns
    are not read. A component of ``LARGEST`` or more after scaling raises an error, since distances would not fit.
    """
    rows = cut(usable(vectors.select(key, embedding), embedding, dim, scale).select(key, "_v"))
    centroids = starts(rows, key, k, salt)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], widened(vectors.select(key), "cluster int, distance long")), []
    for _ in range(rounds):
        centroids = updated(rows, centroids)
    return assigned(rows, centroids), centroids


def inertia(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cluster_inertia`` and ``inertia``: ``distance`` summed over the cluster and over all."""
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    sums_df = rows.sparkSession.createDataFrame([*sums.items()], "cluster int, cluster_inertia long")
    return rows.join(F.broadcast(sums_df), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))
