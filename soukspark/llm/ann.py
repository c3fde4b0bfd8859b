"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own, fitted on a bounded sample; every vector is indexed
under its pair of centroids. A query walks centroid pairs by summed distance with a heap until they hold enough
entries, and those are reranked by exact distance. How many are enough is measured: a bounded number of calibration
queries is answered by brute force, and the walk goes as far as their neighbours need for the recall asked for.

Codebooks grow with the root of the number of vectors, so a pair of centroids holds about as many entries at every
size. Cells lie in groups of consecutive cells; a cell that holds more than a group is dealt over several. A task holds
the entries of one group, which are shipped once, and lets the queries whose walks enter it stream by, each with the
cells of its walk there.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soukspark.llm.common import cut, partitions

#: Vectors that codebooks are fitted on, and queries that the length of the walk is fitted on, at most.
SAMPLE, CALIBRATION = 20_000, 64
#: Centroids of a half, at least and at most, and entries of a pair that they are chosen for.
CENTROIDS, OCCUPANCY, ROUNDS = (16, 512), 16, 10
#: Entries of a group, at most, and entries and queries compared at once.
GROUP, ENTRIES, QUERIES = 1 << 17, 1024, 1024


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centroids; fewer if there are fewer distinct rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        a = distances(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding; where they leave the range of numbers, the largest one."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    return np.nan_to_num(np.maximum(d, 0), nan=np.finfo(float).max)


def halves(x: np.ndarray, books: tuple) -> tuple[np.ndarray, np.ndarray]:
    h = books[0].shape[1]
    return distances(x[:, :h], books[0]), distances(x[:, h:], books[1])


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Centroid pairs by ascending summed distance, empty ones left out, until they hold enough entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    table = held[o1][:, o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, out, total = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        if n := table[i][j]:
            out.append((o1[i], o2[j]))
            total += n
        if j + 1 < len(o2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


class Nearest:
    """The k nearest entries seen so far of each of some queries, with a number that comes with each entry."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        with np.errstate(over="ignore"):
            self.square = (q**2).sum(1)
        self.limit = np.full(len(q), np.inf)
        #: query, distance and id of what is held, and the number; by query, nearest first
        self.row, self.near, self.name, self.mark = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray, mark: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Entries; ``asked``: which queries (rows) want which of them."""
        for at in range(0, len(self.q), QUERIES):
            part = slice(at, at + QUERIES)
            want = np.ones((len(self.q[part]), len(ids)), bool) if asked is None else asked[part]
            self._add(at, want, ids, x, mark)

    def _add(self, at: int, want: np.ndarray, ids: np.ndarray, x: np.ndarray, mark: np.ndarray) -> None:
        q, k = self.q[at : at + QUERIES], self.k
        # a product of matrices leaves few pairs, which are measured exactly
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x**2).sum(1)
            rough = square[None] - 2 * q @ x.T + self.square[at : at + QUERIES, None]
            slack = 1e-9 * (self.square[at : at + QUERIES] + square.max(initial=0)) + 1e-290
            limit = self.limit[at : at + QUERIES] ** 2
        tame = np.isfinite(rough).all()
        rough[~np.isfinite(rough)] = -np.inf  # out of range: to be measured
        rough[~want] = np.inf
        if want.shape[1] > k and tame:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        r, c = np.nonzero(want & ~(rough > (limit + slack)[:, None]))
        if not len(r):
            return
        d = np.empty(len(r))
        step = max(1, (1 << 20) // max(1, x.shape[1]))
        with np.errstate(over="ignore"):
            for a in range(0, len(r), step):
                d[a : a + step] = np.sqrt(((x[c[a : a + step]] - q[r[a : a + step]]) ** 2).sum(1))
        row, near, name, mark = r + at, d, ids[c], mark[c]
        ok = near <= self.limit[row]
        row, near, name, mark = (np.concatenate(p) for p in ((self.row, row[ok]), (self.near, near[ok]), (self.name, name[ok]), (self.mark, mark[ok])))
        order = np.lexsort((name, near, row))
        row, near, name, mark = row[order], near[order], name[order], mark[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        last = rank == k - 1
        self.limit[row[last]] = near[last]
        self.row, self.near, self.name, self.mark = row[keep], near[keep], name[keep], mark[keep]


def matrix(column) -> np.ndarray:
    """Rows of a column of equally long double arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, embedding: str, dim: int | None = None) -> tuple[DataFrame, int, int]:
    """``id, v`` of the vectors that take part, their length and number: key not null, of the length given (None: the
    commonest one; of equally common ones the longest), all components finite, not all zero."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    # one row for each length that occurs
    sizes = rows.where(F.size("v") == dim) if dim else rows
    size = sizes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.count_if(good).alias("good")).orderBy(F.desc("c"), F.desc("n")).first()
    dim = size.n if size else dim or 0
    return rows.where((F.size("v") == dim) & good), dim, size.good if size else 0


def _sample(rows: DataFrame, total: int, most: int, seed: int) -> list:
    """Some ``most`` of ``total`` rows, or all of fewer: each row is drawn by itself, so that no task orders any."""
    rows = rows if total <= most else rows.sample(0.95 * most / total, seed)
    return rows.collect()[:most]  # bounded: a binomial number about a twentieth below ``most``


def _brute(entries: DataFrame, queries: list, k: int) -> dict[int, list[int]]:
    """Cells of the k nearest entries of a bounded number of queries but the query's own, by comparison with every entry
    in blocks."""
    q = np.array([r.v for r in queries], np.float64)
    own = {(i, r.id) for i, r in enumerate(queries)}

    def of(batches):
        got = Nearest(q, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ENTRIES):
                part = batch.slice(at, ENTRIES)
                got.add(part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (got.row, got.name, got.near, got.mark)], ["q", "id", "d", "cell"])

    near = entries.select("id", "v", F.col("cell").cast("long")).mapInArrow(of, "q long, id long, d double, cell long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))  # k rows of each task
    out: dict[int, list[int]] = {}
    for r in near.withColumn("r", rank).where(F.col("r") <= k).collect():  # calibration queries times k
        if r.d or (r.q, r.id) not in own:
            out.setdefault(r.q, []).append(r.cell)
    return out


def grouped(counts: dict[int, int], per: int) -> list[tuple[int, int, int]]:
    """``(cell, first group, groups)`` of cells in ascending order, groups holding about so many entries; a cell of more
    has groups of its own."""
    out, group, held = [], 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > per:
            group, held = group + 1, 0
        span = -(-n // per)
        out.append((cell, group, span))
        group, held = (group + span, 0) if span > 1 else (group, held + n)
    return out


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding", recall: float = 0.95, centroids: int | None = None, seed: int = 7
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k nearest rows of ``vectors`` that were found, but
    its own; score is the Euclidean distance, ties go to the smaller key.

    A query's own row is one of its key and vector. Where rows repeat key and vector, each is a query with rows of its own,
    and the others are its neighbours at distance 0; rows of its key with another vector are its neighbours too. Vectors
    with a null key, null, of another length than the commonest, all zero, or with null or non-finite components take no
    part, nor do queries of another length than theirs. Fewer than k other rows: all of them. No vectors or no queries: no
    rows. Other columns are not read.

    ``centroids``: of each half; None: the root of a ``OCCUPANCY``-th of the number of vectors, within ``CENTROIDS``.
    The work is queries times the share of entries that a walk needs: where vectors have no structure, recall asks for a
    share of all entries, and the work of a share of the rows as queries grows with the square of the rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, dim, n = usable(vectors, key, embedding)
    if not n:
        return empty
    asked, _, asked_n = usable(queries, key, embedding, dim)
    if not asked_n:
        return empty
    x = np.array([r.v for r in _sample(rows, n, SAMPLE, seed)], np.float64)
    least, most = CENTROIDS
    centroids = centroids or min(max(least, math.ceil(math.sqrt(n / OCCUPANCY))), most)
    h = -(-dim // 2)
    books = codebook(x[:, :h], centroids, seed), codebook(x[:, h:], centroids, seed + 1)
    shape = len(books[0]), len(books[1])

    def coded(batches):
        for batch in batches:
            d1, d2 = halves(matrix(batch.column(1)), books)
            cell = d1.argmin(1) * shape[1] + d2.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    entries = cut(rows.mapInArrow(coded, "id long, v array<double>, cell int"))
    # one row for each pair of centroids at most: bounded by the codebooks
    counts = {r.cell: r.n for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    held = np.zeros(shape, np.int64)
    for cell, m in counts.items():
        held[cell // shape[1], cell % shape[1]] = m
    asked = cut(asked.withColumn("query", F.xxhash64("id", "v")))
    enough = _enough(entries, _sample(asked.select("id", "v"), asked_n, CALIBRATION, seed), k, recall, books, held)
    tasks = partitions(spark)
    groups = grouped(counts, max(1, min(GROUP, -(-n // tasks))))
    n_groups = groups[-1][1] + groups[-1][2]
    spans = np.zeros((2, shape[0] * shape[1]), np.int64)  # of each cell its first group and their number
    for cell, first, span in groups:
        spans[:, cell] = first, span

    def probes(batches):
        """A query's rows: one for each group that its walk enters, with the cells there."""
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                d1, d2 = halves(matrix(one.column(1)), books)
                cells = np.array([a * shape[1] + b for a, b in walk(d1[0], d2[0], held, enough)], np.int32)
                span, first = spans[1][cells], spans[0][cells]
                cells, group = np.repeat(cells, span), np.repeat(first - np.cumsum(span) + span, span) + np.arange(span.sum())
                order = np.argsort(group, kind="stable")
                cells, group = cells[order], group[order]
                into, starts = np.unique(group, return_index=True)
                out = one.take(pa.array(np.zeros(len(into), np.int64)))
                lists = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(cells)], pa.int32()), pa.array(cells))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(into.astype(np.int32)), lists], ["id", "v", "query", "grp", "cells"])

    # rows that are equal are searched for once
    once = asked.groupBy("id", "v").agg(F.first("query").alias("query")).repartition(tasks, "query")
    sent = once.mapInArrow(probes, "id long, v array<double>, query long, grp int, cells array<int>")
    sent = sent.select("grp", F.lit(1).alias("side"), "id", "v", "cells", "query")
    where = spark.createDataFrame(groups, "cell int, first int, span int")  # bounded by the codebooks
    # rows of a checkpoint, whose numbers stay the same if a task runs again
    placed = entries.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(where), "cell")
    salt = F.pmod(F.xxhash64("row"), F.col("span")).cast("int")
    placed = placed.select((F.col("first") + salt).alias("grp"), F.lit(0).alias("side"), "id", "v", F.array("cell").alias("cells"), F.lit(0).cast("long").alias("query"))
    met = met_in_groups(placed, sent, n_groups)
    most = k + 1  # the query's own row among them

    def rerank(batches):
        """Of each group's queries the nearest entries there; its entries come first and are held."""
        group, parts, entries = None, [], None

        def found(part):
            ids, x, cell, blocks = entries
            near, wanted = Nearest(matrix(part.column(3)), most), by_cell(part.column(4))
            for at, of in blocks:
                here = [c for c in of if c in wanted]
                if here:
                    some = slice(at, at + ENTRIES)
                    mask = np.zeros((part.num_rows, len(ids[some])), bool)
                    for c in here:
                        mask[np.ix_(wanted[c], np.flatnonzero(cell[some] == c))] = True
                    near.add(ids[some], x[some], np.zeros(len(ids[some]), np.int64), mask)
            asked, names = part.column(2).to_numpy(), part.column(5).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (asked[near.row], names[near.row], near.name, near.near)], ["query_id", "query", "vec_id", "score"])

        for batch in batches:
            of_group, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(of_group * 2 + side)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if of_group[a] != group:
                    group, parts, entries = of_group[a], [], None
                if not side[a]:
                    parts.append((part.column(2).to_numpy(), matrix(part.column(3)), part.column(4).flatten().to_numpy()))
                    continue
                if entries is None:
                    if not parts:
                        continue  # a cell's share of no entries
                    ids, x, cell = (np.concatenate(c) for c in zip(*parts, strict=True))
                    entries, parts = (ids, x, cell, [(at, np.unique(cell[at : at + ENTRIES]).tolist()) for at in range(0, len(ids), ENTRIES)]), []
                for at in range(0, part.num_rows, QUERIES):
                    yield found(part.slice(at, QUERIES))

    found = met.mapInArrow(rerank, "query_id long, query long, vec_id long, score double")
    by = Window.partitionBy("query_id", "query")  # k + 1 rows of each group
    found = found.withColumn("rank", F.row_number().over(by.orderBy("score", "vec_id"))).where(F.col("rank") <= most)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("rank"))).over(by)
    found = found.withColumn("own", F.coalesce(own, F.lit(most))).where("rank <> own")
    found = found.select("query_id", "query", F.when(F.col("rank") > F.col("own"), F.col("rank") - 1).otherwise(F.col("rank")).cast("int").alias("rank"), "vec_id", "score")
    # a row for each row that asks
    rows = asked.select(F.col("id").alias("query_id"), "query")
    return rows.join(found, ["query_id", "query"]).select("query_id", "rank", "vec_id", "score")


def met_in_groups(entries: DataFrame, queries: DataFrame, n_groups: int) -> DataFrame:
    """Rows of both by group, entries (by cell) before queries; each entry comes once."""
    return entries.unionAll(queries).repartitionById(n_groups, F.col("grp")).sortWithinPartitions("grp", "side", "cells")


def by_cell(cells: pa.Array) -> dict[int, np.ndarray]:
    """The queries (rows) that want each cell."""
    row = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy())
    flat = pc.list_flatten(cells).to_numpy().astype(np.int64)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    names, starts = np.unique(flat, return_index=True)
    return dict(zip(names.tolist(), np.split(row, starts[1:]), strict=True))


def _enough(entries: DataFrame, queries: list, k: int, recall: float, books: tuple, held: np.ndarray) -> float:
    """How many entries the walks must hold so that calibration queries find so much of their neighbours."""
    if not queries:
        return 0
    need = []
    d1, d2 = halves(np.array([r.v for r in queries], np.float64), books)
    for i, found in _brute(entries, queries, k + 1).items():
        passed, total = {}, 0
        for a, b in walk(d1[i], d2[i], held, math.inf):
            passed[a * held.shape[1] + b] = total + 1  # the walk stops once it holds as many as before and one
            total += int(held[a, b])
        need += [passed[c] for c in found]
    if not need:
        return k + 1
    need.sort()
    return max(4 * k, need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])
