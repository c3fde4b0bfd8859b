"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Fingerprints are made inside tasks. Distinct fingerprints are dealt into tiles of like population count
(and, where sizes matter, of like size); two tiles meet only if their counts can differ by no more than the
radius. A meeting is one numpy exclusive-or and bit count over both tiles, and gives back a spanning forest of
the links, not the links themselves, so a large group of copies costs rows in proportion to its size.
Components of the forests are found by star passes. No fingerprint, link or component comes to the driver;
it sees one row for each population count and size band.

Where texts must be similar to a degree (``similar``), the bits only choose candidates, with a margin; groups of
candidates are then linked on their distinct shingles.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukspark.llm.common import cut, free_name, lean, partitions, widened
from soukspark.llm.components import components

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once, and fingerprint pairs compared at once.
_BLOCK, _PAIRS = 1 << 15, 1 << 18
#: Distinct fingerprints in a tile, at least and at most.
TILE = (1 << 13, 1 << 17)
#: Standard deviations of the differing bits that candidates are allowed beyond the mean.
MARGIN = 5
#: Shingles in a block of a group of candidates, about.
BLOCK_SHINGLES = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each space-joined window of ``words`` words of the lower-cased (A-Z) text; of all words,
    if there are fewer; none without words."""
    parts = (text or "").encode().translate(_LOWER).split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((of(line[s:e], SEED) for s, e in pairs), np.uint64, n - words + 1)


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian bytes; a bit is 1 if more than half of the hashes have it."""
    total = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        h = hashes[at : at + _BLOCK]
        wide = np.stack([h if not k else _spread(h, k) for k in range(bits // 64)], 1) if bits > 64 else h[:, None]
        total += np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, text: str, words: int, bits: int, distinct: bool, keep: list[str]) -> DataFrame:
    """``keep`` and ``fingerprint`` (lowercase hex) and ``shingles`` (how many were counted)."""
    schema = widened(docs.select(*keep), "fingerprint string, shingles long")

    def of(batches):
        for batch in batches:
            hexes, sizes = [], []
            for x in batch.column(len(keep)):
                h = shingle_hashes(x.as_py(), words)
                h = np.unique(h) if distinct else h
                hexes.append(fingerprint(h, bits).hex())
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(hexes, pa.string()), pa.array(sizes, pa.int64())], schema.fieldNames())

    return docs.select(*keep, F.col(text).alias("_of_text")).mapInArrow(lean(of), schema)


class Forest:
    """Links among n items, kept as the smallest index of each group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, r: np.ndarray, c: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[r], label[c]
            new = a != b
            if not new.any():
                break
            r, c, a, b = r[new], c[new], a[new], b[new]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
        self.label = label


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, near=None) -> np.ndarray:
    """Group labels of the rows of ``a`` then ``b`` (words of fingerprints) under links of ``radius`` bits or
    fewer; ``b`` None: links within ``a``. near(rows, columns, distances): which of these links to keep."""
    other, shift = (a, 0) if b is None else (b, len(a))
    forest = Forest(len(a) + (0 if b is None else len(b)))
    step = max(1, _PAIRS // max(1, len(other)))
    for at in range(0, len(a), step):
        left, right = a[at : at + step], other[at:] if b is None else other
        d = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
        if a.shape[1] > 1:
            d = d.astype(np.uint16)
            for k in range(1, a.shape[1]):
                d += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
        hit = d <= radius
        if not hit.any():
            continue
        r, c = np.nonzero(hit)
        i, j = r + at, c + (at if b is None else shift)
        ok = forest.label[i] != forest.label[j]
        if near is not None and ok.any():
            ok[ok] = near(i[ok], j[ok], d[r[ok], c[ok]])
        forest.link(i[ok], j[ok])
    return forest.label


def differing(n: int, m: int, both: int) -> float:
    """The probability that a bit differs between sets of n and m hashes that share so many."""
    chance = lambda k: np.array([math.comb(k, x) / 2**k for x in range(k + 1)])
    shared = np.arange(both + 1)

    def one(size):
        own = size - both
        tail = np.append(np.cumsum(chance(own)[::-1])[::-1], 0)
        return tail[np.clip(size // 2 + 1 - shared, 0, own + 1)]

    a, b = one(n), one(m)
    return float((chance(both) * (a * (1 - b) + b * (1 - a))).sum())


@lru_cache
def reach(bits: int, similarity: float, exact: int = 100) -> tuple[int, ...]:
    """The most differing bits of candidates, by the size of the smaller set (the last: that size or more): the
    mean at the similarity and ``MARGIN`` standard deviations. -1 where only equal sets are so similar.

    Small sets are counted out, since ties of even sizes move the mean by up to a quarter.
    """
    found = []
    for n in range(exact + 1):
        most = -1.0
        for m in range(n, int(n / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            # of sets of one size, those that are not equal share one less at most
            both = min(both, n - 1) if n == m and both == n else both
            if both < 0 or both < similarity * (n + m - both) - 1e-9:
                continue
            most = max(most, differing(n, m, both))
        found.append(-1 if most < 0 else most)
    found[-1] = max(found[-1], math.acos(2 * similarity / (1 + similarity)) / math.pi + 1 / exact / 2)
    return tuple(-1 if x < 0 else math.ceil(bits * x + MARGIN * math.sqrt(bits * x * (1 - x))) for x in found)


def links(items: DataFrame, bits: int, radius: int, similarity: float | None = None, candidates: bool = False) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (hex) that span every group of linked ones.

    ``items``: ``fingerprint`` distinct, ``shingles``. With ``similarity``, two also need an estimated Jaccard
    similarity of so much, from the differing bits and both sizes, and sizes that allow it. ``candidates``: no more
    bits than ``reach`` instead of the estimate; a fingerprint may then come more than once.
    """
    limit = np.array(reach(bits, similarity)) if candidates else None
    spark = items.sparkSession
    width = max(1, radius // 4)
    pop = F.bit_count(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"))
    for k in range(1, bits // 32):
        pop = pop + F.bit_count(F.conv(F.substring("fingerprint", 8 * k + 1, 8), 16, 10).cast("long"))
    base = 1 / similarity if similarity else 0
    band = F.floor(F.log(F.greatest("shingles", F.lit(1))) / math.log(base)).cast("int") if similarity else F.lit(0)
    items = items.select("fingerprint", "shingles", F.floor(pop / width).cast("int").alias("pop"), band.alias("band"))
    # one row for each population count and size band: at most bits + 1 by about 100 rows, whatever the input
    cells = {(r.band, r.pop): r.n for r in items.groupBy("band", "pop").agg(F.count("*").alias("n")).collect()}
    total = sum(cells.values())
    size = min(max(TILE[0], total // 256), TILE[1])
    blocks = {k: -(-n // size) for k, n in cells.items()}
    first, pairs, work = {}, [], 0
    for k in sorted(cells):
        first[k] = sum(blocks[x] for x in first)
    for (band1, pop1), n1 in cells.items():
        for band2 in (band1, band1 + 1) if similarity else (band1,):
            for pop2 in range(pop1 - radius // width - 1, pop1 + radius // width + 2):
                k2 = (band2, pop2)
                if k2 < (band1, pop1) or k2 not in cells or (abs(pop1 - pop2) - 1) * width + 1 > radius and pop1 != pop2:
                    continue
                pairs.append((first[band1, pop1], blocks[band1, pop1], first[k2], blocks[k2]))
                work += n1 * cells[k2]
    shape = "fa int, na int, fb int, nb int"
    met = spark.createDataFrame(pairs, shape) if pairs else spark.createDataFrame([], shape)
    met = met.select("fa", "fb", F.explode(F.sequence(F.col("fa"), F.expr("fa + na - 1"))).alias("x"), "nb")
    met = met.select("x", F.explode(F.sequence(F.col("fb"), F.expr("fb + nb - 1"))).alias("y")).where("x <= y")
    met = met.select(F.expr("x * 4294967296L + y").alias("pair"), "x", "y")
    where = spark.createDataFrame([(*k, first[k], blocks[k]) for k in cells], "band int, pop int, f int, n int")
    # cells: bounded as above
    dealt = items.join(F.broadcast(where), ["band", "pop"]).select(F.expr("f + cast(pmod(xxhash64(fingerprint), n) as int)").alias("tile"), F.unhex("fingerprint").alias("fp"), F.col("shingles").cast("int").alias("n"))
    tiles = cut(dealt.groupBy("tile").agg(F.collect_list(F.struct("fp", "n")).alias("rows")))
    sides = met.select("pair", F.col("x").alias("tile"), F.lit(0).alias("side")).unionAll(met.where("x < y").select("pair", F.col("y").alias("tile"), F.lit(1).alias("side")))
    tasks = max(partitions(spark), work // 4_000_000_000)
    sides = sides.join(tiles, "tile").select("pair", "side", "rows").repartition(tasks, "pair").sortWithinPartitions("pair", "side")

    def parts(rows):
        fp, n = rows.values.flatten()
        words = np.frombuffer(b"".join(fp.to_pylist()), ">u8").astype(np.uint64).reshape(len(fp), -1)
        return words, n.to_numpy(zero_copy_only=False).astype(np.float64)

    def meet(a, b):
        (wa, sa), (wb, sb) = a, b or (None, np.zeros(0))
        sizes = np.concatenate((sa, sb))

        def near(i, j, d):
            n, m = sizes[i], sizes[j]
            if candidates:
                small = np.minimum(n, m)
                return (d <= limit[np.minimum(small, len(limit) - 1).astype(np.int64)]) & (small >= similarity * np.maximum(n, m) - 1e-9)
            both = np.cos(math.pi * d / bits) * np.sqrt(n * m)
            # sets whose sizes differ by more cannot be so similar
            return (both >= similarity * (n + m - both) - 1e-9) & (np.minimum(n, m) >= similarity * np.maximum(n, m))

        label = compare(wa, wb, radius, near if similarity else None)
        moved = np.flatnonzero(label != np.arange(len(label)))
        every = wa if wb is None else np.concatenate((wa, wb))
        name = lambda k: [x.astype(">u8").tobytes().hex() for x in every[k]]
        return pa.RecordBatch.from_arrays([pa.array(name(moved), pa.string()), pa.array(name(label[moved]), pa.string())], ["a", "b"])

    def every(batches):
        held = None  # the first side of the pair whose second has not come yet
        for batch in batches:
            for pair, side, rows in zip(*(batch.column(k) for k in range(3)), strict=True):
                pair = pair.as_py()
                if held and held[0] != pair:
                    yield meet(held[1], None)
                    held = None
                if side.as_py():
                    yield meet(held[1], parts(rows))
                    held = None
                else:
                    held = (pair, parts(rows))
        if held:
            yield meet(held[1], None)

    return sides.mapInArrow(lean(every), "a string, b string")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, bits: int = 256, radius: int | None = None, similarity: float | None = 0.8, distinct: bool = True
) -> DataFrame:
    """``key``, ``fingerprint`` and ``component_id``, one row for each row of ``docs``.

    Texts link at ``radius`` or fewer differing bits, or, with ``similarity``, if their estimated Jaccard
    similarity on distinct shingles is so much. component_id is the smallest non-null key reachable over
    links; null if there is none. Empty and null texts share the fingerprint of no bits and link like others.
    Repeated rows and keys stay; an empty table gives an empty table; columns but the two named are not read.
    """
    if radius is None:
        # the bits at which texts of equal size reach the similarity
        radius = int(bits / math.pi * math.acos(2 * similarity / (1 + similarity)))
    made = cut(fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", words, bits, distinct, ["_key"]))
    items = made.groupBy("fingerprint").agg(F.min("_key").alias("least"), F.max("shingles").alias("shingles"))
    found = components(links(items, bits, radius, similarity))
    named = items.join(found, items.fingerprint == found.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # both written before the last join, whose large side adaptive execution can then split at a hot fingerprint
    of = cut(cut(named.select("fingerprint", "root")).join(least, "root").select("fingerprint", "component_id"))
    return made.select(F.col("_key").alias(key), "fingerprint").join(of, "fingerprint").select(key, "fingerprint", "component_id")


def classes(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``_key``, ``_text_hash``, ``fingerprint``, ``shingles`` and ``set``, a digest of the distinct shingles."""
    rows = docs.select("_key", F.xxhash64("_text").alias("_text_hash"), "_text")
    schema = widened(rows.drop("_text"), "fingerprint string, shingles long, set string")

    def of(batches):
        for batch in batches:
            prints, sizes, sets = [], [], []
            for x in batch.column(2):
                h = np.unique(shingle_hashes(x.as_py(), words))
                prints.append(fingerprint(h, bits).hex())
                sizes.append(len(h))
                sets.append(xxhash.xxh128_hexdigest(h.tobytes(), SEED))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.string()), pa.array(sizes, pa.int64()), pa.array(sets, pa.string())], schema.fieldNames())

    return rows.mapInArrow(lean(of), schema)


def alike(sets: list[np.ndarray], first: int, similarity: float) -> np.ndarray:
    """Group labels of distinct non-empty sets under links of at least that Jaccard similarity. ``first``: sets of
    the first side, which alone are compared with the others; 0: all are compared."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    forest, flag = Forest(len(sets)), np.zeros(ids.max() + 1, np.int32)
    for i in range(first or len(sets)):
        at = first or i + 1
        fit = np.minimum(n[at:], n[i]) >= similarity * np.maximum(n[at:], n[i]) - 1e-9
        j = at + np.flatnonzero(fit & (forest.label[at:] != forest.label[i]))
        if not len(j):
            continue
        own = ids[starts[i] : starts[i] + n[i]]
        flag[own] = 1
        if len(j) < 9:
            both = np.array([flag[ids[starts[k] : starts[k] + n[k]]].sum() for k in j])
        else:
            both = np.add.reduceat(flag[ids[starts[at] :]], starts[at:] - starts[at])[j - at]
        flag[own] = 0
        j = j[both >= similarity * (n[i] + n[j] - both) - 1e-9]
        forest.link(np.full(len(j), i), j)
    return forest.label


def checked(members: DataFrame, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` that span every group of sets with links of at least that similarity; ``done``: they all
    end at the group's root already, since its candidates are one block.

    ``members``: ``root`` (their group of candidates), ``block`` of ``blocks`` of the group, ``set`` and its sorted
    shingles as bytes (``hashes``). Every two blocks of a group meet.
    """
    met = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set", "hashes", "blocks")
    met = met.repartition(partitions(members.sparkSession), "root", "x", "y").sortWithinPartitions("root", "x", "y", "block", "set")

    def meet(held, done):
        if len(held) < 2:
            return None
        names, low = list(held), min(b for b, _ in held.values())
        # as many as all, if it is one block with itself or the other is empty
        first = sum(b == low for b, _ in held.values())
        label = alike([np.frombuffer(h, np.uint64) for _, h in held.values()], first % len(names), similarity)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in moved], pa.string()), pa.array([names[k] for k in label[moved]], pa.string()), pa.array([done] * len(moved), pa.bool_())], ["a", "b", "done"])

    def every(batches):
        at, held, done = None, {}, False
        for batch in batches:
            for root, x, y, block, name, h, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, x, y) != at:
                    if held and (out := meet(held, done)) is not None:
                        yield out
                    at, held, done = (root, x, y), {}, blocks == 1
                held[name] = (block, h)
        if held and (out := meet(held, done)) is not None:
            yield out

    return met.mapInArrow(lean(every), "a string, b string, done boolean")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, bits: int = 256, similarity: float = 0.8) -> DataFrame:
    """``key`` and ``component_id``, one row for each row of ``docs``.

    Texts link if the Jaccard similarity of their distinct shingles is so much. The bits of fingerprints choose
    candidates: a link is missed with a probability of about 10^-6 at the limit, less above it, and none is wrong.
    component_id as in ``near_duplicates``. Texts without words are alike.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    made = cut(classes(rows, words, bits))
    one = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_text_hash"))
    items = cut(made.groupBy("set").agg(F.min("_key").alias("least"), F.min("fingerprint").alias("fingerprint"), F.max("shingles").alias("shingles"), one.alias("one")))
    limit = reach(bits, similarity)
    smallest = next(n for n, x in enumerate(limit) if x >= 0)
    large = items.where(F.col("shingles") >= smallest)
    near = components(links(large.select("fingerprint", "shingles"), bits, max(limit), similarity, candidates=True))
    placed = large.join(near, large.fingerprint == near.node, "left").select("set", "one", "shingles", F.coalesce("root", "fingerprint").alias("root"))
    groups = placed.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("n > 1")
    members = placed.join(groups, "root").select("set", "one", "root", "blocks", F.expr("cast(pmod(xxhash64(set), blocks) as int)").alias("block"))
    # a text of each set again, for its shingles; rows that repeat key and text give a set more than once
    texts = rows.withColumn("_text_hash", F.xxhash64("_text"))
    found = members.join(texts, (F.col("one._text_hash") == F.col("_text_hash")) & F.col("one._key").eqNullSafe(F.col("_key")))
    found = found.select("root", "block", "blocks", "set", "_text")

    def hashes(batches):
        for batch in batches:
            out = [np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["root", "block", "blocks", "set", "hashes"])

    sets = found.mapInArrow(lean(hashes), "root string, block int, blocks int, set string, hashes binary")
    edges = cut(checked(sets, similarity))
    same = edges.where("done").select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(components(edges.where("not done")))
    named = items.join(same, items.set == same.node, "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(cut(named.select("set", "root")).join(least, "root").select("set", "component_id"))
    return made.select(F.col("_key").alias(key), "set").join(of, "set").select(key, "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows that another row of their group stands for: the one with the smallest key
    stays. Rows with a null key stay. Of rows that repeat a key, all stay or go together."""
    name, own = free_name(docs, "component_id"), free_name(docs, "key")
    got = similar(docs.select(key, text), text, key, **how).where(f"`{key}` <> component_id").select(F.col(key).alias(own)).distinct()
    return docs.join(got, docs[key] == got[own], "left_anti")
