"""Centroid clustering, substring dedup and the conversation trie against brute force."""

import hashlib
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import public_tokenizers
from soukspark.llm import centroids, components, prefixtree, queries, sentencepieces, substrings

SMALL = "/root/testdata/sf0.001"


# -- centroid clustering -------------------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, salt, dim, scale):
    def good(v):
        return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if good(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else old for vs, old in zip(own, c, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def sort(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_walks_find_the_nearest_centroid_and_the_smaller_of_equal_ones():
    rng = np.random.default_rng(5)
    for dim, k, wide in ((1, 1, 3), (1, 7, 3), (2, 9, 2), (3, 40, 4), (64, 40, 200), (5, 3, 1 << 25)):
        c, x = rng.integers(-wide, wide + 1, (k, dim)), rng.integers(-wide, wide + 1, (1500, dim))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        number, best = centroids.Lists(c).nearest(x)
        assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def test_clusters_equal_plain_rounds_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4) * 0.1]) for k in range(300)]
    rows += [(7, rows[7][1])] * 5 + [(None, [0.1] * 4), (None, None), (301, None), (302, []), (303, [1.0] * 3), (304, [None, 1.0, 1.0, 1.0])]
    rows += [(305, [float("nan")] * 4), (306, [float("inf")] * 4), (307, [0.0] * 4), (8, [0.5] * 4)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    for n, k in ((len(rows), 11), (5, 40), (0, 3)):
        got, c = centroids.cluster(df.limit(n) if n else df.limit(0), k, 5, dim=4, salt="2:")
        want, plain = plain_kmeans(rows[:n], k, 5, "2:", 4, 256)
        assert sort(got.collect()) == sort(want) and c == plain


def test_the_query_over_a_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want, c = plain_kmeans([(r.vec_id, r.embedding) for r in rows.collect()], 40, 5, "2:", 64, 256)
    total = {}
    for _, k, d in want:
        total[k] = total.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    full = [(i, k, d, total[k], sum(total.values()), sha[k]) for i, k, d in want]
    assert sort(queries.op12_centroids(spark, SMALL).collect()) == sort(full)


# -- substring dedup -----------------------------------------------------------------------------------------------


def plain_substrings(texts, size):
    words = [(t or "").encode().split() for t in texts]
    n = {}
    for w in words:
        for p in range(len(w) - size + 1):
            n[tuple(w[p : p + size])] = n.get(tuple(w[p : p + size]), 0) + 1
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            if n[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = True
        out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    long, k = [size if g else 0 for _, g, _ in out], 2 * size
    while True:
        n = {}
        starts = [[p for p in range(len(w) - k + 1) if substrings.marked(w[p])] for w in words]
        for w, ps in zip(words, starts, strict=True):
            for p in ps:
                n[tuple(w[p : p + k])] = n.get(tuple(w[p : p + k]), 0) + 1
        hit = [any(n[tuple(w[p : p + k])] > 1 for p in ps) for w, ps in zip(words, starts, strict=True)]
        if not any(hit):
            return [(*r, x) for r, x in zip(out, long, strict=True)]
        long, k = [k if h else x for h, x in zip(hit, long, strict=True)], 2 * k


def odd_texts(seed):
    rng = np.random.default_rng(seed)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 900, n))

    shared, line = prose(50), prose(12)
    texts = [None, "", " \n\t", "a", "a " * 34, "b " * 36, "one two " * 400, prose(9000), shared, f"{shared}\n{prose(40)}", f"{prose(7)} {shared.replace(' ', '  ')}"]
    texts += [f"{prose(30)} {line} {prose(30)}" for _ in range(20)] + [prose(300)] * 3 + [prose(35)] * 2 + [prose(34)] * 2
    base = prose(400).split()
    for _ in range(12):
        near = list(base)
        for p in rng.integers(0, len(near), 4):
            near[p] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(near))
    return texts + [f"{prose(20)} {' '.join(base[:60])} {prose(20)} {' '.join(base[:60])}", "é ü " * 50, "z\x0by\x0cx " * 30]


def test_substrings_equal_brute_force(spark, monkeypatch):
    for seed, size in ((0, 35), (1, 35), (2, 8), (3, 1), (4, 2)):
        monkeypatch.setattr(substrings, "ASK", 300 if seed % 2 else 1 << 20)
        texts = odd_texts(seed)
        df = spark.createDataFrame([(k % 40 if k % 7 else None, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(5)
        rows = substrings.dedup(df, size=size, also={"own": F.col("text")}).collect()
        got = {}
        for r in rows:
            removed = [x for s in r.spans for x in range(s.start, s.start + s.words)]
            words = (r.own or "").encode().split()
            assert len(removed) == r.n_removed and (r.kept is None) == (not removed)
            kept = b" ".join(w for k, w in enumerate(words) if k not in set(removed)).decode()
            assert r.kept in (None, kept)
            got.setdefault(r.own, []).append((r.n_words, r.n_removed, kept, r.longest))
        want = {}
        for t, r in zip(texts, plain_substrings(texts, size), strict=True):
            want.setdefault(t, []).append(r)
        assert got == want
    assert substrings.dedup(df.limit(0)).count() == 0


def test_longest_repeats_at_every_word(spark, monkeypatch):
    """A repeat of 80 words without a marked word; with all words looked at, ``longest`` is that of brute force."""
    plain = [w for w in (f"p{k}" for k in range(400)) if not substrings.marked(w.encode())]
    texts = [*odd_texts(5), " ".join(plain[:80]), " ".join([*plain[100:110], *plain[:80]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = {r.doc_id: r.longest for r in substrings.dedup(df).collect()}
    rows = {r.doc_id: (r.n_words, r.n_removed, r.longest) for r in substrings.dedup(df, mark=None).collect()}
    monkeypatch.setattr(substrings, "marked", lambda word: True)
    want = plain_substrings(texts, 35)
    assert rows == {k: (n, gone, long) for k, (n, gone, _, long) in enumerate(want)}
    last = len(texts) - 1
    assert (some[last], rows[last][2]) == (35, 70)


def test_no_window_repeats(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(df).select("doc_id", "n_words", "n_removed", "longest").collect())) == [(1, 100, 0, 0), (2, 0, 0, 0)]


# -- conversation trie ---------------------------------------------------------------------------------------------


def plain_rebuilt(rows):
    own = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[:2], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    return prefixtree.tree(queries.rebuilt(prefixtree.turns(df.repartition(3))))


def test_trie_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["", None, "hi", "é" * 5, "long " * 30]
    rows = []
    for c in [*range(60), 100, 101, 205, 206, 305, -5, -100, 10**12]:
        for n in range(int(rng.integers(0, 12))):
            rows.append((int(c), n if rng.random() < 0.9 else None, ["user", "bot", None][rng.integers(0, 3)], words[rng.integers(0, 5)] if n else "same start"))
    rows += [(7, 3, "user", "again")] * 3 + [(None, 1, "user", "x")] + [(500, n * 3000, "user", f"{n % 3}") for n in range(40)] + [(501, n, "user", f"{n % 3}") for n in range(40)]
    for segment in (4096, 5):
        monkeypatch.setattr(prefixtree, "SEGMENT", segment)
        assert sort(trie_of(spark, rows).collect()) == sort(plain_trie(plain_rebuilt(rows)))


def test_tries_without_turns(spark):
    assert trie_of(spark, [(None, 0, "a", "b")]).count() == 0
    # crc32("3") % 6 is 5 and there is no conversation 0: nothing is left of its one turn
    none = hashlib.sha256(b"3").hexdigest()
    h = zlib.crc32(b"3") % 6
    got = list(map(tuple, trie_of(spark, [(3, 0, "a", "b")]).collect()))
    assert h > 0 and got == [(3, 0, None, 1, 0, 1, 0, none)]


def test_the_trie_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sort(queries.op11_prefix_trie(spark, SMALL).collect()) == sort(plain_trie(plain_rebuilt(rows)))


# -- components ----------------------------------------------------------------------------------------------------


def test_the_mark_of_many_edges_does_not_overflow(spark):
    """As many edges as made a sum of 40 bits each overflow."""
    edges = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components._mark(edges)
    assert got[0] == 20_000_000 and got == components._mark(edges) and got != components._mark(edges.where("a <> 77"))


# -- long parts in SentencePiece sampling --------------------------------------------------------------------------


def test_a_long_run_of_one_letter_is_sampled_in_little_memory():
    lattice = sentencepieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    text, seeds = "a" * 300_000, np.array([5], np.uint64)
    tracemalloc.start()
    ids, count = sentencepieces.encode(lattice, pa.array([text]), seeds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    names = {k: n for n, k in lattice.ids.items()}
    assert "".join(names[k] for k in ids.tolist()) == sentencepieces.MARK + text and count[0] == len(ids)
    # under 80 bytes a character, so 5 million of them stay under 400 MB
    assert peak < 80 * len(text)
    # blocks of noise of any length draw alike
    short, block = text[:5000], sentencepieces._BLOCK
    try:
        drawn = []
        for size in (7, block):
            sentencepieces._BLOCK = size
            drawn.append(sentencepieces.encode(lattice, pa.array([short]), seeds)[0].tolist())
    finally:
        sentencepieces._BLOCK = block
    assert drawn[0] == drawn[1]
