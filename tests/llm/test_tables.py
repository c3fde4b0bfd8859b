"""Sharding, neighbours, URLs, WARC files, components and the pipeline."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from soukspark.llm import ann, components, queries, sentencepieces, sharding, urlfilter, warc

SMALL = "/root/testdata/sf0.001"


def plain_jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), 256, 0xDEADBEEF, *map(int, np.random.default_rng(0).integers(-(2**62), 2**62, 500))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in ([1, 2], [40, 41], [1000, 1001]):
        got = df.select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()
        assert all(tuple(r.s) == tuple(plain_jump(r.k, n) for n in shards) for r in got)


def test_shards(spark):
    rows = [(k, "t", "clash", 0) for k in range(3000)] + [(None, None, None, None)] * 3 + [(7, "same", None, 1)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    out = sharding.assign(df, 40)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[-3:] == ["_shard", "grown_shard", "_slot"]
    slots = {}
    for r in got:
        slots.setdefault(r._shard, []).append(r._slot)
        assert r.grown_shard in (r._shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(df.limit(0), 40).count() == 0
    names = sharding.assign(spark.createDataFrame([("a",), (None,)], "name string"), 5, "name").collect()
    assert all(0 <= r.shard < 5 for r in names)


def test_write_shards(spark, tmp_path):
    df = sharding.assign(spark.range(200).withColumnRenamed("id", "doc_id"), 4)
    sharding.write_shards(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 200


# -- neighbours ----------------------------------------------------------------------------------------------------


def plain_search(ids, x, query, k):
    order = sorted((math.dist(x[i], x[query]), ids[i]) for i in range(len(ids)) if ids[i] != ids[query])
    return order[:k]


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 4
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    x[100:130] = x[100]  # ties
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), centroids=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 3000, 100):
        want = plain_search(range(3000), x, q, 10)
        found = sorted(got[q])
        assert [r[0] for r in found] == list(range(1, 11))
        assert all(abs(s - math.dist(x[q], x[v])) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v in want} & {v for _, v, _ in found})
        total += 10
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 111))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_given_vectors(spark, sf):
    where = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {(r.query_id, r.vec_id) for r in queries.op3_ann(spark, where).collect()}
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want |= {(ids[i], v) for v in ids[[j for j in np.lexsort((ids, d)) if j != i][:10]]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.5]), (7, [1.0, 2.5]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df.where("vec_id in (0, 1, 4)")).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 0.5), (0, 2, 7, 0.5)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_neighbours_of_repeated_queries(spark):
    """A row is not its own neighbour, but an equal row is, and so is another vector under its key."""
    rows = [(0, [0.0, 1.0])] * 2 + [(k, [float(k), 1.0]) for k in range(1, 30)] + [(100, [5.0, 1.0]), (100, [20.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("clash")).withColumn("cell", F.lit(1))
    got = sorted(tuple(r) for r in ann.search(df, df.where("vec_id = 0")).collect())
    one = [(0, k + 1, k, float(k)) for k in range(6)] + [(0, 7, 100, 5.0)] + [(0, k + 2, k, float(k)) for k in (6, 7, 8)]
    assert got == sorted(one * 2)
    two = sorted((r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id = 100"), 2).collect())
    assert two == [(1, 5), (1, 20), (2, 4), (2, 19)]
    few = spark.createDataFrame([(100, [5.0, 1.0]), (100, [20.0, 1.0]), (1, [50.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(few, few.where("vec_id % 100 = 0"), 10).collect())
    assert got == [(100, 1, 100, 15.0), (100, 1, 100, 15.0), (100, 2, 1, 30.0), (100, 2, 1, 45.0)]
    # more equal rows of smaller keys than neighbours asked for
    tied = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(20)], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in ann.search(tied, tied.where("vec_id = 19"), 10).collect()) == list(range(10))


def test_neighbours_of_one_component_and_of_huge_ones(spark):
    one = spark.createDataFrame([(k, [float(k * k)]) for k in range(1, 8)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(one, one.where("vec_id = 3"), 3).collect())
    assert got == [(3, 1, 2, 5.0), (3, 2, 4, 7.0), (3, 3, 1, 8.0)]
    huge = spark.createDataFrame([(k, [1e308 * (-1) ** k, float(k)]) for k in range(6)] + [(9, [1e-200, 0.0]), (10, [2e-200, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(huge, huge.where("vec_id in (0, 9)"), 3).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 4, 4.0), (0, 3, 1, math.inf), (9, 1, 10, 0.0), (9, 2, 0, math.inf), (9, 3, 1, math.inf)]


def test_neighbours_over_many_groups(spark, monkeypatch):
    """A cell with a third of all vectors is dealt over groups; however many queries there are, entries go there once."""
    rng = np.random.default_rng(2)
    x = np.concatenate((np.tile(rng.normal(size=6), (300, 1)), rng.normal(size=(600, 6))))
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "GROUP", 50)
    monkeypatch.setattr(ann, "QUERIES", 30)
    shipped, met = [], ann.met_in_groups
    monkeypatch.setattr(ann, "met_in_groups", lambda entries, *a: shipped.append(entries) or met(entries, *a))
    got = {}
    for r in ann.search(df, df.where("vec_id % 7 = 0"), recall=1.0, centroids=6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    right = 0
    for q in range(0, 900, 7):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(900), d)) if j != q][:10]
        found = [v for _, v in sorted(got[q])]
        assert len(found) == 10
        right += len(set(found) & set(want))
    assert right >= 0.98 * 10 * len(got)
    assert shipped[0].count() == 900


def test_cells_in_groups():
    assert ann.grouped({0: 3, 2: 4, 5: 25, 6: 1, 7: 9, 8: 1}, 10) == [(0, 0, 1), (2, 0, 1), (5, 1, 3), (6, 4, 1), (7, 4, 1), (8, 5, 1)]


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    d1, d2 = rng.random(6), rng.random(7)
    order = ann.walk(d1, d2, np.ones((6, 7), int), math.inf)
    sums = [d1[a] + d2[b] for a, b in order]
    assert sums == sorted(sums) and len(set(order)) == 42


# -- URLs ----------------------------------------------------------------------------------------------------------


def plain_rule(host, path):
    best = None
    for action, rule in queries.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}") and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best or (None, None)


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1?x=/en/1", "https://example.org", "https://example.org/en/12#f", "ftp://x.com/fr/", "http://com/de/9", "http://notorg/", "http://x.com/fr?u=http://y.org/", "://ORG/a b", "http://ÄB.org/é", "http://x.net/\nfr/"]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[3], None)] * 2, "page_id long, url string, host string")
    got = urlfilter.judge(df, queries.RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[3 if r.page_id is None else r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        action, rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (action is None or r.verdict == action)
    assert urlfilter.judge(df.limit(0), queries.RULES).count() == 0


def test_url_models_tell_classes_apart(spark):
    rng = np.random.default_rng(0)
    good = ["garden", "recipe", "travel", "music"]
    bad = ["casino", "pills", "xxx", "loan"]
    rows = []
    for k in range(1200):
        w = " ".join(rng.choice(bad if k % 2 else good, 2)).replace(" ", "-")
        tld = ("com/de" if k % 2 else "org") if k < 800 else "net"
        rows.append((k, f"http://{w}.{tld}/{rng.integers(1000)}"))
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).where("page_id >= 800").collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in out)
    assert right >= 0.9 * len(out)


def test_model_equals_brute_force(spark):
    from collections import Counter

    texts = [("^^^abcab", True), ("^^^abd", True), ("^^^xbcab", False), ("^^^ab", False)]
    df = spark.createDataFrame(texts, "t string, accepted boolean")
    got = {r.gram: r.delta for r in urlfilter.model(urlfilter.grams(df, "t", ["accepted"])).collect()}

    def log_p(gram, which):
        p = 1 / urlfilter.ALPHABET
        for order in range(urlfilter.ORDER + 1):
            n = Counter(t[i - order : i + 1] for t, a in texts if a == which for i in range(3, len(t)))
            context = gram[3 - order : 3]
            total = sum(v for g, v in n.items() if g[:-1] == context)
            types = sum(1 for g in n if g[:-1] == context)
            if total:
                p = (n[gram[3 - order :]] + types * p) / (total + types)
        return math.log(p)

    assert got and all(d == pytest.approx(log_p(g, True) - log_p(g, False)) for g, d in got.items())


# -- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_files_and_audit(spark, tmp_path):
    rows = [(k, f"http://x/{k}\r\n", f"<p>é {k}</p>\r\n\r\nx" * (k % 5)) for k in range(150)] + [(None, None, None), (3, None, "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/a", 4)
    warc.write(pages, f"{tmp_path}/b", 4)
    a = warc.read(spark, f"{tmp_path}/a")
    assert a.count() == len(rows)
    assert {bytes(r.body).decode() for r in a.collect()} == {r[2] or "" for r in rows}
    assert warc.audit(a, warc.read(spark, f"{tmp_path}/b")).count() == 0
    hurt = next((tmp_path / "b" / "file=2").glob("part-*"))
    raw = bytearray(hurt.read_bytes())
    spans = [(at, n) for at, n, _, body in warc.parse(bytes(raw)) if body]
    at, n = spans[len(spans) // 2]
    raw[at + n - 5] ^= 1
    hurt.write_bytes(raw)
    for crc in hurt.parent.glob(".*.crc"):
        crc.unlink()
    got = [tuple(r) for r in warc.audit(a, warc.read(spark, f"{tmp_path}/b")).collect()]
    assert got == [(2, at, "changed")]


def test_audit_of_unequal_replicas(spark):
    rows = [(f, 10 * k, 10, f"{f}-{k}") for f in range(3) for k in range(40)]
    make = lambda r: spark.createDataFrame(r, "file long, offset long, length long, digest string")
    a = make(rows)
    assert {tuple(r) for r in warc.audit(a, make([r for r in rows if r[:2] != (1, 390)])).collect()} == {(1, 390, "missing")}
    assert {tuple(r) for r in warc.audit(a, make([*rows, (2, 400, 10, "new")])).collect()} == {(2, 400, "extra")}
    assert warc.audit(make([]), make([])).count() == 0
    assert {tuple(r) for r in warc.audit(make([(0, 0, 1, "x")]), make([])).collect()} == {(0, 0, "missing")}
    assert warc.audit(a, make([])).count() == 120
    # the same bytes elsewhere, and a length that the digest doesn't tell of
    assert {tuple(r) for r in warc.audit(a, make([(f, at + (f == 1 and at > 380), n, d) for f, at, n, d in rows])).collect()} == {(1, 390, "moved")}
    assert {tuple(r) for r in warc.audit(a, make([(f, at, n + (f == 0 and at == 50), d) for f, at, n, d in rows])).collect()} == {(0, 50, "changed")}


def test_audit_names_records_lost_and_gained_in_the_middle(spark):
    """Against sets: files of other lengths, one file too many, and more records than a node covers."""
    rng = np.random.default_rng(3)
    a, b, want = [], [], set()
    for f in range(5):
        at = at_b = 0
        for k in range(700 if f < 4 else 3):
            record, n = f"{f}-{k % 600}", int(rng.integers(1, 50))
            a.append((f, at, n, f"d{record}", record))
            luck = rng.integers(0, 60)
            if luck == 0:
                want.add((f, at, "missing", record))
            elif luck == 1:
                b.append((f, at_b, n, "other", record))
                want.add((f, at, "changed", record))
                at_b += n
            else:
                b.append((f, at_b, n, f"d{record}", record))
                if at != at_b:
                    want.add((f, at, "moved", record))
                at_b += n
            if luck == 2:
                b.append((f, at_b, n, "gained", f"new{k}"))
                want.add((f, at_b, "extra", f"new{k}"))
                at_b += n
            at += n
    # ids that repeat are matched in their order, so their faults may name another of the same id
    once = {r for r in want if r[3].startswith("new") or int(r[3].split("-")[1]) >= 100}
    b += [(300, 0, 1, "x", "y")]
    make = lambda r: spark.createDataFrame(r, "file long, offset long, length long, digest string, id string")
    got = {tuple(r) for r in warc.audit(make(a), make(b), "id").collect()}
    assert once | {(300, 0, "extra", "y")} <= got and {r[3] for r in got} == {r[3] for r in want} | {"y"}
    assert warc.audit(make(a), make(a), "id").count() == 0 and warc.audit(make([]), make([]), "id").count() == 0


def test_common_records_are_dealt_over_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "TOGETHER", 10)
    rows = [(1, 5, "same", "clash")] * 95 + [(1, 7, f"d{k}", "clash") for k in range(50)] + [(None, 3, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, length long, digest string, file string")
    got = warc.placed(df, 8, "page_id").collect()
    assert sorted((r.page_id or 0, r.length, r.digest) for r in got) == sorted((r[0] or 0, *r[1:3]) for r in rows)
    by_file = {}
    for r in got:
        by_file.setdefault(r._file, []).append(r)
    assert len(by_file) == 8 and max(map(len, by_file.values())) < 60
    for records in by_file.values():
        at = 0
        for r in sorted(records, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert warc.placed(df.limit(0), 8, "page_id").count() == 0


# -- components ----------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2400)]
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(n, n if n in loops else None) == r for n, r in label.items())
    assert components.components(df.limit(0)).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from soukspark.llm import quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    good = {d for d, t in text.items() if quality.measure(t, quality.RepetitionRules())["kept"]}
    assert {r.doc_id for r in kept.collect()} == good
    unique = {r.doc_id for r in corpus_pipeline.near_dedup(spark, kept, SMALL).collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(text[d]) for d in good}
    for d in good - unique:
        assert any(len(sets[d] & sets[o]) >= 0.7 * len(sets[d] | sets[o]) for o in good if o < d)
    for d in unique:
        assert not any(len(sets[d] & sets[o]) >= 0.9 * len(sets[d] | sets[o]) for o in unique if o < d)
    want = plain_sample([r for r in docs.collect() if r.doc_id in unique])
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == want and want < unique
    lattice = sentencepieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"), queries.SP_ALPHA)
    assert all(r.sp_lossless and sentencepieces.decode(lattice, r.sp_ids) == text[r.doc_id] for r in out)


def plain_sample(rows):
    """Keys that mixing keeps: raking over a full array of cells, sampling by the hash of each key."""
    kinds = [[*t, None] for t in queries.TARGETS]

    def topic(t):
        return "legal" if re.search("licen[sc]e", t, re.I) else "contact" if re.search("[A-Za-z0-9.]@[A-Za-z0-9]", t) else "table" if "|" in t else "prose"

    cell = {r.doc_id: tuple(k.index(v if v in k else None) for k, v in zip(kinds, (r.source, r.lang, topic(r.text)), strict=True)) for r in rows}
    n = np.zeros([len(k) for k in kinds])
    for r in rows:
        n[cell[r.doc_id]] += len(r.text.encode().split())
    w = np.ones(n.shape)
    for _ in range(30):
        for k, (names, target) in enumerate(zip(kinds, queries.TARGETS, strict=True)):
            over = tuple(x for x in range(3) if x != k)
            own, now = n.sum(over), (n * w).sum(over)
            aim = np.array([target.get(v, 0) if own[j] else 0 for j, v in enumerate(names)])
            aim[-1] = 1 - aim.sum() if own[-1] else 0  # what has no target shares what is left
            shape = [-1 if x == k else 1 for x in range(3)]
            w = w * np.divide(aim / aim.sum() * n.sum(), now, out=np.ones(len(now)), where=now > 0).reshape(shape)
    p = w * min(0.7, 1 / w[n > 0].max())  # no row twice
    unit = lambda d: int(hashlib.md5(f"{queries.MIX_SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32
    return {d for d, c in cell.items() if unit(d) < p[c]}


def test_queries_over_small_tables(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for q in (queries.op1_sharding, queries.op6_token_ids, queries.op7_sentencepiece, queries.op9_quality, queries.op10_mixing):
        assert q(spark, SMALL).count() == documents, q.__name__
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert queries.op8_url_filter(spark, SMALL).count() == pages
    audit = queries.op5_warc(spark, SMALL)
    assert audit.where("status <> 'extra'").count() == pages


# -- whole tables --------------------------------------------------------------------------------------------------


def test_op1_over_a_whole_table(spark):
    import zlib

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = queries.op1_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    slots: dict[int, list] = {}
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_op1_equals_its_sql_on_odd_rows(spark, tmp_path):
    """Null and negative ids, null, empty, wide and long texts, repeated rows and a further column."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(None, "a"), (None, None), (None, "a"), (-1, ""), (-(2**63), "é中🙂"), (2**63 - 1, "x" * 5000), *[(7, "same")] * 50, *[(k, f"text {k}") for k in range(200)]]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "shard": ["clash"] * len(rows)}), tmp_path / "documents.parquet")
    got = queries.op1_sharding(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op1_sharding']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == len(rows)


def common_words(a, b):
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_op4_over_a_whole_table(spark):
    """Every notice that stands in a text word for word is found, and every find is as good as it says."""
    from soukspark.llm import licenses
    from soukspark.llm.common import WORD

    plain = lambda t: [p for w in re.findall(WORD, t) if (p := licenses.plain(w))]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found: dict[int, list] = {}
    for r in queries.op4_licenses(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.doc_id, []).append(r)
        template = plain(licenses.TEMPLATES[r.license])
        span = plain(texts[r.doc_id][r.start : r.end])
        assert r.matched_words == common_words(span, template) >= licenses.COVERAGE * len(template) and r.coverage == r.matched_words / len(template)
    exact = 0
    for doc, t in texts.items():
        line = f" {' '.join(plain(t))} "
        for name, template in licenses.TEMPLATES.items():
            n = line.count(f" {' '.join(plain(template))} ")
            exact += n
            # a longer notice may hold a shorter one
            assert n <= sum(r.license == name or len(plain(licenses.TEMPLATES[r.license])) > len(plain(template)) for r in found.get(doc, [])), (doc, name)
    assert exact > 10


def test_quality_stage_keeps_what_the_sql_keeps(spark):
    import duckdb

    import corpus_pipeline

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    want = sorted(r[0] for r in con.execute(f"select doc_id from ({queries.oracle_sql()['op9_quality']}) where kept").fetchall())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SMALL).collect()) == want


def test_near_dedup_loses_no_pair_of_the_given_documents(spark):
    """Components against all pairs by exact similarity, over the documents of sf0.01."""
    from soukspark.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    by_shingle: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for h in s:
            by_shingle.setdefault(h, []).append(i)
    met = {(i, j) for x in by_shingle.values() for a, i in enumerate(x) for j in x[:a]}
    links = [(i, j) for i, j in met if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    lost = sum(got[rows[i].doc_id] != got[rows[j].doc_id] for i, j in links)
    assert len(links) > 50 and lost == 0
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    none = [i for i, s in enumerate(sets) if not s]
    for i, j in [*links, *zip(none, none[1:], strict=False)]:
        label[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r.doc_id, least.get(root(i), r.doc_id))
    assert got == {r.doc_id: least[root(i)] for i, r in enumerate(rows)}


def test_equal_rows_are_numbered_without_a_window_of_their_own(spark):
    rows = [(7, "same")] * 5000 + [(7, f"t{k}") for k in range(300)] + [(None, None)] * 3 + [(k, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, slot string").repartition(5)
    got = sharding.assign(docs, 9, "doc_id", ["slot"])
    by_shard: dict[int, list] = {}
    for r in got.collect():
        by_shard.setdefault(r.shard, []).append(r._slot)
    assert sum(map(len, by_shard.values())) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sorted((r.doc_id or 0, r.slot or "") for r in got.collect()) == sorted((k or 0, t or "") for k, t in rows)


def test_stored_tables_are_cleared(spark):
    from pathlib import Path

    from soukspark.llm import common

    df = common.stored(spark.range(5).toDF("x"), "five")
    assert df.count() == 5
    where = Path(common.scratch(spark, "y")).parent
    assert any(where.iterdir())
    common.clear(spark)
    assert not where.exists()
    common.clear(spark)
