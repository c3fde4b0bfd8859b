"""Text operators against brute force and on the odd cases that each docstring defines."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from soukspark.llm import licenses, mixing, quality, sentencepieces, simhash, simple8b

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "one", "one two three", "tab\tand\x0bline\nfeed", "▁ mark ▁▁", "日本語 テキスト", "é🚚 " * 40, "x" * 3000, "a  b \n c ", "<|endoftext|> text", "dup line\ndup line\ndup line", "\0nul \x1c\x85　sep"]
SCHEMA = "doc_id long, text string, lang string, source string, shard string, quality string, sp_ids int, mix_weight int"


def odd_rows(spark, texts=ODD):
    rows = [(k, t, None, "s", "clash", "clash", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[5], (None, "one two three", "en", None, None, None, None, None), (3, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


# -- quality -------------------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_equal_brute_force():
    rng = np.random.default_rng(5)
    texts = [*ODD, *[" ".join(rng.choice(["a", "bé", "c|", "d", "#e\n"], n)) for n in (9, 10, 40, 300)]]
    for t in texts:
        m = quality.measure(t, quality.RepetitionRules())
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain_quality(t)
        assert m["base_failed"] == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"])


def test_quality_rules():
    clean = " ".join(f"word{k}" for k in range(100))
    assert quality.measure(clean, quality.RepetitionRules())["kept"]
    once = clean + "\n" + " ".join(f"word{k}" for k in range(8))
    assert quality.measure(once, quality.RepetitionRules())["kept"]
    often = clean + " spam spam" * 20
    assert not quality.measure(often, quality.RepetitionRules())["kept"]
    phrase = " ".join(["repeated"] + [f"phrase{k}" for k in range(5)])
    covered = " ".join(f"{phrase} {' '.join(f'w{j}x{k}' for k in range(26))}" for j in range(4))
    got = quality.measure(covered, quality.RepetitionRules())
    assert not got["base_failed"] and "dup_6gram" in got["failed_rules"] and not got["kept"]


def test_quality_rows(spark):
    out = quality.quality(odd_rows(spark))
    assert out.columns[-1] == "_quality" and out.count() == len(ODD) + 3
    assert quality.quality(odd_rows(spark).limit(0)).count() == 0


# -- simhash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, keys):
    label = dict(zip(range(len(keys)), range(len(keys)), strict=True))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[find(a)] = find(b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(keys))]


def near_texts(n=240):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        if k % 3 == 0:
            base = [f"w{x}" for x in rng.integers(0, 500, 60)]
        t = list(base)
        for _ in range(k % 3):
            t[rng.integers(60)] = "new"
        out.append(" ".join(t))
    return [*out, *ODD, out[0], out[5], "Osriebo X", None]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    keys = [None if k == 7 else k // 2 * 2 if k < 20 else 1000 - k for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    got = simhash.near_duplicates(docs, words=4, bits=64, radius=4, similarity=None, distinct=False).collect()
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = Counter(zip(keys, [f"{p:016x}" for p in prints], plain_components(pairs, keys), strict=True))
    assert Counter(map(tuple, got)) == want


def test_tiles_do_not_change_components(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    how = {"words": 4, "bits": 64, "radius": 4, "similarity": None, "distinct": False}
    want = {tuple(r) for r in simhash.near_duplicates(docs, **how).collect()}
    monkeypatch.setattr(simhash, "TILE", (7, 7))
    assert {tuple(r) for r in simhash.near_duplicates(docs, **how).collect()} == want


def test_hot_group_is_linked_without_pairs():
    rng = np.random.default_rng(0)
    a = np.full((3000, 1), 2**40 + 5, np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (3000, 1)).astype(np.uint64))
    assert (simhash.compare(a, None, 4) == 0).all()
    assert (simhash.compare(a[:1000], a[1000:], 4) == 0).all()


def test_keep_one(spark):
    base = [f"w{k}" for k in range(200)]
    other = [f"v{k}" for k in range(200)]
    half = base[:100] + other[:100]
    edited = base[:50] + ["x"] + base[51:]
    docs = spark.createDataFrame([(9, " ".join(base)), (4, " ".join(edited)), (5, " ".join(other)), (6, " ".join(half)), (None, " ".join(base)), (7, " ".join(base))], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["4", "5", "6", "None"]


def plain_wide(text, n=5, bits=256):
    """The fingerprint of distinct shingles and how many there are."""
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    full = 2**64 - 1

    def spread(h, k):
        z = h + k * 0x9E3779B97F4A7C15 & full
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        return z ^ z >> 31

    wide = []
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        wide.append(sum((spread(h, k) if k else h) << (bits - 64 - 64 * k) for k in range(bits // 64)))
    return sum(1 << b for b in range(bits) if 2 * sum(x >> b & 1 for x in wide) > len(wide)), len(grams)


def test_similar_texts_equal_brute_force(spark):
    texts = near_texts(150)
    keys = [1000 - k for k in range(len(texts))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")).collect()}
    prints = [plain_wide(t) for t in texts]
    size = {}
    for p, n in prints:
        size[p] = max(n, size.get(p, 0))
    pairs = []
    for i, (p, _) in enumerate(prints):
        for j, (q, _) in enumerate(prints[:i]):
            n, m = size[p], size[q]
            both = math.cos(math.pi * (p ^ q).bit_count() / 256) * math.sqrt(n * m)
            if p == q or both >= 0.8 * (n + m - both) - 1e-9 and min(n, m) >= 0.8 * max(n, m):
                pairs.append((i, j))
    assert got == dict(zip(keys, plain_components(pairs, keys), strict=True)) and len(set(got.values())) < len(texts) - 40


def plain_similar(texts, keys):
    """Smallest keys of groups by true Jaccard similarity of five-word shingles."""
    sets = []
    for t in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    return plain_components(pairs, keys)


def test_keep_one_links_by_true_similarity(spark, monkeypatch):
    texts = []
    for k in range(40):
        # 90 shingles of which 10 or 11 change: 80/100 and 79/101; 4 shingles of 5, and 7 of 9
        w = [f"a{k}x{i}" for i in range(94)]
        texts += [" ".join(w), " ".join(w[:84] + ["p"] * 10), " ".join(["q"] * 11 + w[11:])]
        texts += [" ".join(f"b{k}x{i}" for i in range(n)) for n in (8, 9)]
        texts += [" ".join(f"c{k}x{i}" for i in range(11)), " ".join(f"c{k}x{i}" for i in range(2, 13))]
    texts += [*near_texts(150), *(" ".join(f"d{i}" for i in range(k, k + 120)) for k in range(60))]
    keys = [None if k == 9 else 5000 - k for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    least = plain_similar(texts, keys)
    want = Counter(k for k, x in zip(keys, least, strict=True) if k is None or k == x)
    for block in (simhash.BLOCK_SHINGLES, 300):
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
        assert Counter(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_simhash_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


# -- token ids -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [5] * 3000, [0] * 5000, list(range(2000)), [2**64 - 1, 2**63, 2**60 - 1, 2**60, 1] * 50])
def test_pack_round_trip(ids):
    ids = np.fromiter(ids, np.uint64)
    assert (simple8b.unpack(*simple8b.pack(ids), len(ids)) == ids).all()


def test_pack_is_small():
    assert len(simple8b.pack(np.ones(6000, np.uint64))[0]) <= 6000 / 60 + 6000 / 1024 * 4


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_the_library(special):
    e = simple8b.PieceEncoder(BPE, special)
    texts = [t for t in ODD if t is not None] + ["a,\nb. c.\nd, e\n f.,", ".", " , .", "a<|endoftext|>", "it's, we'll.\nOK", "a\n　　b", "a \x85b", "q\U0010ffff r s"]
    for _ in range(2):
        ids, n = e.encode(pa.array(texts), 2)
        for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == [*e.library.encode(t, add_special_tokens=False).ids, 2], t


@pytest.mark.parametrize("small", [False, True])
def test_files_round_trip(spark, tmp_path, monkeypatch, small):
    import zlib

    from tokenizers import Tokenizer

    docs = odd_rows(spark, [*ODD, *["long text, " * (400 + k) for k in range(30)]])
    if small:
        monkeypatch.setattr(simple8b, "SEGMENT_IDS", 1000)
    simple8b.write(docs, f"{tmp_path}/ids", BPE, file_bytes=8000 if small else 1 << 20)
    files = list((tmp_path / "ids").glob("part-*"))
    assert len(files) > 10 if small else len(files) <= 4
    library = Tokenizer.from_file(BPE)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), r.text or "") for r in docs.collect()), key=lambda r: r[:3])
    want, start = [], 0
    for real, key, _, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((key if real else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in simple8b.index(spark, f"{tmp_path}/ids").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    back = simple8b.read(spark, f"{tmp_path}/ids").where("doc_id = 4").first()
    assert back.ids == [*library.encode("one", add_special_tokens=False).ids, 2]
    simple8b.write(docs.limit(0), f"{tmp_path}/none", BPE)
    assert simple8b.index(spark, f"{tmp_path}/none").count() == 0


def test_equal_rows_are_dealt_over_files(spark, tmp_path):
    docs = spark.createDataFrame([(5, "one two three")] * 4000 + [(9, "x"), (1, None)], "doc_id long, text string").repartition(3)
    simple8b.write(docs, f"{tmp_path}/ids", BPE)
    got = sorted(tuple(r) for r in simple8b.index(spark, f"{tmp_path}/ids").select("doc_id", "start", "n_tokens").collect())
    assert got == [(1, 0, 1), *[(5, 1 + 4 * k, 4) for k in range(4000)], (9, 16001, 2)]
    per = simple8b.read(spark, f"{tmp_path}/ids").groupBy("range").count().collect()
    assert max(r["count"] for r in per) < 2500


def test_the_text_writer_keeps_every_byte(spark, tmp_path):
    raw = [bytes(range(256)) * 3, b"\xff\xfe\n\r\n\x80", bytes(reversed(range(256)))]
    rows = spark.createDataFrame([(bytearray(x),) for x in raw], "x binary").coalesce(1)
    rows.select(F.col("x").cast("string").alias("value")).write.text(f"{tmp_path}/raw")
    (file,) = (tmp_path / "raw").glob("part-*")
    assert file.read_bytes() == b"".join(x + b"\n" for x in raw)


def test_token_ids_of_special_strings_are_the_librarys(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    from soukspark.llm import queries

    texts = ["a<|endoftext|> b", "plain text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(BPE)
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op6_token_ids(spark, str(tmp_path)).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(want)}


# -- sentencepieces ------------------------------------------------------------------------------------------------


def test_pieces_decode_to_the_text_and_repeat(spark):
    import sentencepiece

    out = sentencepieces.encoded(odd_rows(spark), SP, seed=1)
    assert out.columns[-2:] == ["_sp_ids", "sp_lossless"]
    rows = out.collect()
    assert all(r.sp_lossless if r.text is not None else r._sp_ids is None for r in rows)
    back = {r.doc_id: r.sp_text for r in sentencepieces.decoded(out.where("text is not null"), SP, "_sp_ids").collect()}
    assert all(back[k] == t for k, t in enumerate(ODD) if t is not None)
    again = {r.doc_id: r._sp_ids for r in sentencepieces.encoded(odd_rows(spark).repartition(3), SP, seed=1).collect()}
    assert all(again[r.doc_id] == r._sp_ids for r in rows if r.doc_id not in (3, None))
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    assert sp.decode(next(r._sp_ids for r in rows if r.doc_id == 5)) == "one two three"
    assert sentencepieces.encoded(odd_rows(spark).limit(0), SP).count() == 0


def plain_sampler(lattice, text, row):
    """Forward sums over the whole text in logarithms, then draws from its end, one place after another."""
    mark, own = sentencepieces.MARK, sentencepieces._OWN_MARK
    chars = (mark + text.replace(mark, own).replace(" ", mark)) if text is not None else None
    n, most = len(chars), lattice.longest
    arcs, total = [[] for _ in range(n + 1)], [0.0] + [-math.inf] * n
    for e in range(1, n + 1):
        found = [(m, lattice.ids[chars[e - m : e]]) for m in range(1, min(e, most) + 1) if chars[e - m : e] in lattice.ids]
        if not found or found[0][0] != 1:
            found = [(1, None), *found]
        arcs[e] = [(m, k, total[e - m] + math.log(lattice.unknown if k is None else lattice.weight[k])) for m, k in found]
        top = max(x for _, _, x in arcs[e])
        total[e] = top + math.log(math.fsum(math.exp(x - top) for _, _, x in arcs[e]))
    out, e = [], n
    while e:
        u, run = float(sentencepieces._noise(np.array([row], np.uint64), np.array([e]))[0]), 0.0
        for j, (m, k, x) in enumerate(arcs[e]):
            run += math.exp(x - total[e])
            if u < run or j + 1 == len(arcs[e]):
                break
        c = chars[e - 1]
        out.append([k] if k is not None else [lattice.byte[b] for b in (mark if c == own else c).encode()])
        e -= m
    return [k for x in reversed(out) for k in x]


def test_rows_equal_a_plain_sampler(spark, monkeypatch):
    """Whole texts, with spaces in runs, marks, characters without a piece and long words, at two kinds of lattice."""
    texts = ["Thing the theatre  in   London", "  lead and trail  ", "▁own ▁▁ marks▁", "日本語のテキスト、長い文です。" * 6, "aGVsbG8gd29ybGQ" * 8, "é🚚\tTabs\nlines", " ", "", "x" * 90, "    ", "a" + " " * 40 + "b", "naïve Straße — done"]
    for alpha in (0.3, 1.0):
        lattice = sentencepieces.Lattice(SP, alpha)
        seeds = np.array([sentencepieces.seed_of(k, 9) for k in range(len(texts))], np.uint64)
        for together in (40, 6):
            monkeypatch.setattr(sentencepieces, "TOGETHER", together)
            lattice.forget()
            ids, count = sentencepieces.encode(lattice, pa.array(texts), seeds)
            for t, s, got in zip(texts, seeds, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                assert got.tolist() == plain_sampler(lattice, t, s), t
            assert sentencepieces.lossless(lattice, pa.array(texts), ids, count).all()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sp_ids for r in sentencepieces.encoded(rows, SP, seed=9).collect()}
    lattice = sentencepieces.Lattice(SP, 1.0)
    assert all(got[k] == plain_sampler(lattice, t, np.uint64(sentencepieces.seed_of(k, 9))) for k, t in enumerate(texts))


def test_pieces_of_spaces_take_part():
    lattice = sentencepieces.Lattice(SP, 0.05)
    assert sum(set(x) == {sentencepieces.MARK} for x in lattice.ids) > 10
    seen = set()
    for k in range(300):
        ids, _ = sentencepieces.encode(lattice, pa.array(["a" + " " * 16 + "b"]), np.array([k * 7919], np.uint64))
        seen |= {lattice.names[i] for i in ids}
    assert sum(set(x) == {sentencepieces.MARK} and len(x) > 1 for x in seen) >= 5


def test_seeds_of_keys_differ():
    """Keys do not share noise, and another seed is no shift of the first."""
    a = [sentencepieces.seed_of(k, 3) for k in range(20_000)]
    b = [sentencepieces.seed_of(k, 4) for k in range(20_000)]
    assert len({x >> 32 for x in a}) > 19_990 and len(set(a)) == 20_000
    assert len({x ^ y for x, y in zip(a, b, strict=True)}) == 20_000


@pytest.mark.parametrize("long", [False, True])
def test_sampling_follows_the_lattice(long, monkeypatch):
    lattice = sentencepieces.Lattice(SP, 0.5)
    if long:
        monkeypatch.setattr(sentencepieces, "TOGETHER", 0)
    word = sentencepieces.MARK + "thing"

    def paths(end):
        if end == 0:
            return {(): 1.0}
        out = Counter()
        for m, k in lattice.ending(word, end):
            for p, w in paths(end - m).items():
                out[(*p, k)] += w * lattice.weight[k]
        return out

    want = paths(len(word))
    total = sum(want.values())
    n = 20_000
    seeds = np.array([sentencepieces.seed_of(k, 0) for k in range(n)], np.uint64)
    ids, count = sentencepieces.encode(lattice, pa.array(["thing"] * n), seeds)
    got = Counter(map(tuple, (x.tolist() for x in np.split(ids, np.cumsum(count)[:-1]))))
    assert set(got) <= set(want)
    for p, w in want.items():
        share = w / total
        assert abs(got[p] / n - share) < 5 * (share / n) ** 0.5 + 1e-3


def test_short_and_long_words_draw_alike(monkeypatch):
    lattice = sentencepieces.Lattice(SP, 1.0)
    texts = pa.array(["some words in a row, and more", "éà unknown 日本"])
    seeds = np.array([1, 2], np.uint64)
    a = sentencepieces.encode(lattice, texts, seeds)
    monkeypatch.setattr(sentencepieces, "TOGETHER", 0)
    lattice.forget()
    b = sentencepieces.encode(lattice, texts, seeds)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


# -- licenses ------------------------------------------------------------------------------------------------------


def test_licenses_in_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("persons", "people", 1).replace("including without limitation", "including", 1)
    rng = np.random.default_rng(2)
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", "software", "zug", "license", "to"], n))
    texts = [
        "Intro.\nReleased under the MIT License.", f"{noise(30)}\n{changed}\n{noise(10)}", noise(400), "  Licensed under CC BY-NC 4.0.  \n", None, "",
        "This work is licensed under the GNU General Public License, version 3." * 1 + " x " + "RELEASED UNDER THE MIT LICENSE", "the the the license", "Licensed under",
    ]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    rows = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license) for r in sorted(rows, key=lambda r: (r.doc_id, r.start))] == [(0, "MIT (line)"), (1, "MIT"), (3, "CC-BY-NC-4.0 (line)"), (6, "GPL-3.0 (line)"), (6, "MIT (line)")]
    at = {(r.doc_id, r.license): texts[r.doc_id][r.start : r.end] for r in rows}
    assert at[0, "MIT (line)"] == "Released under the MIT License." and at[1, "MIT"] == changed and at[3, "CC-BY-NC-4.0 (line)"] == "Licensed under CC BY-NC 4.0."
    assert next(r for r in rows if r.license == "MIT").coverage < 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_candidates_lose_none():
    index = licenses.Index(licenses.TEMPLATES)
    for t, w in enumerate(index.words):
        doc = np.concatenate((np.full(4, -1), w, np.full(3, -1)))
        found = licenses.scan_words(index, doc, np.array([0, len(doc)]))
        assert (0, t, len(w), 4, 3 + len(w)) in found


def plain_align(doc, template):
    best = [[0] * (len(template) + 1) for _ in range(len(doc) + 1)]
    for i, a in enumerate(doc):
        for j, b in enumerate(template):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a == b))
    return best[-1][-1]


def test_alignment_equals_full_table_within_its_band():
    rng = np.random.default_rng(4)
    for _ in range(50):
        template = rng.integers(0, 6, 12)
        doc = np.delete(np.insert(template, rng.integers(0, 12, 2), 9), rng.integers(0, 12, 2))
        assert licenses.align(doc, template, 0)[0] == plain_align(doc.tolist(), template.tolist())


# -- mixing --------------------------------------------------------------------------------------------------------


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    cells = {(a, b): float(rng.integers(1, 100)) for a in "xyz" for b in "pq"}
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.9, "q": 0.1}]
    w, off = mixing.rake(cells, targets)
    whole = sum(cells.values())
    assert off <= mixing.TOLERANCE
    for k, t in enumerate(targets):
        for v, share in t.items():
            assert sum(n * w[c] for c, n in cells.items() if c[k] == v) == pytest.approx(share * whole)


def test_rake_with_missing_values():
    assert mixing.rake({}, [{"a": 1.0}]) == ({}, 0.0)
    assert mixing.rake({("a",): 0.0}, [{"a": 1.0}]) == ({("a",): 1.0}, 0.0)
    other = (mixing.OTHER,)
    w, _ = mixing.rake({("a",): 10.0, other: 30.0}, [{"a": 0.5, "gone": 0.25}])  # what is not named shares what is left
    assert w[("a",)] * 10 == pytest.approx(20) and w[other] * 30 == pytest.approx(20)
    w, _ = mixing.rake({("a",): 10.0, ("b",): 30.0}, [{"a": 0.5, "b": 0.1}])  # nothing else is there
    assert w[("a",)] * 10 == pytest.approx(40 * 5 / 6)


def test_targets_that_cells_do_not_allow_are_reported(spark):
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b", "p" if k % 2 else "q", 10) for k in range(100)], "doc_id long, source string, lang string, n long")
    targets = [{"a": 0.9}, {"p": 0.2}]
    with pytest.warns(UserWarning, match="missed"):
        mixing.mix(docs, ["source", "lang"], targets, "n")
    got = {(r.dim, r.value): (r.own, r.target) for r in mixing.report(docs, ["source", "lang"], targets, "n").collect()}
    assert got[("source", "a")] == (0.5, 0.9) and got[("lang", mixing.OTHER)] == (0.5, 0.8)
    fine = mixing.report(docs, ["source"], [{"a": 0.9}], "n").where("value = 'a'").first()
    assert fine.reached == pytest.approx(0.9)


def test_sample_is_calibrated(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 7 + 1).alias("n"))
    whole = docs.agg(F.sum("n")).first()[0]

    def sample(share, **how):
        out = mixing.mix(docs, ["source"], [{"hot": share}], "n", **how)
        t = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("n")).alias("t")).collect()}
        return t["hot"] / sum(t.values()), sum(t.values()) / whole, out.agg(F.max("mix_copies")).first()[0]

    part, rate, most = sample(0.2, rate=0.3)
    assert part == pytest.approx(0.2, abs=0.02) and rate == pytest.approx(0.3, abs=0.02) and most == 1
    # hot rows are a third: at nine tenths of the sample it holds 0.37 of all tokens at most, unless rows repeat
    part, rate, most = sample(0.9, rate=0.8)
    assert part == pytest.approx(0.9, abs=0.02) and rate == pytest.approx(1 / 2.7, abs=0.02) and most == 1
    part, rate, most = sample(0.9, rate=0.8, repeats=True)
    assert part == pytest.approx(0.9, abs=0.02) and rate == pytest.approx(0.8, abs=0.02) and most == 3
    assert sample(0.2)[1] == pytest.approx(1 / 1.2, abs=0.02)


def test_mix_odd_rows(spark):
    out = mixing.mix(odd_rows(spark), ["lang", "source"], [{"en": 1.0}, {"s": 0.5}], "sp_ids")
    assert out.count() == len(ODD) + 3 and "_mix_weight" in out.columns
    assert mixing.mix(odd_rows(spark).limit(0), ["lang"], [{"en": 1.0}], "sp_ids").count() == 0


def test_topics(spark):
    texts = [None, "", "under LICENCE x", "my License", "lisense", "a@b", "a @ b", "a|b", "x"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(mixing.topic("text").alias("t")).collect()]
    assert got == [None, "prose", "legal", "legal", "prose", "contact", "prose", "table", "prose"]


# -- the pipeline's stages on odd tables ---------------------------------------------------------------------------

CLASH = "doc_id long, text string, lang string, source string, n_chars long, quality string, topic string, n_tokens string, mix_copies boolean, mix_sampled boolean, component_id string, key string, cell0 string, sp_ids string"


def odd_table(spark):
    """Odd rows and real ones, with columns of every name that a stage uses."""
    good = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(30)]
    texts = [*ODD, *good, good[0], good[1] + " more"]
    rows = [(k, t, "en" if k % 2 else None, "src0" if k % 3 else "other", 1, "q", "t", "n", False, False, "c", "k", "z", "i") for k, t in enumerate(texts)]
    rows += [rows[20], (None, good[5], None, None, None, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, CLASH)


def test_stages_keep_to_their_columns(spark):
    import corpus_pipeline

    docs = odd_table(spark)
    before = Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = Counter(tuple(r) for r in out.collect())
        assert rows and not rows - before, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    want = Counter(r.doc_id for r in docs.collect() if len(words(r.text)) >= 10 and quality.measure(r.text, quality.RepetitionRules())["kept"])
    assert Counter(r.doc_id for r in kept.collect()) == want
    sampled = corpus_pipeline.mix_sources(spark, docs, "").count()
    assert 0 < sampled < docs.count()
    last = corpus_pipeline.encode_pieces(spark, docs, "")
    assert last.columns == ["doc_id", "source", "lang", "sp_ids", "sp_lossless"] and last.count() == docs.count()
    assert last.where("not sp_lossless").count() == 0
