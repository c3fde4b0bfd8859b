"""The registered queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soukspark.llm import ann, centroids, licenses, mixing, prefixtree, quality, sentencepieces, sharding, simhash, simple8b, substrings, urlfilter, warc
from soukspark.llm.common import SPACES_PATTERN, cut, scratch, table

SHARDS = 40
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Shares of tokens; sources, languages and topics that are not named share what is left.
TARGETS = [{"src0": 0.25}, {"en": 0.54, "de": 0.15, "fr": 0.15, "es": 0.15}, {"prose": 0.9, "legal": 0.03}]
MIX_DIMS, MIX_SEED, MIX_RATE = ["source", "lang", "topic"], 11, 0.5
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIM, CLUSTER_SCALE = 40, 5, 64, 256
WINDOW = 35
HEADS, TOGETHER = 6, 100
SP_ALPHA, SP_SEED = 1.0, 3
WARC_DATE, WARC_RECORDS = "2024-01-01T00:00:00Z", 1000


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.assign(docs, SHARDS, "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4, similarity=None, distinct=False)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages against a replica in which the last byte of some records' bodies was lost to a zero, some
    records are gone and some come twice, and what comes after these lies elsewhere; a copy too many has a row
    of its own, without offset (-1), length and digest."""
    pages = table(spark, sf_dir, "pages")
    files = max(1, -(-pages.count() // WARC_RECORDS))
    whole = F.col("record").cast("binary")
    damaged = F.concat(F.expr("left(record, length(record) - 5)"), F.lit("\0"), F.lit(warc.END)).cast("binary")
    hit = warc.bucket("page_id", 97)
    rows = pages.select("page_id", warc.record("url", "html", WARC_DATE, "page_id").alias("record"))
    copy = F.when(hit == 0, damaged).otherwise(whole)
    rows = rows.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(whole, 256).alias("digest"), F.sha2(copy, 256).alias("copy"), F.octet_length(copy).cast("long").alias("size"))
    rows = warc.cut(warc.placed(rows, files, "page_id"))
    # the replica's records keep their order; of two copies the second lies right behind the first
    twice = F.explode(F.when(hit == 1, F.array().cast("array<int>")).when(hit == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    replica = rows.select("page_id", "file", "offset", F.col("size").alias("length"), F.col("copy").alias("digest"), twice.alias("k"))
    before = Window.partitionBy("file").orderBy("offset", "k").rowsBetween(Window.unboundedPreceding, -1)  # one file's records
    replica = replica.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("k")
    faults = cut(warc.audit(rows, replica, "page_id"))
    out = rows.join(faults.where("fault <> 'extra'").drop("page_id"), ["file", "offset"], "left")
    out = out.select("page_id", "file", "offset", "length", "digest", F.coalesce("fault", F.lit("ok")).alias("status"))
    more = faults.where("fault = 'extra'").select(F.col("page_id").cast(dict(pages.dtypes)["page_id"]), "file", F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(""), "fault")
    return out.unionAll(more)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    simple8b.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return simple8b.index(spark, path)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), alpha=SP_ALPHA, seed=SP_SEED)
    return out.select("doc_id", F.size("sp_ids").cast("long").alias("n_pieces"), F.xxhash64("sp_ids").alias("ids_xxhash64"), F.col("sp_lossless").alias("lossless"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def mix_input(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", mixing.topic("text").alias("topic"), mixing.tokens("text").alias("n_tokens"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many tokens as there are, at the target shares; rare documents come more than once."""
    docs = cut(mix_input(table(spark, sf_dir, "documents")))  # texts are read once
    out = mixing.mix(docs, MIX_DIMS, TARGETS, "n_tokens", rate=MIX_RATE, seed=MIX_SEED, repeats=True)
    rounded = [F.round(f"mix_{c}", 6).alias(c) for c in ("weight", "expected")]
    return out.select("doc_id", "topic", "n_tokens", *rounded, F.col("mix_copies").alias("copies"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c as the first crc32(c) % 6 turns of conversation c - c % 100 and its own turns after as many."""
    turns, first = cut(turns), F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    heads = turns.where((F.col("conv") % TOGETHER == 0) & (F.col("place") < HEADS - 1)).groupBy(F.col("conv").alias("of"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))  # HEADS - 1 turns at most
    convs = turns.select("conv").distinct().withColumns({"of": F.col("conv") - F.col("conv") % TOGETHER, "h": first.cast("int")}).join(heads, "of", "left")
    convs = cut(convs.select("conv", F.expr("slice(coalesce(head, array()), 1, h)").alias("head")))
    new = convs.select("conv", F.explode_outer("head").alias("t")).select("conv", F.col("t.place").cast("long").alias("place"), "t.digest", "t.chars")
    own = turns.where(F.col("place") >= first).join(convs.select("conv", F.size("head").alias("n")), "conv")
    return new.unionAll(own.select("conv", (F.col("place") - first + F.col("n")).alias("place"), "digest", "chars"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; what nulls, ties and repeated rows do is said in ``prefixtree``."""
    return prefixtree.tree(rebuilt(prefixtree.turns(table(spark, sf_dir, "conversations"))))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds over the whole table from 40 vectors; what takes part and how ties fall is said in ``centroids``."""
    rows, final = centroids.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, dim=CLUSTER_DIM, scale=CLUSTER_SCALE, salt="2:")
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(final)]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")  # one row for each centroid
    return centroids.inertia(cut(rows)).join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; ``kept_sha256`` is that of the words left, or of all words where nothing went."""
    whole = F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES_PATTERN, " ")).cast("binary"), 256)
    out = substrings.dedup(table(spark, sf_dir, "documents"), size=WINDOW, also={"whole_sha256": whole})
    left = F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), "whole_sha256")
    return out.select("doc_id", "n_words", "n_removed", left.alias("kept_sha256"), "longest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_sharding, op2_simhash, op3_ann, op4_licenses, op5_warc, op6_token_ids, op7_sentencepiece, op8_url_filter, op9_quality, op10_mixing, op11_prefix_trie, op12_centroids, op13_substrings, pipeline]
    return {f.__name__: f for f in found}


_SPACE_CLASS = "[\\x09-\\x0D ]"


def _crc32_sql(data: str) -> str:
    """CRC-32 of a blob, bit by bit."""
    crc = "c >> 8"
    for k in range(8):
        bit = 1 << k
        for _ in range(8):
            bit = bit >> 1 ^ (0xEDB88320 if bit & 1 else 0)
        crc = f"xor({crc}, (xor(c, x) >> {k} & 1) * {bit})"
    return f"xor({(1 << 32) - 1}, list_reduce(list_transform(regexp_extract_all(hex({data}), '..'), lambda x: ('0x' || x)::bigint), lambda c, x: {crc}, {(1 << 32) - 1}::bigint))"


def _op1_sql() -> str:
    """CRC-32 bit by bit, the jumps as a recursion, and XXH64 of key, checksum and size for the parts that number a shard."""
    full, turned = 1 << 64, lambda x, n: f"(({x} << {n}) & {(1 << 64) - 1}::uhugeint) | ({x} >> {64 - n})"
    times = lambda x, y: f"({x} * {y}::uhugeint & {full - 1}::uhugeint)"
    unsigned = lambda x: f"(({x}::hugeint + {full}) % {full})::uhugeint"
    state = f"(s * 2862933555777941757::uhugeint + 1::uhugeint & {full - 1}::uhugeint)"
    jump = f"floor((j + 1)::double * (2147483648::double / (({state} >> 33) + 1::uhugeint)::double))::bigint"
    sql = [
        "a as (select doc_id, encode(coalesce(text, '')) t from documents)",
        f"b as (select doc_id, octet_length(t)::bigint + 16 size, {_crc32_sql('t')} text_crc32 from a)",
        f"k as (select distinct doc_id, {unsigned('coalesce(doc_id, 0)')} s from b)",
        f"w as (select doc_id, s, 0::bigint j from k union all select doc_id, {state}, {jump} from w where {jump} <= {SHARDS})",
        f"j as (select doc_id, max(j) filter (j < {SHARDS})::int shard, max(j)::int grown_shard from w group by doc_id)",
        "h0 as (select b.*, shard, grown_shard, 42::uhugeint h from b join j on b.doc_id is not distinct from j.doc_id)",
    ]
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    steps = []
    for c in ("doc_id", "text_crc32", "size"):  # a null is passed over, as h0's seed stays
        word = times(unsigned(c), p2)
        steps.append(f"xor(h + {p5 + 8}::uhugeint & {full - 1}::uhugeint, {times(f'({turned(word, 31)})', p1)})")
        steps.append(f"{times('(' + turned('h', 27) + ')', p1)} + {p4}::uhugeint & {full - 1}::uhugeint")
        steps += [times("xor(h, h >> 33)", p2), times("xor(h, h >> 29)", p3), "xor(h, h >> 32)"]
        steps[-5:] = [f"case when {c} is null then h else {x} end" for x in steps[-5:]]
    sql += [f"h{k + 1} as (select * exclude (h), {x} h from h{k})" for k, x in enumerate(steps)]
    order = f"(h & {sharding.PARTS - 1}::uhugeint), doc_id nulls first, text_crc32, size"
    return "with recursive " + ",\n".join(sql) + f"\nselect doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by {order}) - 1 as slot, grown_shard from h{len(steps)}"


def _op5_sql() -> str:
    key = "coalesce(cast(page_id as varchar), '')"
    uuid = " || '-' || ".join(f"substr(m, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    eol = "chr(13) || chr(10)"
    return f"""
    with a as (select *, md5({key}) m, coalesce(html, '') body, (select greatest(1, ceil(count(*) / {WARC_RECORDS}.0)) from pages)::bigint files from pages),
    b as (select page_id, ('0x' || substr(m, 1, 8))::bigint % 97 hit, files,
        'WARC/1.0' || {eol} || 'WARC-Type: resource' || {eol}
        || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || {eol}, '')
        || 'WARC-Record-ID: <urn:uuid:' || {uuid} || '>' || {eol} || 'WARC-Date: {WARC_DATE}' || {eol}
        || 'Content-Type: text/html' || {eol} || 'Content-Length: ' || strlen(body) || {eol} || {eol} || body || {eol} || {eol} r from a),
    c as (select page_id, hit, files, strlen(r) as length, sha256(r) as digest, case hit when 0 then strlen(left(r, length(r) - 5)) + 5 else strlen(r) end as size from b),
    d as (select *, row_number() over (partition by page_id, digest) - 1 rn, ('0x' || substr(md5({key} || ':' || digest), 1, 8))::bigint % files h from c),
    e as (select *, (h + rn // {warc.TOGETHER}) % files as file from d),
    f as (select *, coalesce(sum(length) over (partition by file order by page_id nulls first, digest, rn rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
      coalesce(sum(case hit when 1 then 0 when 2 then 2 * size else size end) over (partition by file order by page_id nulls first, digest, rn rows between unbounded preceding and 1 preceding), 0)::bigint as there from e)
    select page_id, file, "offset", length, digest, case when hit = 0 then 'changed' when hit = 1 then 'missing' when there <> "offset" then 'moved' else 'ok' end as status from f
    union all select page_id, file, -1, 0, '', 'extra' from f where hit = 2"""


def _op8_sql() -> str:
    o, alpha = urlfilter.ORDER, urlfilter.ALPHABET
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}'))"
    case = lambda k: "case " + " ".join(f"when {fits(*r[1].split('/', 1))} then '{r[k]}'" for r in rules) + " end"
    marks = "".join(f"\\{c}" for c in urlfilter.MARKS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sql = [
        f"b0 as (select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages)",
        f"b as (select *, {case(1)} as rule, {case(0)} said from b0)",
        f"d as (select url, any_value(said) said, '{'^' * o}' || regexp_replace(translate(translate(coalesce(url, ''), '{upper}', '{lower}'), '123456789', '000000000'), '(?s)[^a-z0{marks}]', '~', 'g') t, ('0x' || substr(md5(coalesce(url, '')), 1, 8))::bigint % {urlfilter.FOLDS} = 0 held from b group by url)",
        f"e as (select url, said, held, t, unnest(range(1, length(t) - {o} + 1)) i from d where length(t) > {o})",
        f"g as (select url, said, held, substr(t, i, {o + 1}) gram from e)",
        "f as (select gram, count(*) filter (said = 'allow') a, count(*) filter (said = 'block') r from g where said is not null and not held group by gram)",
        f"m0 as (select gram, 1.0::double / {alpha} pa, 1.0::double / {alpha} pr from f)",
    ]
    for k in range(o + 1):
        part = f"substr(gram, {o + 1 - k}, {k + 1})"
        sql.append(f"s{k} as (select g, a, r, {', '.join(f'sum({x}) over (partition by substr(g, 1, {k})) n{x}, count(*) filter ({x} > 0) over (partition by substr(g, 1, {k})) t{x}' for x in 'ar')} from (select {part} g, sum(a) a, sum(r) r from f group by 1))")
        step = ", ".join(f"case when n{x} > 0 then (s.{x} + t{x} * p{x})::double / (n{x} + t{x}) else p{x} end p{x}" for x in "ar")
        sql.append(f"m{k + 1} as (select gram, {step} from m{k} join s{k} s on g = {part})")
    sql += [
        f"z as (select url, any_value(said) said, avg(coalesce(ln(pa) - ln(pr), 0)) score from g left join m{o + 1} using (gram) where said is null or held group by url)",
        "l as (select avg(score) filter (said = 'allow') ma, stddev_pop(score) filter (said = 'allow') sa, avg(score) filter (said = 'block') mb, stddev_pop(score) filter (said = 'block') sb from z)",
        "h as (select case when sa + sb = 0 then (ma + mb) / 2 else (ma * sb + mb * sa) / (sa + sb) end t from l)",
    ]
    return "with " + ",\n".join(sql) + "\nselect page_id, host, path, rule, coalesce(b.said, case when coalesce(score, 0) < (select t from h) then 'block' else 'allow' end) verdict from b left join (select url u, score from z where said is null) on b.url is not distinct from u"


def _op9_sql() -> str:
    rules = quality.RepetitionRules()
    full = "[^\\x09-\\x0D ]"
    sql = [
        f"a as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE_CLASS}+'), lambda x: x <> '') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{full}')) l from documents)",
        f"b as (select *, len(w) n, length(regexp_replace(t, '{_SPACE_CLASS}', '', 'g')) total from a)",
        "j as (select doc_id, unnest(range(1, len(w) + 1)) j, unnest(list_transform(w, lambda x: length(x))) c from b)",
        "ln as (select doc_id, row_number() over (partition by doc_id, x order by i) rn, x from (select doc_id, unnest(range(len(l))) i, unnest(l) x from b))",
        f"dl as (select doc_id, count(*) k, sum(length(regexp_replace(x, '{_SPACE_CLASS}', '', 'g'))) c from ln where rn > 1 group by 1)",
    ]
    bad = ["coalesce(dl.k, 0) > 1 and dl.k > %r::double * len(l)" % rules.line_share, "coalesce(dl.c, 0) > %r::double * greatest(1, total)" % rules.line_chars]
    joins = "left join dl on dl.doc_id = b.doc_id"
    for n, limit in (*rules.top, *rules.repeated):
        sql.append(f"g{n} as (select doc_id, i, s, row_number() over (partition by doc_id, s order by i) rn, count(*) over (partition by doc_id, s) c from (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 1))) i from b)))")
        if (n, limit) in rules.top:
            sql.append(f"x{n} as (select doc_id, max(c * (length(s) - {n - 1})) c from (select *, max(c) over (partition by doc_id) m from g{n}) where c = m and c > 2 group by 1)")
        else:
            sql.append(f"x{n} as (select doc_id, sum(c) c from (select distinct g.doc_id, g.i + k j from g{n} g, range({n}) r(k) where rn > 1) join j using (doc_id, j) group by 1)")
        joins += f" left join x{n} on x{n}.doc_id = b.doc_id"
        bad.append(f"coalesce(x{n}.c, 0) > {limit!r}::double * total")
    sql.append("r5 as (select doc_id, count(*) k from (select distinct g.doc_id, g.i + k j from g5 g, range(5) r(k) where c > 1) group by 1)")
    base = "(n < 10 or 100 * coalesce(r5.k, 0) > 20 * n)"
    return "with " + ",\n".join(sql) + f"""
    select b.doc_id, n::bigint n_words, total::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dl.k, 0)::bigint n_dup_lines, coalesce(r5.k, 0)::bigint n_repeat_words,
      {base} base_failed, not {base} and not coalesce({' or '.join(f'({x})' for x in bad)}, false) kept from b {joins} left join r5 on r5.doc_id = b.doc_id"""


def oracle_sql() -> dict:
    return {"op1_sharding": _op1_sql(), "op5_warc": _op5_sql(), "op8_url_filter": _op8_sql(), "op9_quality": _op9_sql(), "op10_mixing": _op10_sql(), "op11_prefix_trie": _op11_sql(), "op12_centroids": _op12_sql(), "op13_substrings": _op13_sql()}


def _op10_sql() -> str:
    """Raking unrolled to a dozen passes, after which it stands still."""
    names = lambda t: ", ".join(f"'{v}'" for v in t)
    cell = [f"case when {d} in ({names(t)}) then {d} else '{mixing.OTHER}' end c{k}" for k, (d, t) in enumerate(zip(MIX_DIMS, TARGETS, strict=True))]
    sql = [f"""a as (select doc_id, source, lang, case when text is null then null when regexp_matches(text, '(?i)licen[sc]e') then 'legal'
        when regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9]') then 'contact' when regexp_matches(text, '[|]') then 'table' else 'prose' end topic,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE_CLASS}+'), lambda x: x <> ''))::bigint n_tokens from documents)""",
        f"b as (select *, {', '.join(cell)} from a)",
        "w0 as (select c0, c1, c2, sum(n_tokens)::double n, 1.0::double w from b group by all)"]
    for k, t in enumerate(TARGETS):
        share = "case " + " ".join(f"when c{k} = '{v}' then {x!r}::double" for v, x in t.items()) + " end"
        sql.append(f"o{k} as (select c{k}, sum(n) n, {share} x, (select sum(n) from w0) whole from w0 group by c{k} having sum(n) > 0)")
        sql.append(f"r{k} as (select coalesce(sum(x), 0) named, 1 - coalesce(sum(x), 0) rest, coalesce(sum(n) filter (x is null), 0) others from o{k})")
        sql.append(f"t{k} as (select c{k}, whole * case when others > 0 and rest > 0 then coalesce(x, rest * n / others) when named > 0 then coalesce(x, 0) / named else n / whole end aim from o{k}, r{k})")
    at = 0
    for _ in range(12):
        for k in range(len(TARGETS)):
            sql.append(f"w{at + 1} as materialized (select c0, c1, c2, n, case when n > 0 then w * (select aim from t{k} where t{k}.c{k} = w{at}.c{k}) / sum(n * w) over (partition by c{k}) else w end w from w{at})")
            at += 1
    u = f"('0x' || substr(md5('{MIX_SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint / 4294967296.0"
    return "with " + ",\n".join(sql) + f"\nselect doc_id, topic, n_tokens, round(w, 6) weight, round(w * {MIX_RATE}, 6) expected, (floor(w * {MIX_RATE}) + ({u} < w * {MIX_RATE} - floor(w * {MIX_RATE}))::int)::int copies from b join w{at} using (c0, c1, c2)"


def _op12_sql() -> str:
    """Every vector against every centroid; a vector's cluster is the smallest of distance times 64 plus number."""
    x = "x::double"
    sql = [
        f"v as materialized (select row_number() over () id, vec_id, list_transform(embedding, lambda x: floor({CLUSTER_SCALE} * {x})::bigint) v from embeddings where len(embedding) = {CLUSTER_DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite({x}))) = {CLUSTER_DIM})",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 k, v c from v qualify k < {CLUSTERS})",
    ]
    for r in range(CLUSTER_ROUNDS + 1):
        d = f"list_sum(list_transform(range(1, {CLUSTER_DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
        sql.append(f"a{r} as materialized (select id, any_value(vec_id) vec_id, any_value(v) v, min({d} * 64 + k) m from v, c{r} group by id)")
        if r < CLUSTER_ROUNDS:
            sql.append(f"s{r} as (select m % 64 k, i, sum(v[i])::hugeint s, count(*) n from a{r}, range(1, {CLUSTER_DIM + 1}) t(i) group by all)")
            sql.append(f"l{r} as (select k, list(((s - (s % n + n) % n) // n)::bigint order by i) l from s{r} group by k)")
            sql.append(f"c{r + 1} as materialized (select k, coalesce(l, c) c from c{r} left join l{r} using (k))")
    last = CLUSTER_ROUNDS
    return "with " + ",\n".join(sql) + f"""
    select vec_id, k::int as cluster, (m // 64)::bigint distance, (sum(m // 64) over (partition by k))::bigint cluster_inertia, (sum(m // 64) over ())::bigint inertia,
      sha256(array_to_string(list_transform(c, lambda x: x::varchar), ',')) centroid_sha256 from a{last} join c{last} on k = m % 64"""


def _op13_sql() -> str:
    """Windows as MD5 of their words; doubled lengths are tried at marked words whose window of the length before repeats."""
    w = WINDOW
    sql = [
        f"a as materialized (select row_number() over () id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE_CLASS}+'), lambda x: x <> '') w from documents)",
        f"i as (select id, w, unnest(range(1, len(w) - {w - 2})) p from a where len(w) >= {w})",
        f"g as (select id, p, starts_with(md5(w[p]), '0') mark, count(*) over (partition by md5(array_to_string(w[p:p + {w - 1}], ' '))) n from i)",
        "r0 as materialized (select id, p, mark from g where n > 1)",
        f"c as (select distinct id, p + k p from r0, range({w}) t(k))",
        "l as (select id, count(*) n_removed, list(p) gone from c group by id)",
    ]
    levels = [f"select id, {w} len from r0"]
    for k in range(1, 11):
        n = w << k
        rows = f"select a.id, p, w from a join r{k - 1} using (id) where p + {n - 1} <= len(w)" + " and mark" * (k == 1)
        sql.append(f"r{k} as materialized (select id, p from (select id, p, count(*) over (partition by md5(array_to_string(w[p:p + {n - 1}], ' '))) n from ({rows})) where n > 1)")
        levels.append(f"select id, {n} from r{k}")
    sql.append(f"m as (select id, max(len)::bigint longest from ({' union all '.join(levels)}) group by id)")
    left = "case when n_removed is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end"
    return "with " + ",\n".join(sql) + f"""
    select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(array_to_string({left}, ' ')) kept_sha256, coalesce(longest, 0)::bigint longest
      from a left join l using (id) left join m using (id)"""


def _op11_sql() -> str:
    """Every prefix of every rebuilt conversation; subtrees by the paths of nodes' smallest members."""
    empty = hashlib.sha256().hexdigest()
    key = "strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')"
    return f"""
    with t as materialized (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, md5({key})) - 1 k, md5({key}) d, length(coalesce(text, ''))::bigint chars from conversations where conv_id is not null),
    h as materialized (select c, {_crc32_sql('encode(c::varchar)')} % {HEADS} h from (select distinct c from t)),
    b as (select h.c, t.k, d, chars from h join t on t.c = h.c - h.c % {TOGETHER} and t.k < h),
    nb as (select h.c, h, count(b.k) n from h left join b on b.c = h.c group by all),
    r as (select * from b union all select c, n + k - h, d, chars from nb join t using (c) where k >= h),
    p as materialized (select c, 0 as depth, '' id, '' up, 0 chars from h
      union all select c, depth, md5(s) id, case depth when 1 then '' else md5(left(s, 32 * (depth - 1)::int)) end up, chars from (select c, k + 1 as depth, chars, string_agg(d, '') over (partition by c order by k) s from r)),
    n as materialized (select depth, id, up, chars, count(*) n, min(c) least from p group by all),
    kids as (select depth - 1 as depth, up id, count(*) kids from n where depth > 0 group by all),
    m as materialized (select n.*, coalesce(kids, 0) kids from n left join kids using (depth, id)),
    sub as (select p.depth, p.id, sum((n - 1) * m.chars) saved, count(*) filter (kids = 0) leaves from m join p on p.c = m.least and p.depth <= m.depth group by all),
    e as (select depth, id, sha256(string_agg(c::varchar, ',' order by c)) ends from (select c, max(depth) as depth, arg_max(id, depth) id from p group by c) group by all)
    select m.least conv_id, m.depth::bigint as depth, u.least parent_conv_id, m.n n_convs, m.kids n_children, leaves n_leaves, saved::bigint saved_tokens, coalesce(ends, '{empty}') ends_sha256
      from m join sub using (depth, id) left join e using (depth, id) left join m u on u.depth = m.depth - 1 and u.id = m.up"""
