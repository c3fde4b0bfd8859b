"""WARC files and a Merkle fixity audit of replicas.

A record's leaf is the hash of where it lies (offset and length) and of its bytes' SHA-256. Leaves are numbered by file and
by offset within it, and a node covers 256 consecutive numbers of the level below: an ordered range of offsets. Its digest
is that of the range's ends and of its children's numbers and digests. Trees of two replicas are built in one pass and to
one height. They are compared from the root down, and only children of nodes that differ are looked at. Under the lowest
differing nodes, records are matched by their id, so a record that was lost or gained in the middle of a file is named,
and those after it are told apart as moved. Texts are hashed where they are read; only digests are shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soukspark.llm.common import cut, free_name

#: Children of a node are 2 to this power.
FAN = 8
#: Equal records that are kept together, at most; more are dealt over further files.
TOGETHER = 1000
#: Bytes of records read at once.
AT_ONCE = 1 << 22
END = "\r\n\r\n"


def record(url: str, body: str, date: str, key: str) -> Column:
    """A resource record as a string, its end included. A null URL is left out, a null body is empty."""
    safe = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    m = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.coalesce(F.col(body), F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe, F.lit("\r\n")), F.lit("")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: ")),
        F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, text, F.lit(END))


def bucket(key: str | Column, n: Column | int) -> Column:
    """A number below n that the key decides."""
    key = F.col(key) if isinstance(key, str) else key
    m = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(m, 1, 8), 16, 10).cast("long") % n


def spot(key: str, digest: str) -> Column:
    """What decides a record's file: its key and digest, so that records of one key are dealt over files."""
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(digest))


def placed(records: DataFrame, files: int, key: str) -> DataFrame:
    """``records`` (``length``, ``digest``, ``key`` and any others) with ``file`` and ``offset`` (underscores in front where
    a name is taken): order in a file is that of the key (nulls first), then of the digest.

    Key and digest decide the file; of rows that are equal in all columns, every ``TOGETHER`` go to the next one, so
    neither a common key nor a common row makes one file or window. An empty table gives an empty table.
    """
    file, offset, n, part, step = (free_name(records, x) for x in ("file", "offset", "n", "part", "step"))
    one = records.groupBy(*records.columns).agg(F.count("*").alias(n))
    parts = one.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / TOGETHER))))
    parts = parts.withColumn(n, F.least(F.col(n) - F.col(part) * TOGETHER, F.lit(TOGETHER)))
    parts = parts.withColumn(file, F.pmod(bucket(spot(key, "digest"), files) + F.col(part), F.lit(files)))
    # a window is one file's distinct records
    w = Window.partitionBy(file).orderBy(key, "digest", part, *[c for c in records.columns if c not in (key, "digest")]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(offset, F.coalesce(F.sum(F.col("length") * F.col(n)).over(w), F.lit(0)).cast("long"))
    out = parts.withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    return out.select(*records.columns, file, (F.col(offset) + F.col(step) * F.col("length")).alias(offset))


def _tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels of ``(side, node, lo, hi, digest)`` above the leaves, from the lowest to the root; lo and hi: where the range of
    offsets begins and ends."""
    own = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").cast("binary"), 256)
    levels, below = [], leaves.select("side", "node", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), own.alias("digest"))
    for _ in range(height):
        pairs = F.array_sort(F.collect_list(F.struct("node", "digest")))  # 2^FAN children at most
        text = F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), ",")
        whole = F.concat_ws("-", F.min("lo").cast("string"), F.max("hi").cast("string"), text)
        up = below.groupBy("side", F.shiftright("node", FAN).alias("up")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(whole.cast("binary"), 256).alias("digest"))
        below = cut(up.withColumnRenamed("up", "node"))
        levels.append(below)
    return levels


def _differing(level: DataFrame) -> DataFrame:
    """Nodes of a level that the two sides do not have alike."""
    own = lambda s: F.max(F.when(F.col("side") == s, F.col("digest")))
    return level.groupBy("node").agg(own(0).alias("da"), own(1).alias("db")).where(~F.col("da").eqNullSafe(F.col("db"))).select("node")


def audit(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """``file, offset, fault`` of records on which two replicas (``file, offset, length, digest``) differ, and ``key`` if given.

    With ``key``, the id of a record, records of one file are matched by it, equal ids in the order of their offsets: one
    whose bytes differ is ``changed``, one that only lies elsewhere ``moved``, one that b lacks ``missing``, one that only b
    has ``extra`` (offset in b, else in a). Without, they are matched by their place in the file. Offsets of a file must
    differ. A null key matches a null one. Equal replicas, empty ones included, give no rows.
    """
    own = F.col(key).cast("string") if key else F.lit("")
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col("file").cast("long"), F.col("offset").cast("long"), F.col("length").cast("long"), "digest", own.alias("id"))
    n = F.row_number().over(Window.partitionBy("side", "file").orderBy("offset")).cast("long") - 1  # one file's records
    rows = cut(side(a, 0).unionAll(side(b, 1)).withColumn("n", n))
    most = rows.agg(F.max("n").alias("n"), F.max("file").alias("f")).first()
    out = "file long, offset long, fault string"
    if most.n is None:
        return rows.sparkSession.createDataFrame([], f"{out}, {key} string" if key else out)
    levels_of = lambda x: -(-int(x).bit_length() // FAN)
    bits = max(1, levels_of(most.n)) * FAN
    leaves = rows.withColumn("node", F.shiftleft("file", bits).bitwiseOR(F.col("n")))
    tree = _tree(leaves, bits // FAN + levels_of(most.f))
    bad = _differing(tree[-1])
    for level in reversed(tree[:-1]):
        bad = _differing(level.join(bad.withColumnRenamed("node", "up"), F.shiftright("node", FAN) == F.col("up"), "left_semi"))
    found = leaves.join(bad.withColumnRenamed("node", "up"), F.shiftright("node", FAN) == F.col("up"), "left_semi")
    if key:
        nth = F.row_number().over(Window.partitionBy("side", "file", "id").orderBy("offset"))
    else:
        nth = F.col("n")
    found = found.withColumn("nth", nth)
    one = lambda s: F.max(F.when(F.col("side") == s, F.struct("digest", "length", "offset")))
    pairs = found.groupBy("file", "id", "nth").agg(one(0).alias("x"), one(1).alias("y")).where("not (x <=> y)")
    fault = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when((F.col("x.digest") == F.col("y.digest")) & (F.col("x.length") == F.col("y.length")), "moved").otherwise("changed")
    return pairs.select("file", F.coalesce("x.offset", "y.offset").alias("offset"), fault.alias("fault"), *([F.col("id").alias(key)] if key else []))


def write(pages: DataFrame, path: str, files: int, url: str = "url", body: str = "html", key: str = "page_id", date: str = "2024-01-01T00:00:00Z") -> None:
    """WARC files of resource records: ``file=k/part-*`` under ``path``, in key order, ties by digest.

    Key and digest decide a record's file, so rows that are equal in both share one. A null body is empty, a null URL is
    left out, other columns are not written; an empty table writes no file. A body of any length is one record.
    """
    # the writer's line end is the end of a record
    text = F.expr(f"substring(value, 1, length(value) - {len(END)})")
    rows = pages.select(record(url, body, date, key).alias("value"), F.col(key).alias("_key"))
    rows = rows.withColumn("_digest", F.sha2(F.col("value").cast("binary"), 256)).withColumn("file", bucket(spot("_key", "_digest"), files))
    rows = rows.repartition("file").sortWithinPartitions("file", "_key", "_digest")
    rows.select(text.alias("value"), "file").write.partitionBy("file").option("lineSep", END).option("compression", "none").text(path)


def parse(raw: bytes):
    """``(offset, length, headers, body)`` of each record of an uncompressed WARC file."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        lines = raw[at:stop].split(b"\r\n") if stop >= 0 else []
        if not lines or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a record at byte {at}")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        end = stop + 4 + int(headers["content-length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        yield at, end + 4 - at, headers, raw[stop + 4 : end]
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, length, digest, id, url, body`` of the records of files that ``write`` made; id: WARC-Record-ID.

    A file is one task's value (2 GB at most: choose ``files`` by the bytes of the pages); its records come out some
    megabytes at a time. A folder without files gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("long").alias("file"), "content")
    names = ["file", "offset", "length", "digest", "id", "url", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def of(batches):
        put = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for file, raw in zip(batch.column(0), batch.column(1), strict=True):
                raw, held, size = raw.as_py(), [], 0
                for at, n, headers, body in parse(raw):
                    held.append((file.as_py(), at, n, hashlib.sha256(raw[at : at + n]).hexdigest(), headers.get("warc-record-id"), headers.get("warc-target-uri"), body))
                    size += n
                    if size >= AT_ONCE:
                        yield put(held)
                        held, size = [], 0
                if held:
                    yield put(held)

    return files.mapInArrow(of, "file long, offset long, length long, digest string, id string, url string, body binary")
