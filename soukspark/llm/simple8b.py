"""Token-id files in Simple-8b: as many ids as fit in each 64-bit word.

The top 4 bits of a word select how many ids of how many bits it holds. Ids of more than 60 bits go to a table of
escapes. A segment holds whole documents, about half a million ids, with a table of documents and, for each block of
1024 ids, the offset of its first word, so that blocks are coded and decoded together in numpy.

Texts are encoded where they are read, and only ids are shuffled. Files are written by Spark's text writer (segments
are binary rows, each ended by a line feed; it writes bytes of any value as they are, which a test holds) and read as
binary files, so both work on any store that Spark can reach. Documents are dealt by ranges of their key; range k
holds what comes before range k + 1, in files of a bounded size. Segments carry their range and how many ids come before
them in it, so each file can be read by itself.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soukspark.llm.common import cut, partitions

#: Fixed values of the format: ids in a word and bits of an id, by selector. Selector 0 is an escape: the low
#: bits are an index into the segment's escapes. Selector 1 is a run of 120 zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
_MAGIC = b"S8BT"
#: magic, version, number of the range, documents, blocks, escapes, words, ids, ids before it in its range
_HEAD = struct.Struct("<4sIIIIIQQQ")
#: Window sizes in ascending order, each as the maximum of two windows of an earlier size.
_WINDOWS = ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 15, 5), (30, 15, 15), (60, 30, 30), (120, 60, 60))


_BITS16 = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if ids.size and ids.max() < 1 << 16:
        return _BITS16[ids]
    out = np.zeros(ids.shape, np.uint8)
    rest = ids.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(shift)
        out[big] += shift
        rest[big] >>= np.uint64(shift)
    return out + (rest > 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the offset of each block's first word (and the end), escapes."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    width = BLOCK + int(COUNTS.max())
    value = np.zeros((blocks, width), np.uint64)
    value[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = _bits(value)
    most = {1: bits}
    choice = np.where(bits > 60, 0, 15).astype(np.uint8)
    selector = {int(c): k for k, c in enumerate(COUNTS) if k}
    for size, half, shift in _WINDOWS:
        w = most[half]
        m = w.copy()
        np.maximum(w[:, :-shift], w[:, shift:], out=m[:, :-shift])
        most[size] = m
        choice[m <= BITS[selector[size]]] = selector[size]
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    at, live, got = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        p = at[live]
        s = choice[live, p]
        got.append((live, p, s))
        at[live] = p + COUNTS[s]
        live = live[at[live] < length[live]]
    block, p, s = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(block, kind="stable")
    block, p, s = block[order], p[order], s[order]
    words = s.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    place, every = block * width + p, value.ravel()
    for k in np.unique(s):
        rows = np.flatnonzero(s == k)
        if k == 0:
            escapes = every[place[rows]]
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
        elif k > 1:
            at, word = place[rows], words[rows]
            for j in range(COUNTS[k]):
                word |= every.take(at + j) << np.uint64(j * BITS[k])
            words[rows] = word
    offsets = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(block, minlength=blocks), out=offsets[1:])
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    s = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[s]
    before = np.cumsum(count) - count
    per = np.diff(offsets.astype(np.int64))
    block = np.repeat(np.arange(len(per)), per)
    start = block * BLOCK + before - before[offsets[:-1].astype(np.int64)][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        rows = np.flatnonzero(s == k)
        if k == 0:
            out[start[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif k > 1:
            j = np.arange(COUNTS[k])
            held = (words[rows, None] >> (j * BITS[k]).astype(np.uint64)) & np.uint64((1 << int(BITS[k])) - 1)
            to = start[rows, None] + j
            ok = to < end[rows, None]
            out[to[ok]] = held[ok]
    return out


def segment(number: int, before: int, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    head = _HEAD.pack(_MAGIC, 2, number, len(keys), len(offsets) - 1, len(escapes), len(words), len(ids), before)
    key = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype("<i8")
    null = keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    parts = (key, null, sizes.astype("<u8"), offsets.astype("<u4"), escapes.astype("<u8"), words.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts)


def segments(raw: bytes):
    """``(range, ids before it there, keys, ids of each document)`` of each segment of a file."""
    at = 0
    while at < len(raw):
        magic, version, number, n_docs, n_blocks, n_escapes, n_words, n_ids, before = _HEAD.unpack_from(raw, at)
        if magic != _MAGIC or version != 2:
            raise ValueError(f"not a segment at byte {at}")
        at += _HEAD.size

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        key, null, sizes = take("<i8", n_docs), take(np.uint8, n_docs), take("<u8", n_docs)
        offsets, escapes, words = take("<u4", n_blocks + 1), take("<u8", n_escapes), take("<u8", n_words)
        ids = unpack(words, offsets, escapes, n_ids)
        yield number, before, pa.array(key, pa.int64(), mask=null.astype(bool)), np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]) if n_docs else []
        if raw[at : at + 1] != b"\n":
            raise ValueError(f"no end of segment at byte {at}")
        at += 1


#: Pieces whose ids a worker remembers; the longest one it does (characters); bytes of text encoded at once.
REMEMBERED, LONGEST, AT_ONCE = 1_000_000, 32, 1 << 22
#: Goes where a text may be split; no character.
_CUT = "\U0010ffff"
_SOLID = r"[^\s\x0b\x1c-\x1f\x85\pZ]"


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct piece.

    Byte-level BPE splits text before every space that a non-space follows, between a letter and a comma or
    full stop, and around a line feed between non-spaces, and merges nothing over such places; ids of a text
    are therefore those of its pieces one after another. Arrow makes the cuts and finds the distinct pieces of
    a batch. The library gets those not seen before, words joined into longer texts; byte lengths of the ids
    tell where each ends.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.bytes_of = np.array([len(self.library.id_to_token(k) or "") for k in range(self.library.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, names: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        got = list(map(known.get, names))
        new = [k for k, x in enumerate(got) if x is None]
        words = [k for k in new if names[k][:1] == " "]
        for at in range(0, len(words), 1000):
            group = [names[k] for k in words[at : at + 1000]]
            (raw,) = self.ask(["".join(group)])
            ends = np.cumsum([len(p.encode()) for p in group])
            stops = ((np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(raw, np.uint32)]), ends) + 1) * 4).tolist()
            start = 0
            for k, stop in zip(words[at : at + 1000], stops, strict=True):
                got[k] = raw[start:stop]
                start = stop
        others = [k for k in new if got[k] is None]
        for k, raw in zip(others, self.ask([names[k] for k in others]), strict=True):
            got[k] = raw
        known.update((names[k], got[k]) for k in new if len(names[k]) <= LONGEST)
        return got

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-null texts one after another, and how many each text has."""
        whole = pc.match_substring(texts, _CUT)
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        cut = pc.replace_with_mask(texts, whole, pa.scalar("", texts.type))
        odd = pc.match_substring_regex(cut, r" [\s\x0b\x1c-\x1f\x85\pZ]| $")
        simple = pc.replace_substring(cut, " ", _CUT + " ")
        cut = pc.if_else(odd, pc.replace_substring_regex(cut, f" ({_SOLID})", _CUT + r" \1"), simple) if pc.any(odd).as_py() else simple
        cut = pc.replace_substring_regex(cut, r"(\pL)([,.])", r"\1" + _CUT + r"\2")
        cut = pc.replace_substring_regex(cut, f"({_SOLID})\n({_SOLID})", r"\1" + f"{_CUT}\n{_CUT}" + r"\2")
        split = pc.split_pattern(cut, _CUT)
        offsets = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = self.pieces(coded.dictionary.to_pylist())
        direct = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(direct):  # their one piece is the empty one
            code[offsets[direct]] = len(held) + np.arange(len(direct))
            held += self.ask([texts[int(k)].as_py() for k in direct])
        if end_id is not None:
            code = np.insert(code, offsets[1:], len(held))
            offsets = offsets + np.arange(len(offsets))
            held.append(np.uint32(end_id).tobytes())
        n = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, at = np.frombuffer(b"".join(held), np.uint32), np.cumsum(n) - n
        size = n[code]
        ends = np.cumsum(size)
        out = ids[np.repeat(at[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.concatenate(([0], ends))[offsets])


def by_bytes(texts: pa.Array, most: int = AT_ONCE):
    """Ranges of rows of about so many bytes, one row at least."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    ends = np.cumsum(size)
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, special_as_text: bool) -> PieceEncoder:
    """One encoder for each file and worker."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = PieceEncoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]


#: Bytes of a file, about, and ids of a segment: what is held at once.
FILE_BYTES, SEGMENT_IDS = 1 << 27, 1 << 19
#: Rows that the bounds of ranges are drawn from, at most.
SAMPLE = 200_000
#: Rows of the sample for each range, at least, unless the session asks for more tasks.
EACH = 20


def sortable(keys: pa.Array, ties: np.ndarray) -> np.ndarray:
    """Bytes that sort as (null first, key, tie) does."""
    out = np.zeros((len(keys), 13), np.uint8)
    out[:, 0] = ~keys.is_null().to_numpy(zero_copy_only=False)
    key = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out[:, 1:9] = (key.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = ties.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.view("S13").ravel()


def bounds(rows: DataFrame, file_bytes: int) -> np.ndarray:
    """The first (key, tie) of each range but the first, from a bounded sample of ``key, text``; bounds may repeat where
    many rows are equal."""
    total = rows.count()  # of files' footers
    tie = F.crc32(F.col("text").cast("binary"))
    every = 2 * total <= SAMPLE
    drawn = rows if every else rows.sample(SAMPLE / 2 / total, 5)  # a binomial number of rows
    drawn = drawn.select("key", tie.alias("tie"), F.octet_length("text").alias("n")).toArrow()
    if not len(drawn):
        return np.zeros(0, "S13")
    # an id stands for about two bytes of text at least and takes up two in a file
    size = drawn.column("n").to_numpy().astype(np.float64) + 1
    # a range is a task and may come to several files; each is to have rows of the sample enough to be even
    ranges = max(partitions(rows.sparkSession), min(int(size.sum() * total / len(drawn) / file_bytes), len(drawn) // (1 if every else EACH)))
    order = np.argsort(names := sortable(drawn.column("key").combine_chunks(), drawn.column("tie").to_numpy()), kind="stable")
    share = np.cumsum(size[order])
    at = np.searchsorted(share, share[-1] * np.arange(1, ranges) / ranges)
    return names[order][at]


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, special_as_text: bool, starts: np.ndarray) -> DataFrame:
    """``range, key, tie, n, ids`` of ``key, text``: the ids of every row as little-endian bytes, two of an id where all
    fit. Of ranges that could hold a row, its place in its task decides."""
    names = ["range", "key", "tie", "n", "ids"]

    def of(batches):
        tool = encoder(tokenizer, special_as_text)
        place = 0
        for batch in batches:
            for start, stop in by_bytes(batch.column(1)):
                part = batch.slice(start, stop - start)
                ids, sizes = tool.encode(part.column(1), end_id)
                tie = np.array([zlib.crc32(x) for x in part.column(1).cast(pa.binary()).to_pylist()], np.int64)
                own = sortable(part.column(0), tie)
                low, high = np.searchsorted(starts, own), np.searchsorted(starts, own, "right")
                number = low + np.arange(place, place + len(own)) % (high - low + 1)
                place += len(own)
                ends = np.concatenate(([0], np.cumsum(sizes))) * width
                held = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                columns = [pa.array(number.astype(np.int32)), part.column(0), pa.array(tie), pa.array(sizes.astype(np.int64)), held.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = id_type(tokenizer, special_as_text, end_id)
    width = np.dtype(kind).itemsize
    return docs.mapInArrow(of, "range int, key long, tie long, n long, ids binary")


def id_type(tokenizer: str, special_as_text: bool, end_id: int | None) -> str:
    most = max(encoder(tokenizer, special_as_text).library.get_vocab_size(), (end_id or 0) + 1)
    return "<u2" if most <= 1 << 16 else "<u4"


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id", file_bytes: int = FILE_BYTES, special_as_text: bool = False
) -> None:
    """Encodes every text and writes the ids in ascending key order (nulls first; ties by the text's checksum).

    A null or empty text has only ``end_id``. Files hold about ``file_bytes`` at most, or one segment; a segment is cut
    once it has ``SEGMENT_IDS`` ids, so one of a very long text has more. ``special_as_text``: special tokens' strings in
    a text are ordinary text; otherwise they are special tokens, as by the library's defaults. Rows that repeat a key and
    text are written as often and may be dealt over several ranges. An empty table gives no documents. Keys are whole
    numbers; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    starts, kind = bounds(rows, file_bytes), id_type(tokenizer, special_as_text, end_id)
    dealt = encoded(rows, tokenizer, end_id, special_as_text, starts)
    dealt = dealt.repartitionById(len(starts) + 1, F.col("range")).sortWithinPartitions("key", "tie")
    # two bytes of an id in a file, about; a segment of them is a record of the writer
    records = max(1, file_bytes // (2 * SEGMENT_IDS))

    def of(batches):
        number, before = TaskContext.get().partitionId(), 0
        held, n = [], 0

        def put():
            nonlocal before, held, n
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), kind)
            raw = segment(number, before, rows.column("key").combine_chunks(), rows.column("n").to_numpy(), ids)
            before, held, n = before + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for batch in batches:
            start, ends = 0, np.cumsum(batch.column(1).to_numpy())
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, done + SEGMENT_IDS - n, "left")) + 1))
                held.append(batch.slice(start, stop - start))
                n += int(ends[stop - 1]) - done
                start = stop
                if n >= SEGMENT_IDS:
                    yield put()
        if held:
            yield put()

    out = dealt.select("key", "n", "ids").mapInArrow(of, "segment binary").select(F.col("segment").cast("string").alias("value"))
    out.write.option("compression", "none").option("maxRecordsPerFile", records).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, range, before`` (ids before it in its range) and, ``with_ids``, ``ids``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["doc_id", "n_tokens", "ids_crc32", "range", "before"]

    def of(batches):
        for batch in batches:
            for raw in batch.column(0):
                for number, before, keys, docs in segments(raw.as_py()):
                    sizes = np.array([len(x) for x in docs], np.int64)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]
                    columns = [keys, pa.array(sizes), pa.array(crc, pa.int64()), pa.array([number] * len(docs), pa.int32()), pa.array(before + np.cumsum(sizes) - sizes)]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

    return files.mapInArrow(of, "doc_id long, n_tokens long, ids_crc32 long, range int, before long" + ", ids array<long>" * with_ids)


def index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; start: ids of all before it."""
    rows = cut(read(spark, path, False))
    # one row for each range, of which there are as many as tasks wrote
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.join(F.broadcast(starts), "range")
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
