"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

Each text is judged alone inside a task, so the work is one pass without a shuffle. Memory per text is a
few 8-byte arrays over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from soukspark.llm.common import SPACES, free_name, lean, widened

SYMBOLS = "#*$%&|<>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on shares of a text's word characters (in code points).

    ``top``: the most frequent n-gram of each length, counted only if it occurs three times or more.
    ``repeated``: all words inside n-grams of that length that repeat an earlier one.
    ``line_share``, ``line_chars``: lines that equal an earlier line (two at least), as a share of the lines
    with a word; the characters of such lines.
    The figures are those published for MassiveText (Rae et al., 2021).
    """

    top: tuple = ((2, 0.20), (3, 0.18), (4, 0.16))
    repeated: tuple = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    line_share: float = 0.30
    line_chars: float = 0.20


def word_arrays(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the length in code points of each word of UTF-8 bytes."""
    words = raw.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    if not n:
        return hashes, np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[b]
    edge = np.diff(space.view(np.int8), prepend=1, append=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(raw) < 1 << 20 and raw.isascii():
        return hashes, last - first
    points = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=points[1:])
    return hashes, points[last] - points[first]


def rolling(hashes: np.ndarray, sizes: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, ascending, the hash of every window of so many words."""
    h, n = hashes, 1
    with np.errstate(over="ignore"):
        for size in sorted(sizes):
            while n < size and len(h):
                h = h[:-1] * _MULTIPLIER + hashes[n:]
                h ^= h >> np.uint64(29)
                n += 1
            yield size, h


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words whose start is flagged."""
    d = np.zeros(n + 1, np.int32)
    d[: len(starts)] += starts
    d[size : size + len(starts)] -= starts
    return np.cumsum(d[:n]) > 0


def measure(text: str | None, rules: RepetitionRules) -> dict:
    text = text or ""
    raw = text.encode()
    hashes, chars = word_arrays(raw)
    n, total = len(hashes), int(chars.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    if len(lines) > 1:
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_chars += len(x) - sum(map(x.count, SPACES))
            else:
                seen.add(x)
    repeat_words, failed = 0, []
    top, repeated = dict(rules.top), dict(rules.repeated)
    for size, h in rolling(hashes, tuple({5, *top, *repeated})):
        if len(h) < 2:
            continue
        order = np.argsort(h)
        s = h[order]
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.diff(new, append=len(s))
        most = int(count.max())
        if most < 2:
            continue
        if size in top and most >= 3:
            at = np.concatenate(([0], np.cumsum(chars)))
            k = order[new[count == most]]
            if most * int((at[k + size] - at[k]).max()) > top[size] * total:
                failed.append(f"top_{size}gram")
        if size in repeated or size == 5:
            flag = np.zeros(len(h), np.int32)
            flag[order] = np.repeat(count > 1, count)
            inside = covered(flag, size, n)
            if size == 5:
                repeat_words = int(inside.sum())
            if size in repeated:
                flag[np.minimum.reduceat(order, new)] = 0
                if int(chars[covered(flag, size, n)].sum()) > repeated[size] * total:
                    failed.append(f"dup_{size}gram")
    if dup_lines > 1 and dup_lines > rules.line_share * len(lines):
        failed.append("dup_lines")
    if dup_chars > rules.line_chars * max(1, total):
        failed.append("dup_line_chars")
    base = n < 10 or 100 * repeat_words > 20 * n
    return {
        "n_words": n, "word_chars": total, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words, "base_failed": base, "failed_rules": failed, "kept": not base and not failed,
    }


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "failed_rules": pa.list_(pa.string()), "kept": pa.bool_(),
}
_DDL = "n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, failed_rules: array<string>, kept: boolean"


def quality(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules(), name: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``name`` (by default ``quality``, or ``_quality`` and so on where that name is taken)
    of the measures and the verdict.

    Every row gives one row. A null or empty text has no words and fails. Other columns, nulls, repeated
    rows and an empty table pass through. Words end at ASCII white space; no text is cut.
    """
    out = name or free_name(docs, "quality")
    schema = widened(docs, f"`{out}` struct<{_DDL}>")
    at = docs.columns.index(text)

    def judge(batches):
        kind = pa.struct(list(FIELDS.items()))
        for batch in batches:
            got = pa.array([measure(x.as_py(), rules) for x in batch.column(at)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, out])

    return docs.mapInArrow(lean(judge), schema)
