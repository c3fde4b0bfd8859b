"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

Pieces have word marks at their front only, so a text's lattice falls apart into words, each with the run of spaces
before it, and equal words share one forward pass. Long words, such as text without spaces, fall apart further, at
characters that no piece has side by side. Forward sums of all distinct words of a batch are filled position by
position together; backward draws of all words of a batch are made together, one piece a step. A draw is a hash of
the row's key, the seed and the place in the text, so a row's segmentation is the same however rows are batched.
Every text decodes to itself.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from soukspark.llm.common import free_name, lean, widened

MARK = "▁"
#: Stands for a mark in the text itself, which has to be spelled in bytes; no text can hold this character.
_OWN_MARK = "\ud800"
#: Characters of a word up to which words are handled together; longer ones go one by one.
TOGETHER = 40
#: Characters of a long part that noise is drawn for at once.
_BLOCK = 1 << 16
#: Bytes of text handled at once, words whose forward sums are made at once, and how many a worker remembers.
AT_ONCE, LEARNED, REMEMBERED = 1 << 21, 10_000, 250_000


class Lattice:
    """Pieces of a model with weights for sampling.

    A unigram model's scores are log probabilities. A BPE model's scores are the negative ranks of its merges;
    there, a piece of rank r has log probability -log(r + 2), by Zipf's law. ``alpha`` sharpens (above 1) or
    flattens (below 1) the distribution over segmentations; 0 makes all equally likely.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(k) for k in range(n)]
        usual = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        scores = {k: sp.get_score(k) for k in usual}
        ranks = all(float(x).is_integer() and x <= 0 for x in scores.values())
        self.weight = {k: math.exp(alpha * (-math.log(2 - x) if ranks else x)) for k, x in scores.items()}
        # a piece with a mark after another character would let two words share it
        self.ids = {self.names[k]: k for k in usual if MARK not in self.names[k].lstrip(MARK)}
        self.longest = max((len(x) for x in self.ids), default=1)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(k) for k in self.byte):
            raise ValueError("the model has no byte pieces, so not every text could be decoded")
        # a character without a piece is spelled in bytes, as one step of this weight
        self.unknown = min(self.weight.values(), default=1.0)
        self.weights = np.array([self.unknown, *[self.weight.get(k, 0.0) for k in range(n)]])
        self.spelling = [bytes([self.byte.index(k)]) if sp.is_byte(k) else x.encode().replace(MARK.encode(), b" ") for k, x in enumerate(self.names)]
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.spelled_size = np.fromiter(map(len, self.spelling), np.int32, n)
        self._tree()
        self.forget()

    def forget(self) -> None:
        """Words learned so far: where their places start, their sizes; of each place the first arc and how many
        end there; of each arc the cumulative probability among those of its place, and its size and id."""
        self.known: dict[str, int] = {}
        self.base, self.size = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.chance, self.arc = np.zeros(0, np.float32), np.zeros(0, np.int32)

    def _tree(self) -> None:
        """The prefixes of all pieces as nodes, and an open hash table from node and character to node."""
        nodes, piece, kinds, edges = {"": 0}, [0], {}, []
        for name, k in self.ids.items():
            for m in range(1, len(name) + 1):
                if name[:m] not in nodes:
                    nodes[name[:m]] = len(piece)
                    piece.append(0)
                    edges.append((nodes[name[: m - 1]], kinds.setdefault(name[m - 1], len(kinds) + 1), nodes[name[:m]]))
            piece[nodes[name]] = k + 1
        self.kind = np.zeros(0x110000, np.int32)
        for c, k in kinds.items():
            self.kind[ord(c)] = k
        self.piece, self.kinds = np.array(piece, np.int64), len(kinds) + 1
        self.pairs = np.array(sorted({kinds[a] * self.kinds + kinds[b] for name in self.ids for a, b in zip(name, name[1:])}), np.int64)
        self.bits = max(16, (8 * len(edges)).bit_length())
        self.key, self.node = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        edge = np.array(edges, np.int64).reshape(-1, 3)
        keys, values = edge[:, 0] * self.kinds + edge[:, 1], edge[:, 2]
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] < 0)
            slots, own = np.unique(at[free], return_index=True)
            self.key[slots], self.node[slots] = keys[free[own]], values[free[own]]
            rest = np.ones(len(keys), bool)
            rest[free[own]] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The node of each key; 0: none."""
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.node[at], 0)
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.key) - 1)
            held = self.key[at[on]]
            hit = held == keys[on]
            out[on[hit]] = self.node[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def _found(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces in the words, by place of their end: the place, and size and id as one number."""
        chars = self.kind[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
        shift = np.repeat(np.arange(len(size)), size)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        places, codes = [], []
        for m in range(1, self.longest + 1):
            if m > 1:
                on = np.flatnonzero(left[at] >= m)
                at, node = at[on], node[on]
            node = self._next(node * self.kinds + chars[at + m - 1])
            k = self.piece[node] * (node > 0)
            hit = np.flatnonzero(k) if m > 1 else np.arange(len(at))  # a character without a piece: bytes
            places.append(at[hit] + shift[at[hit]] + m)
            codes.append(m << 16 | k[hit])
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
        place, code = np.concatenate(places), np.concatenate(codes).astype(np.int32)
        order = np.argsort(place, kind="stable")
        return place[order], code[order]

    def parts(self, word: str) -> list[str]:
        """A word cut between characters that no piece has side by side; no segmentation crosses such a place."""
        chars = self.kind[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        pair = chars[:-1] * self.kinds + chars[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        cut = np.flatnonzero(self.pairs[at] != pair) + 1 if len(self.pairs) else np.arange(1, len(word))
        return [word[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(word)], strict=True)]

    def learn(self, words: list[str]) -> None:
        """Adds the forward sums of new words."""
        if not words:
            return
        places, arcs = len(self.first), len(self.arc)
        got = [[self.base], [self.size], [self.first], [self.count], [self.chance], [self.arc]]
        for k in range(0, len(words), LEARNED):
            base, size, first, count, chance, arc = self._sums(words[k : k + LEARNED])
            for held, x in zip(got, (base + places, size, first + arcs, count, chance, arc), strict=True):
                held.append(x.astype(held[0].dtype))
            places, arcs = places + len(first), arcs + len(arc)
        self.known.update(zip(words, range(len(self.base), len(self.base) + len(words)), strict=True))
        self.base, self.size, self.first, self.count, self.chance, self.arc = map(np.concatenate, got)

    def _sums(self, words: list[str]) -> tuple:
        """Forward sums of words, filled for all of them together, one end after another."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(size + 1) - size - 1
        place, code = self._found(words, size)
        count = np.bincount(place, minlength=int(size.sum()) + len(size))
        first = np.cumsum(count) - count
        end = (np.arange(len(count)) - np.repeat(base, size + 1))[place].astype(np.uint8)
        weight, before = self.weights[code & 0xFFFF], place - (code >> 16)
        total, share = np.zeros(len(count)), np.zeros(len(code))
        total[base] = 1.0
        order = np.argsort(end, kind="stable")
        bounds = np.searchsorted(end[order], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            got = total[before[rows]] * weight[rows]
            starts = np.flatnonzero(np.diff(place[rows], prepend=-1))
            total[place[rows[starts]]] = np.add.reduceat(got, starts)
            share[rows] = got
        share /= total[place]
        run = np.cumsum(share)
        chance = run - np.concatenate(([0.0], run))[first][place]
        return base, size, first, count, chance, code

    def ending(self, word: str, e: int) -> list[tuple[int, int]]:
        """Length and id of each piece of a word that ends at a place, shortest first; id -1: the character in bytes."""
        get = self.ids.get
        out = [(m, k) for m in range(1, min(e, self.longest) + 1) if (k := get(word[e - m : e])) is not None]
        return out if out and out[0][0] == 1 else [*out, (1, -1)]


def _noise(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row's hash and place (splitmix64)."""
    with np.errstate(over="ignore"):
        z = row + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def seed_of(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{key!r}".encode())


def sample(lattice: Lattice, word: np.ndarray, row: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Backward draws for occurrences of learned words, of which row's hash, starting where in its text. For
    each step the occurrences that still had a piece, its end within them, and its id (-1: bytes)."""
    live, end = np.arange(len(word), dtype=np.int32), lattice.size[word].astype(np.int32)
    base = lattice.base[word]
    out = []
    while len(live):
        e = end[live]
        at = base[live] + e
        u = _noise(row[live], place[live] + e).astype(np.float32)
        pick = lattice.first[at]
        last = pick + lattice.count[at] - 1
        on = np.flatnonzero((pick < last) & (lattice.chance[pick] <= u))
        while len(on):
            pick[on] += 1
            on = on[(pick[on] < last[on]) & (lattice.chance[pick[on]] <= u[on])]
        code = lattice.arc[pick]
        out.append((live, e, (code & 0xFFFF) - 1))
        end[live] = e - (code >> 16)
        live = live[end[live] > 0]
    return out


def sample_long(lattice: Lattice, word: str, row: np.uint64, place: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one word of any length: ends and ids of its pieces, last first. Held for each character are its sum, with
    a scale, and one piece; the lattice's arcs are looked up where they are needed, and noise is drawn a block at a time."""
    n = len(word)
    total, scale = array("d", [1.0]), array("d", [0.0])  # of the sum up to here: total * exp(scale)
    for e in range(1, n + 1):
        base, s = scale[-1], 0.0
        for m, k in lattice.ending(word, e):
            s += total[e - m] * math.exp(scale[e - m] - base) * (lattice.unknown if k < 0 else lattice.weight[k])
        total.append(1.0), scale.append(base + math.log(s))
    out_e, out_k, e, low = array("q"), array("q"), n, n + 1
    while e > 0:
        if e < low:
            low = max(0, e - _BLOCK)
            noise = _noise(np.full(e - low + 1, row, np.uint64), place + np.arange(low, e + 1))
        arcs = lattice.ending(word, e)
        w = [math.exp(scale[e - m] - scale[e]) * (lattice.unknown if k < 0 else lattice.weight[k]) for m, k in arcs]
        u, k = noise[e - low] * math.fsum(w), 0
        while k + 1 < len(w) and u >= w[k]:
            u -= w[k]
            k += 1
        out_e.append(e), out_k.append(arcs[k][1])
        e -= arcs[k][0]
    return np.frombuffer(out_e, np.int64), np.frombuffer(out_k, np.int64)


def units(lattice: Lattice, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of non-null texts, each with the marks before it, or parts of long ones; which of them come one
    after another in all texts; and the text of each."""
    # a word stands for a space before it too; marks in the text get a sign before them
    split = pc.split_pattern(pc.replace_substring(texts, MARK, "\0" + MARK), " ")
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    words = [MARK + w.replace("\0" + MARK, _OWN_MARK) for w in names]
    if "" in names:
        # nothing between two spaces: one more mark for the next word of the text, or for the last nothing
        empty = code == names.index("")
        last = np.zeros(len(code), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        end = np.flatnonzero(~empty | last)
        more = np.diff(end, prepend=-1) - 1
        code, text = more * len(words) + code[end], text[end]
        kinds, code = np.unique(code, return_inverse=True)
        words = [MARK * (k // len(words)) + words[k % len(words)] for k in kinds.tolist()]
    long = [k for k, w in enumerate(words) if len(w) > TOGETHER]
    if long:
        known = {w: k for k, w in enumerate(words)}
        flat, count = [], np.ones(len(words), np.int64)
        of = {k: [known.setdefault(p, len(known)) for p in lattice.parts(words[k])] for k in long}
        for k in range(len(words)):
            flat += of.get(k, [k])
            count[k] = len(of[k]) if k in of else 1
        start, n = np.cumsum(count) - count, count[code]
        at = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        code, text, words = np.array(flat, np.int64)[at], np.repeat(text, n), list(known)
    return words, code, text


def encode(lattice: Lattice, texts: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of non-null texts one after another, and how many each text has."""
    words, code, text = units(lattice, texts)
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.cumsum(sizes[code], dtype=np.int32) - sizes[code]
    place -= np.repeat(place[np.minimum(first, max(0, len(place) - 1))], n)
    row = seeds[text]
    if len(lattice.known) > REMEMBERED:
        lattice.forget()
    lattice.learn([w for w in words if len(w) <= TOGETHER and w not in lattice.known])
    learned = np.fromiter((lattice.known.get(w, -1) for w in words), np.int32, len(words))[code]
    short = np.flatnonzero(learned >= 0)
    steps = [(short[live], end, ids, k) for k, (live, end, ids) in enumerate(sample(lattice, learned[short], row[short], place[short]))]
    for k in np.flatnonzero(learned < 0):
        ends, ids = sample_long(lattice, words[code[k]], row[k], int(place[k]))
        steps.append((np.full(len(ids), k), ends, ids, np.arange(len(ids))))
    pieces = np.zeros(len(code), np.int32)
    for at, _, _, step in steps:
        if np.ndim(step):
            pieces[at[0]] += len(at)
        else:
            pieces[at] += 1
    after = np.cumsum(pieces, dtype=np.int32)
    out, spelled = np.zeros(int(after[-1]) if len(after) else 0, np.int32), []
    for at, end, ids, step in steps:
        to = after[at] - 1 - step
        out[to] = ids
        for j in np.flatnonzero(ids < 0).tolist():
            spelled.append((int(to[j]), words[code[at[j]]][end[j] - 1]))
    count = np.bincount(text, weights=pieces, minlength=len(n)).astype(np.int64)
    if spelled:
        times, flat = np.ones(len(out), np.int64), {}
        for j, c in spelled:
            flat[j] = [lattice.byte[b] for b in (MARK if c == _OWN_MARK else c).encode()]
            times[j] = len(flat[j])
        start = np.cumsum(times) - times
        bounds = np.concatenate(([0], np.cumsum(count)))
        count = np.diff(np.concatenate((start, [times.sum()]))[bounds])
        out = np.repeat(out, times)
        for j, v in flat.items():
            out[start[j] : start[j] + len(v)] = v
    return out, count


def spell(lattice: Lattice, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of ids, marks as spaces, and how many each id has."""
    size = lattice.spelled_size[ids]
    ends = np.cumsum(size, dtype=np.int64)
    start = (np.cumsum(lattice.spelled_size) - lattice.spelled_size)[ids]
    at = np.repeat((start - (ends - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return lattice.spelled[at], size


def decode(lattice: Lattice, ids) -> str:
    """The text of ids of one text: without the space before its first word."""
    return spell(lattice, np.asarray(ids, np.int64))[0].tobytes().decode()[1:]


def lossless(lattice: Lattice, texts: pa.Array, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which texts their ids decode to."""
    raw, size = spell(lattice, ids)
    bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.concatenate(([0], np.cumsum(size)))[bounds]
    own = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = np.diff(at) == own + 1
    if ok.all():
        held = b" " + b" ".join(texts.cast(pa.binary()).to_pylist())
        if raw.tobytes() == held:
            return ok
    for k in np.flatnonzero(ok):
        ok[k] = raw[at[k] + 1 : at[k + 1]].tobytes() == texts[int(k)].as_py().encode()
    return ok


_LATTICES: dict[tuple, Lattice] = {}


def lattice_of(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def _ranges(texts: pa.Array):
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield start, stop
        start = stop


def encoded(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", alpha: float = 1.0, seed: int = 0, check: bool = True) -> DataFrame:
    """``docs`` with ``sp_ids`` (array of int) and, with ``check``, ``sp_lossless``: whether they decode to the text.

    Names get underscores in front where taken. Every row gives one row; a null text has null ids, an empty one the
    mark alone (which decodes to it). Rows of one key and text get equal ids; a null key is a key too. Whole texts
    are encoded.
    """
    ids, same = free_name(docs, "sp_ids"), free_name(docs, "sp_lossless")
    schema = widened(docs, f"`{ids}` array<int>" + f", `{same}` boolean" * check)
    t, k = docs.columns.index(text), docs.columns.index(key)

    def of(batches):
        lattice = lattice_of(model, alpha)
        for whole in batches:
            for start, stop in _ranges(whole.column(t)):
                batch = whole.slice(start, stop - start)
                null = batch.column(t).is_null().to_numpy(zero_copy_only=False)
                texts = pc.fill_null(batch.column(t), "")
                seeds = np.array([seed_of(x, seed) for x in batch.column(k).to_pylist()], np.uint64)
                got, count = encode(lattice, texts, seeds)
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(got, pa.int32()), mask=pa.array(null))]
                if check:
                    columns.append(pa.array(lossless(lattice, texts, got, count), mask=null))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.fieldNames())

    return docs.mapInArrow(lean(of), schema)


def decoded(rows: DataFrame, model: str, ids: str = "sp_ids") -> DataFrame:
    """``rows`` with ``sp_text``, the text that the ids stand for; null for null ids."""
    out = free_name(rows, "sp_text")
    schema, at = widened(rows, f"`{out}` string"), rows.columns.index(ids)

    def of(batches):
        lattice = lattice_of(model, 1.0)
        for batch in batches:
            texts = [None if x is None else decode(lattice, np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    return rows.mapInArrow(lean(of), schema)
