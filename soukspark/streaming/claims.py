"""The work queue as a stream with state: commands go in, and what they did to rows comes out.

The state is held for each catalogue (``source``), since a rejection reaches the rows of one product on all accounts at
once. Commands wait in the state until the watermark has passed them and are then applied in the order of their time, so
what comes out does not depend on the order in which they came in. Leases are event-time timers: when one ends, its row
can be claimed again, while its holder may still finish it until somebody does.

Commands (``COMMAND``): ``add`` (id, account, url, times_listed), ``claim`` (worker, account, n), ``complete`` and ``reject``
(worker, id), ``release`` (worker), ``tick`` (only moves time on). Times count in milliseconds.
"""

from __future__ import annotations

import gc
import heapq
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from soukspark.config import LEASE_HOURS

COMMAND = "source string, ts timestamp, seq long, action string, worker string, account string, id long, url string, times_listed int, n int"
OUT = "source string, ms long, action string, worker string, account string, id long, url string, ok boolean, state string, attempts int"
#: A command as it waits; ``has``: whether it has an id; ``hu``, ``ha``: hashes of its URL and account.
_LONGS, _TEXTS = ("ms", "seq", "id", "hu", "ha", "times_listed", "n"), ("action", "worker", "account", "url")
_WAITING = pa.schema([*[(c, pa.int64()) for c in _LONGS], *[(c, pa.string()) for c in _TEXTS], ("has", pa.bool_())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def place(account: str, times_listed: int, number: int) -> str:
    """Sorts rows of an account as they are to be claimed: most listed first, then by id."""
    return f"{account}\0{10**10 - times_listed:011d}{number + (1 << 63):020d}"


#: Numbers of entries that share a block, of rows that do, and of places listed as often, as powers of two; blocks of URLs and of
#: workers; milliseconds of a block of ends; commands that are taken at once.
NEAR, ROWS, PLACES, URLS, HELD, ENDS, ONCE = 8, 12, 17, 1 << 12, 1 << 10, 60_000, 1 << 18
#: The columns of a block of rows.
_ID, _HU, _ACCOUNT, _URL, _TIMES, _STATE, _HOLDER, _SINCE, _TRIES = range(9)


def _dealt(n: int):
    return lambda key: crc32(key.encode()) % n


def _blob(commands: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _WAITING) as w:
        w.write_table(commands)
    return out.getvalue().to_pybytes()


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that have it, in their order."""
    order = np.argsort(key, kind="stable")
    names, starts = np.unique(key[order], return_index=True)
    return zip(names.tolist(), np.split(order, starts[1:]), strict=True) if len(names) else iter(())


def _again(key: np.ndarray) -> np.ndarray:
    """Which values come more than once."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at] > 1


def _near(p: str) -> str:
    """Blocks of places sort as the places do."""
    return f"{p[:-20]}{int(p[-20:]) >> PLACES:016d}"


class Touched:
    """What a batch reads and changes of a state map; ``flush`` writes the changes, each once.

    The map holds blocks of entries (``block`` says which an entry is in), each pickled as a whole: each call to the store is a
    message to another process, so there is one for a block, not one for an entry."""

    def __init__(self, of, block):
        self.of, self.block, self.seen, self.changed = of, block, {}, set()

    def at(self, block) -> dict:
        if block not in self.seen:
            held = self.of.getValue((block,))
            self.seen[block] = {} if held is None else pickle.loads(held[0])
        return self.seen[block]

    def get(self, key):
        return self.at(self.block(key)).get(key)

    def put(self, key, value: tuple | None) -> None:
        """None removes the key."""
        block = self.block(key)
        if value is None:
            self.at(block).pop(key, None)
        else:
            self.at(block)[key] = value
        self.changed.add(block)

    def ids(self, key) -> list[int]:
        got = self.get(key)
        return [] if got is None else list(got[0])

    def put_ids(self, key, ids: list[int]) -> None:
        self.put(key, (ids,) if ids else None)

    def extend(self, key, ids: list[int]) -> None:
        self.at(self.block(key)).setdefault(key, ([],))[0].extend(ids)
        self.changed.add(self.block(key))

    def flush(self) -> None:
        for block in self.changed:
            if at := self.seen[block]:
                self.of.updateValue((block,), (pickle.dumps(at),))
            elif self.of.containsKey((block,)):
                self.of.removeKey((block,))


class Rows:
    """The rows by id, in blocks of columns that are sorted by id."""

    def __init__(self, of):
        self.of, self.seen, self.changed = of, {}, set()

    def block(self, block: int) -> list:
        if block not in self.seen:
            held = self.of.getValue((block,))
            self.seen[block] = [array("q"), array("q"), *([] for _ in range(7))] if held is None else pickle.loads(held[0])
        return self.seen[block]

    def find(self, number: int) -> tuple[list, int] | None:
        """The block and the place in it."""
        block = self.seen.get(number >> ROWS) or self.block(number >> ROWS)
        at = bisect_left(block[_ID], number)
        return (block, at) if at < len(block[_ID]) and block[_ID][at] == number else None

    def known(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for block, at in _split(ids >> ROWS):
            if len(had := self.block(block)[_ID]):
                out[at] = np.isin(ids[at], np.array(had, np.int64))
        return out

    def add(self, ids: np.ndarray, hu: np.ndarray, account: list, url: list, times: np.ndarray) -> None:
        """New rows, pending."""
        order = np.argsort(ids)
        for name, at in _split(ids[order] >> ROWS):
            at, n = order[at], len(at)
            places, block = at.tolist(), self.block(name)
            behind = not len(block[_ID]) or ids[at[0]] > block[_ID][-1]
            new = (ids[at].tolist(), hu[at].tolist(), [account[k] for k in places], [url[k] for k in places], times[at].tolist(), ["pending"] * n, [None] * n, [None] * n, [0] * n)
            for column, more in zip(block, new, strict=True):
                column.extend(more)
            if not behind:
                by = np.argsort(np.array(block[_ID], np.int64)).tolist()
                self.seen[name] = [array("q", [c[k] for k in by]) if isinstance(c, array) else [c[k] for k in by] for c in block]
            self.changed.add(name)

    def put(self, block: list, at: int, state: str, **new) -> None:
        block[_STATE][at] = state
        for c, v in new.items():
            block[{"holder": _HOLDER, "since": _SINCE}[c]][at] = v
        self.changed.add(block[_ID][at] >> ROWS)

    def flush(self) -> None:
        for block in self.changed:
            self.of.updateValue((block,), (pickle.dumps(self.seen[block]),))


class Urls:
    """Ids by the hash of the URL, with the hash of the account, in blocks that are sorted by the first."""

    def __init__(self, of):
        self.of, self.seen, self.changed = of, {}, set()

    def block(self, block: int) -> np.ndarray:
        if block not in self.seen:
            held = self.of.getValue((block,))
            self.seen[block] = np.frombuffer(b"" if held is None else held[0], np.int64).reshape(3, -1)
        return self.seen[block]

    @staticmethod
    def pair(hu: np.ndarray, ha: np.ndarray) -> np.ndarray:
        return hu * np.int64(0x1E3779B97F4A7C15) ^ ha

    def known(self, hu: np.ndarray, ha: np.ndarray) -> np.ndarray:
        """Which URLs may be there for the same account."""
        out = np.zeros(len(hu), bool)
        for block, at in _split(hu % URLS):
            if (had := self.block(block)).size:
                out[at] = np.isin(self.pair(hu[at], ha[at]), self.pair(*had[:2]))
        return out

    def add(self, hu: np.ndarray, ha: np.ndarray, ids: np.ndarray) -> None:
        new = np.stack((hu, ha, ids))
        for block, at in _split(hu % URLS):
            both = np.concatenate((self.block(block), new[:, at]), axis=1)
            self.seen[block] = both[:, np.argsort(both[0], kind="stable")]
            self.changed.add(block)

    def ids(self, hu: int) -> list[int]:
        h, _, ids = self.block(hu % URLS)
        return ids[np.searchsorted(h, hu) : np.searchsorted(h, hu, side="right")].tolist()

    def flush(self) -> None:
        for block in self.changed:
            self.of.updateValue((block,), (self.seen[block].tobytes(),))


class Free:
    """Ids of rows that can be claimed, in blocks whose names sort as their places do; a block is a heap, beside what of it
    is gone."""

    def __init__(self, of):
        self.of, self.seen, self.changed, self.heads, self.listed = of, {}, set(), None, set()

    def _listed(self, name: str) -> None:
        """Blocks are listed by account once something is claimed."""
        if self.heads is not None and name not in self.listed:
            self.listed.add(name)
            heapq.heappush(self.heads.setdefault(name.partition("\0")[0], []), name)

    def block(self, name: str) -> tuple[list, set]:
        if name not in self.seen:
            held = self.of.getValue((name,))
            self.seen[name] = ([] if held is None else np.frombuffer(held[0], np.int64).tolist(), set())
        return self.seen[name]

    def add(self, account: str, times: int, ids: list[int]) -> None:
        """``ids``: of one block, none of them in it."""
        name = f"{account}\0{10**10 - times:011d}{ids[0] + (1 << 63) >> PLACES:016d}"  # ``_near`` of its place
        heap, gone = self.block(name)
        for x in ids:
            if x in gone:
                gone.remove(x)
            else:
                heapq.heappush(heap, x)
        self.changed.add(name)
        self._listed(name)

    def remove(self, account: str, times: int, number: int) -> None:
        """``number`` is in its block."""
        name = _near(place(account, times, number))
        self.block(name)[1].add(number)
        self.changed.add(name)

    def take(self, account: str | None) -> int | None:
        """The first that can be claimed; it can't be claimed any more."""
        if account is None:
            return None
        if self.heads is None:
            self.heads = {}
            for name in sorted({name for (name,) in self.of.keys()} | self.seen.keys()):  # noqa: SIM118  the state's map is no dict
                self._listed(name)
        names = self.heads.get(account, [])
        while names:
            heap, gone = self.block(names[0])
            while heap:
                number = heapq.heappop(heap)
                self.changed.add(names[0])
                if number not in gone:
                    return number
                gone.remove(number)
            self.listed.remove(heapq.heappop(names))
        return None

    def flush(self) -> None:
        for name in self.changed:
            heap, gone = self.seen[name]
            if left := sorted(x for x in heap if x not in gone):
                self.of.updateValue((name,), (np.array(left, np.int64).tobytes(),))
            elif self.of.containsKey((name,)):
                self.of.removeKey((name,))


class Queue(StatefulProcessor):
    """One catalogue's rows. Maps, in blocks: rows by id; ids that can be claimed, by place; ids by URL, by holder and by the
    time at which their leases end; commands that wait, by the time of their first.

    Runs of ``add`` are taken as arrays; only those whose id or URL may be there already are looked at one by one. All other
    commands are, one after the other."""

    def __init__(self, hours: int = LEASE_HOURS):
        self.lease = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"rows": "block long", "free": "block string", "urls": "block int", "held": "block int", "ends": "block long", "waiting": "first long, part long"}
        self.maps = {name: handle.getMapState(name, key, "body binary") for name, key in kinds.items()}
        self.until = handle.getValueState("until", "ms long")
        self.parts = handle.getValueState("parts", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = self.parts.get()[0] if self.parts.exists() else 0
        first = None
        for df in rows:
            got = pa.Table.from_pandas(df[_WAITING.names], schema=_WAITING, preserve_index=False)
            if len(got):
                part, ms = part + 1, int(df["ms"].min())
                self.maps["waiting"].updateValue((ms, part), (_blob(got),))
                first = ms if first is None else min(first, ms)
        self.parts.update((part,))
        # what is due later gets a timer when this one has expired
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def _due(self, now: int) -> tuple[pa.Table, list[int]]:
        """What waited until now, in order, and the first times of what still waits."""
        waiting, due, later = self.maps["waiting"], [], []
        for first, part in list(waiting.keys()):  # noqa: SIM118  the state's map is no dict
            if first > now:
                later.append(first)
                continue
            got = pa.ipc.open_stream(waiting.getValue((first, part))[0]).read_all()
            waiting.removeKey((first, part))
            ms = got["ms"].to_numpy()
            due.append(got.filter(pa.array(ms <= now)))
            if (ms > now).any():
                rest = int(ms[ms > now].min())
                later.append(rest)
                waiting.updateValue((rest, part), (_blob(got.filter(pa.array(ms > now))),))
        out = pa.concat_tables(due).combine_chunks() if due else _WAITING.empty_table()
        return out, later

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The first of a batch's timers does what is due up to the watermark; others find it done. The next is set to
        what comes first after it."""
        now = timerValues.getCurrentWatermarkInMs()
        if self.until.exists() and self.until.get()[0] >= now:
            return
        self.until.update((now,))
        # millions of entries that refer to nothing in circles would be walked through over and over
        before = gc.isenabled()
        gc.disable()
        try:
            yield from self._done(key[0], now)
        finally:
            if before:
                gc.enable()

    def _done(self, source: str, now: int) -> Iterator[pd.DataFrame]:
        due, later = self._due(now)
        order = np.lexsort((due["seq"].to_numpy(), due["ms"].to_numpy()))
        self.rows, self.free, self.urls = Rows(self.maps["rows"]), Free(self.maps["free"]), Urls(self.maps["urls"])
        self.held = Touched(self.maps["held"], lambda worker: _dealt(HELD)(worker or ""))
        self.ends = Touched(self.maps["ends"], lambda ms: ms // ENDS)
        ends = [ms for (block,) in list(self.maps["ends"].keys()) if block <= now // ENDS for ms in self.ends.at(block) if ms <= now]  # noqa: SIM118
        heapq.heapify(ends)
        out = []
        for k in range(0, len(order), ONCE):
            part = due.take(pa.array(order[k : k + ONCE]))
            adds = np.array(part["action"].to_pylist(), object) == "add"
            cuts = np.flatnonzero(adds[1:] != adds[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if adds[a]:
                    yield self._add(source, part.slice(a, b - a))
                    continue
                for c in zip(*(part[x].slice(a, b - a).to_pylist() for x in ("ms", "action", "worker", "account", "id", "has", "n")), strict=True):
                    self._expire(ends, c[0], out)
                    self._apply(c, ends, out)
                    if len(out) >= ONCE:
                        yield self._out(source, out)
                        out = []
        self._expire(ends, now, out)
        yield self._out(source, out)
        for t in (self.rows, self.free, self.urls, self.held, self.ends):
            t.flush()
        blocks = [block for (block,) in self.maps["ends"].keys()]  # noqa: SIM118
        if later := [*later, *(self.ends.at(min(blocks)) if blocks else ())]:
            self.handle.registerTimer(min(later))

    @staticmethod
    def _out(source: str, out: list) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * (len(names) - 1)
        return pd.DataFrame({names[0]: pd.Series([source] * len(out), dtype=object)} | {n: pd.Series(list(c), dtype=object) for n, c in zip(names[1:], columns, strict=True)})

    def _add(self, source: str, c: pa.Table) -> pd.DataFrame:
        ms, ids, hu, ha, times = (c[x].to_numpy() for x in ("ms", "id", "hu", "ha", "times_listed"))
        worker, url, has = c["worker"].to_pylist(), c["url"].to_pylist(), c["has"].to_numpy()
        coded = c["account"].combine_chunks().dictionary_encode()
        names, code = [*coded.dictionary.to_pylist(), None], coded.indices.fill_null(-1).to_numpy()
        account = [names[k] for k in code.tolist()]
        linked = c["url"].is_valid().to_numpy()
        doubt = _again(ids) | self.rows.known(ids)
        doubt[linked] |= _again(Urls.pair(hu[linked], ha[linked])) | self.urls.known(hu[linked], ha[linked])
        ok, numbers, pairs = has & ~doubt, set(), set()
        for k in np.flatnonzero(has & doubt).tolist():
            number, pair = int(ids[k]), (url[k], account[k])
            if number in numbers or self.rows.find(number) or url[k] is not None and (pair in pairs or self._listed(int(hu[k]), *pair)):
                continue
            ok[k] = True
            numbers.add(number)
            pairs.add(pair)
        at = np.flatnonzero(ok)
        places = at.tolist()
        self.rows.add(ids[at], hu[at], [account[k] for k in places], [url[k] for k in places], times[at])
        self.urls.add(*(x[ok & linked] for x in (hu, ha, ids)))
        # those of one account, listed as often, whose places share a block
        at = at[code[at] >= 0]
        at = at[np.lexsort((ids[at], times[at], code[at]))]
        by = np.stack((code[at], times[at], ids[at] >> PLACES))
        for same in np.split(at, np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1) if len(at) else ():
            self.free.add(account[same[0]], int(times[same[0]]), ids[same].tolist())
        number, said, tries = ids.astype(object), np.full(len(ids), None, object), np.full(len(ids), None, object)
        number[~has], said[ok], tries[ok] = None, "pending", 0
        names = [x.split()[0] for x in OUT.split(", ")]
        return pd.DataFrame(dict(zip(names, ([source] * len(ids), ms, ["add"] * len(ids), worker, account, number, url, ok, said, tries), strict=True)))

    def _listed(self, hu: int, url: str, account: str | None) -> bool:
        return any(block[_URL][at] == url and block[_ACCOUNT][at] == account for block, at in map(self.rows.find, self.urls.ids(hu)))

    def _let_go(self, number: int, holder: str) -> None:
        self.held.put_ids(holder, [x for x in self.held.ids(holder) if x != number])

    @staticmethod
    def _said(block: list, at: int) -> tuple:
        """A row as it stands, as it comes out."""
        return block[_ACCOUNT][at], block[_ID][at], block[_URL][at], True, block[_STATE][at], block[_TRIES][at]

    def _open(self, block: list, at: int) -> None:
        if block[_ACCOUNT][at] is not None:
            self.free.add(block[_ACCOUNT][at], block[_TIMES][at], [block[_ID][at]])

    def _close(self, block: list, at: int) -> None:
        """The row, which could be claimed, can't be any more."""
        if block[_ACCOUNT][at] is not None:
            self.free.remove(block[_ACCOUNT][at], block[_TIMES][at], block[_ID][at])

    def _expire(self, ends: list, now: int, out: list) -> None:
        while ends and ends[0] <= now:
            ms = heapq.heappop(ends)
            # a row that was let go and claimed again at the same time is there twice
            for number in dict.fromkeys(self.ends.ids(ms)):
                block, at = self.rows.find(number)
                # unless the lease ended before, or the row was claimed again
                if block[_STATE][at] == "claimed" and block[_SINCE][at] + self.lease + 1 == ms:
                    self._open(block, at)
                    out.append((ms, "expire", block[_HOLDER][at], *self._said(block, at)))
            self.ends.put_ids(ms, [])

    def _apply(self, c: tuple, ends: list, out: list) -> None:
        ms, action, worker, account, number, has, n = c
        if action == "claim":
            out.extend(self._claim(ms, worker, account, n, ends))
        elif action == "release":
            for x in self.held.ids(worker):
                block, at = self.rows.find(x)
                ended = block[_SINCE][at] + self.lease < ms
                self.rows.put(block, at, "pending", holder=None, since=None)
                if not ended:
                    self._open(block, at)
                out.append((ms, action, worker, *self._said(block, at)))
            self.held.put_ids(worker, [])
        elif action in ("complete", "reject"):
            found = self.rows.find(number) if has else None
            if found is None:
                out.append((ms, action, worker, None, number if has else None, None, False, None, None))
                return
            block, at = found
            if block[_STATE][at] != "claimed" or block[_HOLDER][at] != worker:
                out.append((ms, action, worker, block[_ACCOUNT][at], number, block[_URL][at], False, block[_STATE][at], block[_TRIES][at]))
                return
            # a row whose lease has ended can be claimed
            if block[_SINCE][at] + self.lease < ms:
                self._close(block, at)
            self._let_go(number, worker)
            self.rows.put(block, at, "done" if action == "complete" else "rejected")
            out.append((ms, action, worker, *self._said(block, at)))
            url = block[_URL][at]
            for x in self.urls.ids(block[_HU][at]) if action == "reject" and url is not None else ():
                other, k = self.rows.find(x)
                if other[_STATE][k] == "pending" and other[_URL][k] == url:
                    self._close(other, k)
                    self.rows.put(other, k, "rejected")
                    out.append((ms, "sibling", worker, *self._said(other, k)))

    def _claim(self, ms: int, worker: str, account: str | None, n: int, ends: list) -> list[tuple]:
        out, took = [], []
        while len(took) < n and (number := self.free.take(account)) is not None:
            block, at = self.rows.find(number)
            if block[_HOLDER][at] is not None:
                self._let_go(number, block[_HOLDER][at])
            block[_TRIES][at] += 1
            self.rows.put(block, at, "claimed", holder=worker, since=ms)
            took.append(number)
            out.append((ms, "claim", worker, account, number, block[_URL][at], True, "claimed", block[_TRIES][at]))
        if took:
            self.held.extend(worker, took)
            end = ms + self.lease + 1
            if self.ends.get(end) is None:
                heapq.heappush(ends, end)
            self.ends.extend(end, took)
        else:
            out.append((ms, "claim", worker, account, None, None, False, None, None))
        return out

    def close(self) -> None:
        pass


def addressed(commands: DataFrame, staff: DataFrame) -> DataFrame:
    """Claims with the account of their worker (``staff``: ``id, own_account``), whatever they came with; a worker without
    one claims nothing."""
    own = staff.select(F.col("id").alias("worker"), "own_account")
    out = commands.join(own, "worker", "left")
    account = F.when(F.col("action") == "claim", F.col("own_account")).otherwise(F.col("account"))
    return out.withColumn("account", account).select(*[c.split()[0] for c in COMMAND.split(", ")])


def outcomes(commands: DataFrame, late: str = "10 minutes", hours: int = LEASE_HOURS) -> DataFrame:
    """``OUT`` for a stream of ``COMMAND``: a row for each row that a claim or release took, one for each other command, and
    one (``expire``, ``sibling``) for each row that a lease's end or a rejection elsewhere changed. Commands later than the
    watermark by more than ``late`` are lost, as Spark drops them."""
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = commands.withWatermark("ts", late).select(
        "source", "ts", F.unix_millis("ts").alias("ms"), none("seq"), "action", "worker", "account", F.col("id").isNotNull().alias("has"), none("id"), "url",
        F.xxhash64("url").alias("hu"), F.xxhash64("account").alias("ha"), none("times_listed"), none("n"),
    )
    return rows.groupBy("source").transformWithStateInPandas(Queue(hours), OUT, "append", "eventTime")


def snapshot(log: DataFrame) -> DataFrame:
    """``id, state, attempts, worker``: each row's last outcome in a log of outcomes."""
    last = F.max_by(F.struct("state", "attempts", F.when((F.col("state") != "pending") & (F.col("action") != "sibling"), F.col("worker")).alias("worker")), F.struct("ms", F.when(F.col("action") == "expire", 0).otherwise(1), "attempts", F.col("action") != "claim"))
    return log.where("ok and id is not null").groupBy("id").agg(last.alias("r")).select("id", "r.*")


def run(commands: DataFrame, path: str, checkpoint: str, **how):
    """Starts the stream that appends outcomes to a folder, up to what is there now. The session must keep state in
    RocksDB (``use_store``)."""
    return outcomes(commands, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_store(spark: SparkSession) -> None:
    """State stores that maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
