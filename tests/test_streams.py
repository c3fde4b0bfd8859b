"""Streams with state against plain loops, with batches out of order and restarts."""

import datetime as dt
import random
import zlib

import pandas as pd
import pytest

from soukspark.streaming import claims, tries

T0 = dt.datetime(2024, 1, 1)
LEASE = 4 * 3_600_000


@pytest.fixture
def store(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    claims.use_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain_queue(commands):
    """Every row of every catalogue in dicts, command by command."""
    rows, out = {}, []
    for c in sorted(commands, key=lambda c: (c["ms"], c["seq"])):
        own = {k: r for (s, k), r in rows.items() if s == c["source"]}
        a, ms = c["action"], c["ms"]
        if a == "add":
            clash = c["id"] in own or c["url"] is not None and any(r["url"] == c["url"] and r["account"] == c["account"] for r in own.values())
            if not clash:
                rows[c["source"], c["id"]] = {"account": c["account"], "url": c["url"], "times": c["times_listed"] or 0, "state": "pending", "holder": None, "since": None, "n": 0}
            out.append((c["source"], ms, a, c["id"], not clash))
        elif a == "claim":
            free = [k for k, r in own.items() if c["account"] is not None and r["account"] == c["account"] and (r["state"] == "pending" or r["state"] == "claimed" and r["since"] < ms - LEASE)]
            took = sorted(free, key=lambda k: (-own[k]["times"], k))[: c["n"]]
            for k in took:
                own[k].update(state="claimed", holder=c["worker"], since=ms, n=own[k]["n"] + 1)
                out.append((c["source"], ms, a, k, True))
            if not took:
                out.append((c["source"], ms, a, None, False))
        elif a == "release":
            for k, r in own.items():
                if r["state"] == "claimed" and r["holder"] == c["worker"]:
                    r.update(state="pending", holder=None, since=None)
                    out.append((c["source"], ms, a, k, True))
        elif a in ("complete", "reject"):
            r = own.get(c["id"])
            ok = r is not None and r["state"] == "claimed" and r["holder"] == c["worker"]
            out.append((c["source"], ms, a, c["id"], ok))
            if ok:
                r["state"] = "done" if a == "complete" else "rejected"
                for k, x in own.items():
                    if a == "reject" and r["url"] is not None and x["url"] == r["url"] and x["state"] == "pending":
                        x["state"] = "rejected"
                        out.append((c["source"], ms, "sibling", k, True))
    return rows, sorted(out, key=repr)


def some_commands(seed, n=900):
    rng = random.Random(seed)
    out, seq = [], 0

    def add(ms, **c):
        nonlocal seq
        seq += 1
        out.append({"source": "s", "ms": ms, "seq": seq, "worker": None, "account": None, "id": None, "url": None, "times_listed": None, "n": None} | c)

    for k in range(120):
        add(rng.randrange(3_600_000), action="add", id=k, source="st"[k % 2], account=rng.choice(["a", "b", None]), url=rng.choice([None, f"u{k // 6}", f"v{k}"]), times_listed=rng.choice([None, 1, 2, 2, 9]))
    for _ in range(n):
        worker = f"w{rng.randrange(6)}"
        what = dict(source=rng.choice("st"), worker=worker, account=[None, "a", "a", "b", "b", "b"][int(worker[1])])
        action = rng.choice(["claim"] * 3 + ["complete"] * 2 + ["reject", "release"])
        if action == "claim":
            what["n"] = rng.randrange(4)
        elif action != "release":
            what["id"] = rng.randrange(125)
        add(rng.randrange(30 * 3_600_000), action=action, **what)
    # a lease that ends at the very millisecond of a claim: not yet, a millisecond later it has
    for ms in (40 * 3_600_000, 44 * 3_600_000, 44 * 3_600_000 + 1):
        add(ms, action="claim", worker="w1", account="a", n=3)
    add(60 * 3_600_000, action="tick")
    add(60 * 3_600_000, action="tick", source="t")
    return out


def frame(spark, commands):
    rows = [tuple(T0 + dt.timedelta(milliseconds=c["ms"]) if n == "ts" else c[n] for n in [x.split()[0] for x in claims.COMMAND.split(", ")]) for c in commands]
    return spark.createDataFrame(rows, claims.COMMAND)


def test_a_replay_of_shuffled_commands_equals_a_plain_loop(spark, store, tmp_path):
    """Commands come in files that are out of order by up to nine minutes, and the stream starts anew from its checkpoint."""
    commands = some_commands(4)
    late = random.Random(0)
    order = sorted(commands, key=lambda c: c["ms"] + late.randrange(540_000))
    cuts = [0, 400, 700, len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = order[a:b]
        late.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        claims.run(spark.readStream.schema(claims.COMMAND).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    log = spark.read.schema(claims.OUT).parquet(f"{tmp_path}/out")
    start = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000)
    rows, want = plain_queue(commands)
    got = [(r.source, r.ms - start, r.action, r.id, r.ok) for r in log.collect() if r.action != "expire"]
    assert sorted(got, key=repr) == want
    last = {r.id: (r.state, r.attempts) for r in claims.snapshot(log).collect()}
    assert last == {k: (r["state"], r["n"]) for (_, k), r in rows.items()}
    assert log.where("action = 'expire'").count() > 0


def test_no_row_is_handed_out_twice(spark, store, tmp_path):
    """Four workers of one account take 20 rows at a time of 400 until none is left."""
    commands = [{"source": "s", "ms": 0, "seq": k, "action": "add", "worker": None, "account": "a", "id": k, "url": f"u{k}", "times_listed": k, "n": None} for k in range(400)]
    commands += [c | {"ms": 60_000 + k // 4, "seq": k, "action": "claim", "worker": f"w{k % 4}", "id": None, "n": 20} for k in range(24) for c in commands[:1]]
    commands += [commands[-1] | {"ms": 7_200_000, "action": "tick"}]
    frame(spark, commands).write.parquet(f"{tmp_path}/in")
    claims.run(spark.readStream.schema(claims.COMMAND).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = [r for r in spark.read.schema(claims.OUT).parquet(f"{tmp_path}/out").orderBy("ms").collect() if r.action == "claim"]
    ids = [r.id for r in got if r.ok]
    assert sorted(ids) == list(range(400)) and sum(not r.ok for r in got) == 4
    assert {r.id for r in got if r.ok and r.ms == got[0].ms} == set(range(320, 400))


def test_workers_without_an_account_claim_nothing(spark):
    staff = spark.createDataFrame([("w0", None), ("w1", "a")], "id string, own_account string")
    some = [c for c in some_commands(1) if c["action"] in ("add", "claim")]
    got = claims.addressed(frame(spark, [c | {"account": "z"} for c in some]), staff).collect()
    assert {(r.action, r.worker == "w1", r.account) for r in got} == {("add", False, "z"), ("claim", True, "a"), ("claim", False, None)}


def test_state_is_read_and_written_by_the_block():
    """A thousand rows near together are a handful of calls to the store, and come back as they were put."""
    held, calls = {}, []

    class Store:
        def getValue(self, key):
            calls.append(key)
            return held.get(key)

        def updateValue(self, key, value):
            calls.append(key)
            held[key] = value

        def containsKey(self, key):
            return key in held

        def removeKey(self, key):
            del held[key]

    of = lambda: claims.Touched(Store(), lambda k: k >> claims.NEAR)
    first = of()
    for k in range(1000):
        first.put(k, (f"u{k}", [k, None]))
    first.flush()
    assert len(calls) <= 8
    again = of()
    assert [again.get(k) for k in range(1001)] == [(f"u{k}", [k, None]) for k in range(1000)] + [None]
    for k in range(300):
        again.put(k, None)
    again.flush()
    assert len(calls) <= 16 and of().get(299) is None and of().get(300) == ("u300", [300, None]) and len(held) == 3
    places = [claims.place(a, n, k) for a in ("a", "b") for n in (9, 2) for k in (-70000, 5, 70000)]
    assert sorted(places, key=lambda p: (claims._near(p), p)) == sorted(places)


class Held:
    """A catalogue's state in dicts, and how often it was asked."""

    def __init__(self):
        self.maps, self.calls = {}, 0

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, HeldMap(self))

    def getValueState(self, name, kind):
        return self.maps.setdefault(name, HeldValue())

    def registerTimer(self, ms):
        pass


class HeldMap(dict):
    def __init__(self, of):
        self.of = of

    def getValue(self, key):
        self.of.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.of.calls += 1
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class HeldValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def drained(batches, held):
    """Outcomes of batches of one catalogue's commands, each with the time up to which they are due."""
    out = []
    for commands, now in batches:
        q = claims.Queue()
        q.init(held)
        df = pd.DataFrame([c | {"has": c["id"] is not None, "id": c["id"] or 0, "hu": zlib.crc32((c["url"] or "").encode()), "ha": zlib.crc32((c["account"] or "").encode()), "times_listed": c["times_listed"] or 0, "n": c["n"] or 0} for c in commands])
        list(q.handleInputRows(("s",), iter([df[:7], df[7:]]), None))
        for got in q.handleExpiredTimer(("s",), type("T", (), {"getCurrentWatermarkInMs": lambda _, now=now: now})(), None):
            out.extend(got.itertuples(index=False))
    return out


def one(ms, seq, action, **c):
    return {"source": "s", "ms": ms, "seq": seq, "action": action, "worker": None, "account": None, "id": None, "url": None, "times_listed": None, "n": None} | c


def test_adds_that_clash_in_one_run_are_taken_one_by_one():
    """Of rows with an id or URL that others have, too, the first counts, and what was refused stands in nobody's way."""
    rng, adds = random.Random(3), [(1, "a", "u"), (1, "a", "v"), (2, "a", "v"), (3, "a", "v"), (4, "b", "v"), (5, None, "v"), (6, None, "v"), (7, "a", None), (8, "a", None), (2, "b", "x"), (-5, "a", "y")]
    adds += [(rng.randrange(-9000, 9000), rng.choice(["a", "b", None]), rng.choice([None, f"u{rng.randrange(300)}"])) for _ in range(1500)]
    commands = [one(0, k, "add", id=i, account=a, url=u, times_listed=k % 3) for k, (i, a, u) in enumerate(adds)]
    later = [one(5, k, "claim", worker=f"w{k}", account="ab"[k % 2], n=50) for k in range(4)] + [one(9, k, "add", id=i, account=a, url=u) for k, (i, a, u) in enumerate(adds[:900:7])]
    _, want = plain_queue(commands + later)
    got = drained([(commands, 1), (later, 20)], Held())
    assert sorted(((r.source, r.ms, r.action, r.id, r.ok) for r in got), key=repr) == want


def test_rows_claimed_again_at_the_same_time_end_once():
    commands = [one(0, k, "add", id=k, account="a", url=f"u{k}", times_listed=1) for k in range(3)]
    for k in range(2):
        commands += [one(10, 2 * k, "claim", worker="w", account="a", n=2), one(10, 2 * k + 1, "release", worker="w")]
    commands += [one(10, 9, "claim", worker="w", account="a", n=2), one(LEASE + 11, 0, "claim", worker="v", account="a", n=9)]
    got = drained([(commands, LEASE + 20)], Held())
    assert [r.id for r in got if r.action == "expire"] == [0, 1]
    assert sorted(r.id for r in got if r.worker == "v") == [0, 1, 2]


def test_a_large_catalogue_is_few_calls_to_the_store():
    """50,000 rows, of which 6,000 are claimed and a third of these finished, some of them by rejections of other rows' URLs."""
    n, held = 50_000, Held()
    commands = [one(0, k, "add", id=k, account=f"a{k % 3}", url=f"u{k // 3}", times_listed=k % 50) for k in range(n)]
    commands += [one(60_000 + k, k, "claim", worker=f"w{k}", account=f"a{k % 3}", n=3) for k in range(2000)]
    got = drained([(commands, 100_000)], held)
    took = {r.id: r.worker for r in got if r.action == "claim"}
    assert len(took) == 6000 and held.calls < 12_000
    want = {x for a in range(3) for x in sorted((k for k in range(n) if k % 3 == a), key=lambda k: (-(k % 50), k))[: 3 * sum(w % 3 == a for w in range(2000))]}
    assert set(took) == want
    ends = [one(200_000, k, "reject" if k % 2 else "complete", worker=w, id=x) for k, (x, w) in enumerate(took.items()) if k % 3 == 0]
    got += drained([(ends, LEASE + 300_000)], held)
    assert sum(r.action == "expire" for r in got) == 6000 - len(ends) and all(r.ok for r in got)
    assert any(r.action == "sibling" for r in got)


# -- attempts ------------------------------------------------------------------------------------------------------


def plain_tries(attempts, hours):
    seen, out = {}, []
    for w, i, ms, seq, visible, payload in attempts:
        sent, n, last = seen.get((w, i), (False, 0, None))
        if last is not None and ms >= last + hours * 3_600_000:
            sent, n, last = False, 0, None
        if sent:
            continue
        if payload is None and not visible:
            continue
        n += payload is None
        done = payload is not None or n >= 3
        if done:
            out.append((w, i, ms, seq, payload, payload is None))
        seen[w, i] = (done, n, ms)
    return sorted(out)


def test_tries_are_counted_over_restarts_and_forgotten(spark, store, tmp_path):
    rng = random.Random(2)
    rows = [(f"w{rng.randrange(3)}", f"i{rng.randrange(8)}", 600_000 * k + rng.randrange(1000), k, rng.random() < 0.8, None if rng.random() < 0.85 else f"p{k}") for k in range(700)]
    # the watermark lets two days pass for everyone before the second half
    rows = [(w, i, ms + (k >= 350) * 200 * 3_600_000, s, v, p) for k, (w, i, ms, s, v, p) in enumerate(rows)]
    ticks = [("tick", "tick", ms, 0, False, None) for ms in (349 * 600_000 + 100 * 3_600_000,)]
    for part in (rows[:3], rows[3:200], rows[200:350], ticks, rows[350:500], rows[500:]):
        spark.createDataFrame(part, tries.ATTEMPT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = tries.streamed(spark.readStream.schema(tries.ATTEMPT).parquet(f"{tmp_path}/in"), hours=96)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(tries.OUT).parquet(f"{tmp_path}/out").collect()))
    want = plain_tries(rows, 96)
    assert got == want and any(r[5] for r in want) and len(want) > 24
    batch = tries.sent(spark.createDataFrame(rows[:350], tries.ATTEMPT))
    assert sorted(map(tuple, batch.collect())) == plain_tries(rows[:350], 10**6)


def test_attempts_at_time_zero_and_before_count(spark, store, tmp_path):
    rows = [("w", "a", 0, 0, True, "p0"), ("w", "a", 5000, 5, True, "p5"), ("w", "b", -1000, 1, True, "p1"), ("w", "b", 7000, 7, True, "p7"), ("w", "c", 40 * 86_400_000, 9, True, "p9")]
    df = spark.createDataFrame(rows, tries.ATTEMPT)
    df.write.parquet(f"{tmp_path}/in")
    out = tries.streamed(spark.readStream.schema(tries.ATTEMPT).parquet(f"{tmp_path}/in"))
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(tries.OUT).parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, tries.sent(df).collect())) and [r[4] for r in got] == ["p0", "p1", "p9"]
