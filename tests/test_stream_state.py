"""Ordered evidence and latest states of a stream, against the table's."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators.latest import latest
from tessera.streaming import events, state

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"


def minute(n):
    return START + dt.timedelta(minutes=n)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    state.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def batches(spark, folder, parts):
    """A file for each micro-batch, in order of their times."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i:03d}")
    return events.read_events(spark, f"{folder}/part*", "event_id long, ts timestamp_ntz, user_id long, value double", 1)


def drain(df, folder, mode):
    out = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return out, held


def test_evidence_is_ordered_and_its_state_goes(spark, store, tmp_path):
    rows = [(i, minute(3 * (i // 2)), i % 3, float(i)) for i in range(60)]
    parts = [[rows[k] for k in range(60) if k // 20 == b][::-1] for b in range(3)]
    parts[1], parts[0][3], parts[1][5] = parts[1], parts[1][5], parts[0][3]  # within an hour of each other
    parts += [[(900, minute(60 * 24), 9, 0.0)], [(901, minute(1), 0, -1.0)], [(902, minute(60 * 48), 9, 0.0)]]  # the stream goes on; a row comes a day late
    stream = batches(spark, tmp_path / "in", parts)
    got, held = drain(state.ordered(stream, ["user_id"], ["value"], late="2 hours"), tmp_path, "append")
    want = {}
    for i, t, u, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want.setdefault(u, []).append((i, t, v, len(want.get(u, [])) + 1))
    for u, own in want.items():
        assert [(r.event_id, r.ts.replace(tzinfo=None), r.value, r.place) for r in got if r.user_id == u] == own
    assert 901 not in {r.event_id for r in got} and held[-1] < max(held) / 3


def test_latest_states_equal_the_table_and_idle_keys_go(spark, store, tmp_path):
    rows = [(i, minute((i * 37) % 200), i % 5, float(i)) for i in range(100)]
    parts = [rows[a : a + 25] for a in range(0, 100, 25)] + [[(500, minute(60 * 24 * 40), 77, 1.0)], [(501, minute(60 * 24 * 41), 77, 2.0)]]
    stream = batches(spark, tmp_path / "in", parts)
    got, held = drain(state.latest(stream, ["user_id"], ["value"], late="1 day"), tmp_path, "update")
    last = {}
    for r in got:  # in the order of batches
        last[r.user_id] = (r.event_id, r.value)
    table = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    assert last == {r.user_id: (r.event_id, r.value) for r in latest(table, ["user_id"], ["ts", "event_id"]).collect()}
    assert held[-1] < max(held)
    assert table.select(F.max("ts")).first()[0] == minute(60 * 24 * 41)


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.parts, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def updateValue(self, key, value):
        self.calls += 1
        self.parts[key] = value

    def iterator(self):
        self.calls += 1
        return iter(list(self.parts.items()))

    def clear(self):
        self.calls += 1
        self.parts = {}

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_ordering_calls_the_store_a_few_times_a_key():
    store, o = Store(), state.Ordered(["k"])
    o.init(store)
    rows = [{"_ms": 10 + (i * 37) % 2500, "_id": i, "_payload": str(i)} for i in range(5000)]
    again = [r | {"_payload": "new"} for r in rows[:10]]
    for part in (rows[3000:][::-1], rows[:3000] + again):
        assert not list(o.handleInputRows((7,), iter(part), At(0)))
    assert store.timers == {10}
    out = list(o.handleExpiredTimer((7,), At(1000), At(10)))
    store.timers.discard(10)  # as Spark does
    assert store.timers == {1001} and min(ms for v in store.parts.values() for ms in v[0]) == 1001
    assert not list(o.handleInputRows((7,), iter([{"_ms": 1000, "_id": 9999, "_payload": "late"}]), At(1000)))
    out += list(o.handleExpiredTimer((7,), At(9000), At(1001)))
    want = sorted({(r["_ms"], r["_id"]): r["_payload"] for r in rows + again}.items())
    assert [(r.k, r._ms, r._id, r._payload, r.place) for r in out] == [(7, ms, i, p, n) for n, ((ms, i), p) in enumerate(want, 1)]
    assert not store.parts and store.calls < 60
