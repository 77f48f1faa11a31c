"""Rules with event-time timers: nothing before its time, once, without further input, equal to the twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from buildlens.streaming import timed, twins

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


class Fed:
    """A stream that is fed by hand: ``put`` writes a file, ``run`` takes in what is there."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n = timed.with_timers(spark), path, schema, make, 0
        (path / "in").mkdir()

    def put(self, *rows):
        # files of one run are micro-batches of their own, in the order of their names
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        self.n += 1

    def run(self):
        raw = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")
        made = self.make(raw)
        self.query = made.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/c").trigger(availableNow=True).start()
        self.query.awaitTermination(180)
        return sorted(tuple(r) for r in self.spark.read.schema(made.schema).parquet(f"{self.path}/out").collect())

    def state_rows(self):
        return sum(op["numRowsTotal"] for op in self.query.lastProgress["stateOperators"])


SUBS = "build_id bigint, ts timestamp, seq bigint, change int"


def test_abandoned_waits_for_the_grace_and_a_return(spark, tmp_path):
    fed = Fed(spark, tmp_path, SUBS, lambda df: timed.abandoned(df, 10, "0 seconds", 60))
    fed.put((1, at(0), 0, 1), (2, at(0), 0, 1), (1, at(5), 1, -1), (2, at(5), 1, -1))
    assert fed.run() == []
    # build 2 has a listener again at the last moment that counts, in the next micro-batch
    fed.put((9, at(9), 0, 1), (2, at(15), 2, 1))
    assert fed.run() == [(1, at(5), at(15))]
    # one cancel per build, though it is left again; state goes when it is forgotten
    fed.put((1, at(20), 2, 1), (1, at(21), 3, -1), (9, at(50), 1, 1))
    assert fed.run() == [(1, at(5), at(15))]
    before = fed.state_rows()
    fed.put((9, at(90), 2, 1))
    assert fed.run() == [(1, at(5), at(15))]
    assert fed.state_rows() < before


TICKS = "build_id bigint, ts timestamp, seq bigint, bytes bigint, cancelled boolean, deadline timestamp"


def test_a_build_without_further_ticks_is_aborted(spark, tmp_path):
    fed = Fed(spark, tmp_path, TICKS, lambda df: timed.abort_reasons(df, 1000, 60, "0 seconds", 30))
    fed.put((1, at(0), 0, 5, False, at(40)), (2, at(0), 0, 5, False, None), (3, at(1), 0, 2000, False, None), (9, at(30), 0, 1, False, None))
    assert fed.run() == [(3, at(1), "log size")]
    fed.put((2, at(60), 1, 0, None, None), (9, at(60), 1, 1, False, None))
    # a tick at the very end of the silence brings no log, so that it is over right then
    assert fed.run() == [(1, at(40), "timed out"), (2, at(60), "silence"), (3, at(1), "log size")]
    before = fed.state_rows()
    fed.put((9, at(110), 2, 1, False, None))
    assert [r for r in fed.run() if r[0] != 9] == [(1, at(40), "timed out"), (2, at(60), "silence"), (3, at(1), "log size")]
    assert fed.state_rows() < before


@pytest.mark.parametrize("seed", [1, 2])
def test_random_streams_equal_the_twins(spark, tmp_path, seed):
    rng = random.Random(seed)
    end = 1200
    ticks = [(rng.randrange(6), at(rng.randrange(900)), i, rng.choice([0, 0, 5, 300]), rng.random() < 0.02, rng.choice([None, at(700)])) for i in range(70)] + [(99, at(end), 70, 1, False, None)]
    # in each file rows come in any order; files overlap by less than the watermark's delay
    ticks.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(50)))
    fed = Fed(spark, tmp_path, TICKS, lambda df: timed.abort_reasons(df, 1000, 120, "100 seconds", 10**6))
    for k in range(4):
        fed.put(*ticks[k * len(ticks) // 4 : (k + 1) * len(ticks) // 4])
    want = twins.aborts_by_clock(spark.createDataFrame(ticks, TICKS), 1000, 120, F.lit(at(end - 100)))
    assert [r for r in fed.run() if r[0] < 99] == sorted(tuple(r) for r in want.where("build_id < 99").collect())

    (tmp_path / "s").mkdir()
    subs = [(rng.randrange(5), at(rng.randrange(900)), i, rng.choice([1, -1])) for i in range(80)] + [(99, at(end), 80, 1)]
    subs.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(50)))
    fed = Fed(spark, tmp_path / "s", SUBS, lambda df: timed.abandoned(df, 30, "100 seconds", 10**6))
    for k in range(4):
        fed.put(*subs[k * len(subs) // 4 : (k + 1) * len(subs) // 4])
    want = twins.abandoned(spark.createDataFrame(subs, SUBS), 30, F.lit(at(end - 100)))
    assert fed.run() == sorted(tuple(r) for r in want.collect())


ASKED = "job_id bigint, system string, ts timestamp, opens timestamp, closes timestamp"


def test_admissions_are_declined_by_the_clock(spark, tmp_path):
    def make(df):
        return timed.admissions(df.where("ts is not null"), df.where("opens is not null"), 30, "0 seconds", 2)

    key = lambda rows: sorted((j, d, str(s)) for j, d, s in rows)
    fed = Fed(spark, tmp_path, ASKED, make)
    asked = [(1, "a", at(0), None, None), (2, "b", at(1), None, None), (3, "a", at(2), None, None)]
    fed.put(*asked)
    assert fed.run() == []
    there = [(None, "a", None, at(20), at(60)), (None, "b", None, at(40), at(50))]
    fed.put(*there)
    # the worker for system b comes after the grace; job 2 has been declined before it is looked at
    assert key(fed.run()) == key([(1, "waits", at(20)), (2, "declined", None), (3, "waits", at(20))])
    more = [(4, "a", at(59), None, None), (5, "a", at(60), None, None), (6, "c", at(100), None, None)]
    fed.put(*more)
    got = fed.run()
    every = spark.createDataFrame(asked + there + more, ASKED)
    want = twins.admissions(every.where("ts is not null").select("job_id", "system", "ts"), every.where("opens is not null").select("system", "opens", "closes"), 30, F.lit(at(100)))
    assert key(got) == key(tuple(r) for r in want.collect()) and len(got) == 5


def test_the_callers_session_keeps_its_options(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    assert timed.with_timers(spark).conf.get(name) == timed.ROCKSDB and spark.conf.get(name, None) == before


def test_twins_at_the_end_of_what_is_known(spark):
    subs = spark.createDataFrame([(1, at(0), 0, 1), (1, at(5), 1, -1), (1, at(7), 2, -1), (2, at(12), 0, 1)], SUBS)
    assert twins.abandoned(subs, 10).collect() == []
    assert [tuple(r) for r in twins.abandoned(subs, 10, F.lit(at(15))).collect()] == [(1, at(5), at(15))]


def test_admissions_without_more_to_come_are_all_decided(spark, tmp_path):
    rows = [(1, "a", at(0), None, None), (None, "a", None, at(20), at(60)), (2, "a", at(58), None, None), (3, "a", at(60), None, None), (4, "b", at(70), None, None)]
    spark.createDataFrame(rows, ASKED).coalesce(1).write.parquet(f"{tmp_path}/in/0")

    def make(own, moments=None):
        df = own.readStream.schema(ASKED).parquet(f"{tmp_path}/in/*")
        return timed.admissions(df.where("ts is not null"), df.where("opens is not null"), 30, "60 seconds", 2, moments)

    key = lambda df: sorted((r.job_id, r.decision, str(r.served_at)) for r in df.collect())
    assert len(key(timed.settled(make, spark, f"{tmp_path}/open"))) < 4
    every = spark.createDataFrame(rows, ASKED)
    want = twins.admissions(every.where("ts is not null").select("job_id", "system", "ts"), every.where("opens is not null").select("system", "opens", "closes"), 30)
    assert key(timed.settled(make, spark, f"{tmp_path}/ended", "2200-01-01 00:00:00")) == key(want) and want.count() == 4


def test_waiting_rows_are_stored_many_to_an_entry():
    """Each entry of the state, and each call to it, has a cost of its own."""

    class State:
        def __init__(self):
            self.held, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.held)

        def appendList(self, entries):
            self.calls += 1
            self.held += entries

        def clear(self):
            self.calls += 1
            self.held = []

    class Value(State):
        def get(self):
            self.calls += 1
            return self.held[-1] if self.held else None

        def exists(self):
            self.calls += 1
            return bool(self.held)

        def update(self, value):
            self.calls += 1
            self.held = [value]

    rule = timed.Aborts(0, 0, 60)
    rule.waiting, rule.value, timers = State(), Value(), []
    rule.handle = type("Handle", (), {"registerTimer": lambda _, t: timers.append(t), "deleteTimer": lambda _, t: timers.remove(t)})()
    tick = Row("build_id", "at", "rank", "bytes", "cancelled", "deadline")
    rows = [tick(1, 1_000_000 - k, k, None if k % 2 else k, False, None) for k in range(25_000)]
    assert list(rule.handleInputRows((1,), iter(rows), None)) == []
    assert len(rule.waiting.held) == 3 and timers == [976] and rule.waiting.calls + rule.value.calls <= 3
    assert sorted(rule._waiting()) == sorted((r.at, r.rank, r.bytes, r.cancelled, r.deadline) for r in rows)
