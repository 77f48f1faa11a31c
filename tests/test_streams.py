"""Every stream gives the rows of its batch twin."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from buildlens.operators.events import lifecycle_counters
from buildlens.sources import logtail
from buildlens.sources.readers import tail_logs
from buildlens.streaming import gauges, streams, twins, upserts

T0 = dt.datetime(2024, 1, 1)
#: A last event, so late that it moves the watermark past all others.
END = T0 + dt.timedelta(days=400)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def replay(spark, tmp_path, rows, schema, batches=3):
    """``rows`` as a stream of files read one after the other."""
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] if batches == 1 else rows[k * len(rows) // batches : (k + 1) * len(rows) // batches], schema).coalesce(1).write.parquet(
            f"{tmp_path}/in/{k}"
        )
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def drain(df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_silent_workers(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted([(f"w{rng.randrange(3)}", at(rng.randrange(4000))) for _ in range(60)], key=lambda r: r[1]) + [("end", END)]
    schema = "worker string, ts timestamp"
    got = drain(streams.silent_workers(replay(spark, tmp_path, [*rows, ("end2", END + dt.timedelta(days=9))], schema), 180), tmp_path, "append", "silent")
    want = twins.silent_workers(spark.createDataFrame(rows[:-1], schema), 180)
    cols = ("worker", "started", "last_seen", "messages")
    assert [r for r in rows_of(got, *cols) if not r[0].startswith("end")] == rows_of(want, *cols)


def test_expired_results(spark, tmp_path):
    done = [(i, at(i * 10)) for i in range(20)] + [(99, END), (100, END + dt.timedelta(days=1))]
    acks = [(i, at(i * 10 + d)) for i, d in ((1, 0), (2, 300), (3, 301), (4, 100))] + [(98, END), (97, END + dt.timedelta(days=1))]
    f = replay(spark, tmp_path / "f", done, "result_id int, finished_at timestamp", 2)
    a = replay(spark, tmp_path / "a", acks, "result_id int, acked_at timestamp", 2)
    got = drain(streams.expired_results(f, a, 300, "1 day"), tmp_path, "append", "expired")
    want = twins.expired_results(spark.createDataFrame(done[:20], "result_id int, finished_at timestamp"), spark.createDataFrame(acks[:4], "result_id int, acked_at timestamp"), 300)
    assert [r for r in rows_of(got, "result_id") if r[0] < 90] == rows_of(want, "result_id")


def test_dedupe_counters_and_logs(spark, tmp_path):
    rows = [(i % 7, at(i), i, "submitted" if i % 3 else "failed", i % 4 == 0, i * 10) for i in range(40)]
    schema = "dedupe_key int, ts timestamp, seq int, kind string, duplicate boolean, bytes bigint"
    batch = spark.createDataFrame(rows, schema)
    got = drain(streams.dedupe_results(replay(spark, tmp_path, rows, schema)), tmp_path, "append", "dedupe")
    assert rows_of(got, "dedupe_key") == rows_of(twins.dedupe_results(batch), "dedupe_key")
    counted = drain(streams.live_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")), tmp_path, "complete", "counters")
    assert rows_of(counted, "counter", "n") == rows_of(lifecycle_counters(batch).where("n > 0"), "counter", "n")
    logs = drain(streams.live_log_bytes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*").withColumnRenamed("dedupe_key", "build_id")), tmp_path, "complete", "logs")
    assert rows_of(logs, "build_id", "bytes") == rows_of(twins.live_log_bytes(batch.withColumnRenamed("dedupe_key", "build_id")), "build_id", "bytes")


STATES = "dedupe_key string, phase string, build_id string, updated_at int"


def test_latest_states(spark, tmp_path):
    rows = [("k1", "running", "a", 1), ("k2", "running", "b", 2), ("k1", "finished", "a", 3), ("k1", "running", "c", 4), ("k2", "running", "d", 5), (None, "running", "e", 6)]
    stream = replay(spark, tmp_path, rows, STATES)
    upserts.latest_state_stream(stream, f"{tmp_path}/state").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    got = upserts.upserted(spark, f"{tmp_path}/state", stream.schema)
    assert {(r.dedupe_key, r.build_id) for r in got.collect()} == {("k1", "a"), ("k2", "d"), (None, "e")}


def test_a_batch_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    table = f"{tmp_path}/table"
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    read = lambda **kw: {(r.k, r.v) for r in upserts.upserted(spark, table, df([]).schema, **kw).collect()}
    first = df([(k, "old") for k in range(200)])
    upserts.put(first, "k", upserts.touched_buckets(first, "k"), table, 0)
    one = upserts.touched_buckets(df([(7, "")]), "k")
    others = {k for (k, _) in read(buckets=one)}
    assert len(one) == 1 and 7 in others and len(others) < 20
    for _ in range(2):  # a batch that runs again replaces itself
        upserts.put(df([(k, "new" if k == 7 else "old") for k in others]), "k", one, table, 1)
        assert sorted(p.name for p in (tmp_path / "table" / "version=1").iterdir() if p.is_dir()) == [f"bucket={one[0]}"]
        assert read() == {(k, "new" if k == 7 else "old") for k in range(200)}
    # an unfinished version is not seen, and a bucket without rows stays without them
    upserts.put(df([]), "k", one, table, 2)
    assert read() == {(k, "old") for k in set(range(200)) - others} and read(before=2) == {(k, "new" if k == 7 else "old") for k in range(200)}
    (tmp_path / "table" / "version=2" / "_SUCCESS").unlink()
    assert (7, "new") in read()
    # of each bucket two finished versions stay
    for n in (3, 4):
        upserts.put(df([(7, str(n))]), "k", one, table, n)
    held = upserts.versions(spark, table)
    assert held[one[0]] == [4, 3] and all(v == [0] for b, v in held.items() if b != one[0])


def test_a_growing_log_yields_only_new_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logtail, "CHUNK", 4)
    logs = tmp_path / "logs"

    def log(build, data):
        (logs / build).mkdir(parents=True, exist_ok=True)
        with open(logs / build / "build.log", "ab") as f:
            f.write(data)

    def read(refuse=False):
        new = []

        def step(batch, _):
            rows = batch.orderBy("build_id", "at").collect()
            if refuse:
                raise ValueError("refused")
            new.extend((r.build_id, r.at, bytes(r.data)) for r in rows)

        q = logtail.tail_growing_logs(spark, f"file://{logs}").writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert refuse and "refused" in str(e)
        return {b: (min(a for n, a, _ in new if n == b), b"".join(d for n, _, d in new if n == b)) for b in {n for n, _, _ in new}}

    (logs / "none").mkdir(parents=True)
    log("a", b"first line\nsec\xff")
    log("empty", b"")
    assert read() == {"a": (0, b"first line\nsec\xff")}
    log("a", b"ond\n")
    log("b", b"x")
    assert read(refuse=True) == {}
    log("a", b"third")
    assert read() == {"a": (15, b"ond\n"), "b": (0, b"x")}  # the refused batch again, as it was
    assert read() == {"a": (19, b"third")}
    assert read() == {}


def test_long_logs_are_cut_in_tasks(monkeypatch):
    monkeypatch.setattr(logtail, "PIECE", 10)
    monkeypatch.setattr(logtail, "TASK", 25)
    monkeypatch.setattr(logtail, "FILES", 3)
    start, end = {"a": 5, "b": 7, "short": 9}, {"a": 48, "b": 7, "c": 3, "d": 1, "e": 1, "f": 1, "g": 1, "short": 4}
    tasks = [t.pieces for t in logtail.packed(start, end)]
    assert all(len(t) <= 3 and sum(hi - lo for _, lo, hi in t) <= 25 for t in tasks)
    pieces = [p for t in tasks for p in t]
    assert {b: sum(hi - lo for n, lo, hi in pieces if n == b) for b in end} == {"a": 43, "b": 0, "c": 3, "d": 1, "e": 1, "f": 1, "g": 1, "short": 0}
    assert max(hi - lo for _, lo, hi in pieces) == 10


def test_gauges_take_back_what_no_longer_holds(spark, tmp_path):
    """Micro-batches one after the other; events within and across them out of order."""
    schema = "session string, ts timestamp, seq int, worker_name string, systems array<string>"
    rows = [("s1", at(0), 0, "w", ["x", "x", "y"]), ("s2", at(1), 1, "w", ["x"]), ("s3", at(2), 2, "v", None)]
    rows += [("s3", at(1), 9, "v", ["z"]), ("s1", at(5), 3, "w", ["y"]), ("s4", at(5), 4, "u", [])]
    rows += [("s2", at(9), 6, "w", None), ("s2", at(8), 5, "w", ["q"]), ("s4", at(9), 7, "u", ["x"])]
    replay(spark, tmp_path / "s", rows, schema)
    jobs = [(1, at(0), 0, "submitted"), (2, at(0), 1, "submitted"), (3, at(1), 2, "requeued"), (2, at(3), 4, "dispatched"), (2, at(2), 3, "requeued"), (4, at(400 * 86_400), 9, "succeeded")]
    replay(spark, tmp_path / "j", jobs, "job_id int, ts timestamp, seq int, kind string")

    def entities(own):
        read = lambda part, s: own.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{part}/in/*")
        return gauges.session_rows(read("s", schema)).unionByName(gauges.job_rows(read("j", "job_id int, ts timestamp, seq int, kind string")))

    got = gauges.live_gauges(entities, spark, f"{tmp_path}/g")
    assert {(r.metric, r.worker, r.system, r.value) for r in got.collect()} == {
        ("queue_depth", None, None, 2), ("workers_connected", None, None, 2), ("builder_up", "w", "y", 1), ("builder_up", "u", "x", 1),
        ("workers_for_system", None, "y", 1), ("workers_for_system", None, "x", 1),
    }
    changed = spark.read.schema(gauges.CHANGE).parquet(f"{tmp_path}/g/changes")
    assert changed.where("change < 0").count() > 0


def test_log_tail_resumes(spark, tmp_path):
    schema = "build_id string, seq bigint, ts timestamp, data binary"
    write = lambda k, rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/logs/{k}")
    write("x", [("b", 0, T0, b"abcd")])

    def read():
        q = tail_logs(spark, f"{tmp_path}/logs/*").select("build_id", "seq", F.col("data").cast("string").alias("data"))
        q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        return rows_of(spark.read.parquet(f"{tmp_path}/out"), "seq", "data")

    assert read() == [(0, "abcd")]
    write("x", [("b", 1, T0, b"efg")])
    assert read() == [(0, "abcd"), (1, "efg")]


def test_keys_of_earlier_batches_stay(spark, tmp_path):
    lost = [(1, at(0), 0, "lost"), (1, at(1), 1, "lost"), (2, at(2), 0, "ran"), (None, at(3), 0, "lost"), (2, at(3), 1, "lost"), (1, at(4), 2, "lost"), (3, at(5), 0, "lost")]
    schema = "job_id int, ts timestamp, seq int, kind string"
    q = upserts.by_batch(replay(spark, tmp_path / "r", lost, schema), lambda df: twins.requeues(df, 30), f"{tmp_path}/out6", f"{tmp_path}/events6")
    q.option("checkpointLocation", f"{tmp_path}/c6").trigger(availableNow=True).start().awaitTermination(120)
    cols = ("job_id", "ts", "attempts", "requeued")
    key = lambda df: {tuple(r[c] for c in cols) for r in df.collect()}
    want = twins.requeues(spark.createDataFrame(lost, schema), 30)
    assert key(upserts.upserted(spark, f"{tmp_path}/out6", want.schema)) == key(want)


def test_gauges_pass_on_the_newest_row_of_each_entity(spark, monkeypatch):
    """Each row that reaches the state costs a conversion of its own, so older ones of a task are left out before."""
    rows = [(f"job:{k % 7}", k, 0, ["queue_depth"], [None], [None]) for k in range(1000)] + [("job:3", 2000, 1, [], [], []), ("job:3", 2000, 0, ["queue_depth"], [None], [None])]
    schema = "entity string, at bigint, rank bigint, gauges array<string>, workers array<string>, systems array<string>"
    batch = pa.RecordBatch.from_pylist([dict(zip(("entity", "at", "rank", "gauges", "workers", "systems"), r, strict=True)) for r in rows])
    want = {r[0]: r for r in sorted(rows, key=lambda r: r[1:3])}
    for size in (1 << 17, 100, 4):
        monkeypatch.setattr(gauges, "AT_ONCE", size)
        parts = [batch.slice(k, 90) for k in range(0, len(rows), 90)]
        got = [r for b in gauges._newest_of_task(iter(parts)) for r in b.to_pylist()]
        assert len(got) == 7 if size > 100 else len(got) < 100
        assert {r["entity"]: tuple(r.values()) for r in sorted(got, key=lambda r: (r["at"], r["rank"]))} == want
    assert list(gauges._newest_of_task(iter([batch.slice(0, 0)]))) == []
    assert "MapInArrow" in gauges.changes(spark.createDataFrame(rows, schema))._jdf.queryExecution().toString()
