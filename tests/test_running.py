"""Running sums, as-of joins and contents over chunks against plain Python."""

import datetime as dt
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import events as ev
from buildlens.operators import matching, staging
from buildlens.operators.running import as_of, running_sums
from buildlens.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_sums(spark, size):
    rng = random.Random(size)
    # half of the rows have one key; null is a key; some keys begin below 0
    rows = [(rng.choice(["a", "a", "a", "b", None]), i - 50, rng.randrange(-5, 9)) for i in range(300)]
    got = running_sums(spark.createDataFrame(rows, "k string, seq int, v bigint"), "k", "seq", {"s": F.col("v"), "n": F.lit(1)}, ("s",), size)
    want, sums, lows, counts = [], {}, {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        lows[k] = min(lows.get(k, sums[k]), sums[k])
        counts[k] = counts.get(k, 0) + 1
        want.append((str(k), i, v, sums[k], counts[k], lows[k]))
    assert sorted((str(r.k), r.seq, r.v, r.s, r.n, r.s_low) for r in got.collect()) == sorted(want)


def test_one_build_with_half_of_the_rows_runs_in_many_tasks(spark):
    events = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("build_id"), F.col("id").alias("seq"), F.lit(10).cast("bigint").alias("bytes"))
    got = ev.replay_accounting(events, 1 << 22)
    assert "_bucket" not in got.columns
    one = got.where("build_id = 0").agg(F.max("running"), F.count_if("overflowed")).first()
    cost = 10 + ev.EVENT_OVERHEAD
    assert tuple(one) == (100_000 * cost, 100_000 - (1 << 22) // cost)
    buckets = running_sums(events, "build_id", "seq", {"r": F.col("bytes")}).where("build_id = 0").groupBy(F.floor(F.col("seq") / (1 << 16))).count()
    assert buckets.count() == 4


def test_as_of_and_its_users(spark):
    rng = random.Random(3)
    asked = [(i, rng.choice(["x", "x", "x", "y", None]), at(rng.randrange(20_000))) for i in range(200)]
    there = [(rng.choice(["x", "y", "z", None]), t := rng.randrange(20_000), t + rng.randrange(-5, 900)) for _ in range(40)]
    rows = spark.createDataFrame(asked, "job_id int, system string, ts timestamp")
    facts = spark.createDataFrame([(s, at(a), at(b)) for s, a, b in there], "system string, opens timestamp, closes timestamp")
    for seconds in (60, 3600, 10**6):
        got = as_of(rows, facts, ["system"], "ts", "opens", "closes", seconds)
        assert sorted((r.job_id, str(r.best), str(r.next)) for r in got.collect()) == sorted(
            (i, str(max((at(b) for s2, a, b in there if s2 == s is not None and at(a) <= t), default=None)), str(min((at(a) for s2, a, b in there if s2 == s is not None and at(a) >= t), default=None))) for i, s, t in asked
        )
    decided = twins.admissions(rows, facts, 300)
    for r in decided.collect():
        _, s, t = asked[r.job_id]
        served = min((max(at(a), t) for s2, a, b in there if s2 == s is not None and b > a and at(b) > t and at(a) <= t + dt.timedelta(seconds=300)), default=None)
        assert (r.served_at, r.decision) == (served, "declined" if served is None else "now" if served == t else "waits")
    messages = spark.createDataFrame([(i, s, t) for i, s, t in asked], "seq int, build_id string, ts timestamp")
    sessions = facts.toDF("build_id", "opened_at", "closed_at")
    for r in staging.route(messages, sessions).collect():
        assert r.routed == any(s == r.build_id is not None and at(a) <= r.ts <= at(b) for s, a, b in there)


def test_expected_deadline_by_distinct_needs(spark):
    rng = random.Random(4)
    features = ["kvm", "big", "uid"]
    some = lambda: rng.sample(features, rng.randrange(4))
    jobs = [(i, at(rng.randrange(5000)), rng.choice("ab"), some()) for i in range(150)]
    gone = [(rng.choice("ab"), some(), at(rng.randrange(5000))) for _ in range(30)]
    got = matching.expected_deadline(
        spark.createDataFrame(jobs, "job_id int, submitted_at timestamp, system string, features array<string>"), spark.createDataFrame(gone, "system string, have array<string>, departed_at timestamp"), F.lit(at(0)), 600
    )
    grace = dt.timedelta(seconds=600)
    for r in got.collect():
        _, t, s, need = jobs[r.job_id]
        last = max((d for s2, have, d in gone if s2 == s and set(need) <= set(have) and d <= t < d + grace), default=None)
        assert r.deadline == (at(600) if t < at(600) else None if last is None else last + grace)


CHUNKS = "path_id string, seq int, chunk binary, eof boolean"


def cut_rows(path, data, size, eof=True):
    parts = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    return [(path, k, p, eof and k == len(parts) - 1) for k, p in enumerate(parts)]


def test_digests_go_over_chunks_and_batches(spark):
    rng = random.Random(6)
    content = {p: rng.randbytes(n) for p, n in (("a", 100_000), ("b", 0), ("c", 1), ("d", 31))}
    rows = [r for p, c in content.items() for r in cut_rows(p, c, 7)]
    rows += [("a", 10**6, b"after the end", False), ("e", 0, b"xy", False), ("e", 1, None, None), ("e", 2, b"z", False)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.path_id: (r.chunks, r.bytes, r.complete, r.sha256) for r in staging.stream_digests(spark.createDataFrame(rows, CHUNKS)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {p: (max(1, -(-len(c) // 7)), len(c), True, hashlib.sha256(c).hexdigest()) for p, c in content.items()}
    assert got == want | {"e": (3, 3, False, hashlib.sha256(b"xyz").hexdigest())}
    told = [(p, len(c) + (p == "c"), hashlib.sha256(c).hexdigest()) for p, c in content.items()] + [("e", 3, want["c"][3]), ("none", 5, "x"), ("d2", None, None)]
    state = staging.check_archives(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(told, "path_id string, nar_size bigint, nar_sha256 string"))
    assert {(r.path_id, r.received, r.state, r.verified) for r in state.collect()} == {
        ("a", 100_000, "ok", True), ("b", 0, "ok", True), ("c", 1, "short", True), ("d", 31, "ok", True), ("e", 3, "ok", False), ("none", 0, "missing", False), ("d2", 0, "missing", False),
    }


def test_an_archive_beyond_the_cap(spark):
    rows = spark.createDataFrame(cut_rows("p", b"123456789", 2), CHUNKS)
    text = rows.withColumn("chunk", F.col("chunk").cast("string"))
    whole = staging.reassemble(text, 4)
    assert whole.first()["content"] is None and whole.first()["bytes"] == 9
    told = spark.createDataFrame([("p", 100)], "path_id string, nar_size bigint")
    # nothing is called right that has not been looked at
    assert [r.state for r in staging.check_sizes(whole, told).collect()] == ["short"]
    assert [r.state for r in staging.check_sizes(whole.drop("bytes"), told).collect()] == ["unknown"]
    assert [r.ok for r in staging.verify_digests(whole, spark.createDataFrame([("p", "x")], "path_id string, sha256 string")).collect()] == [False]
    assert [r.content_id for r in staging.unscanned(whole.withColumnRenamed("path_id", "content_id")).collect()] == ["p"]
    told = spark.createDataFrame([("p", 9, hashlib.sha256(b"123456789").hexdigest())], "path_id string, nar_size bigint, nar_sha256 string")
    assert [(r.state, r.verified) for r in staging.check_archives(rows, told).collect()] == [("ok", True)]


def test_references_are_found_at_every_cut(spark):
    token = {"t1": "0123456789abcdfghijklmnpqrsvwxyz", "t2": "z" * 32, "own": "1" * 32}
    content = f"-{token['t1']}/x {token['own']} {token['t2'][:31]}! {'z' * 40}"
    candidates = spark.createDataFrame(list(token.items()), "item_id string, token string")
    rows = list(itertools.chain(*(cut_rows(f"p{n}", content.encode(), n) for n in range(1, len(content) + 2))))
    rows += [("own", k, b, e) for _, k, b, e in cut_rows("", content.encode(), 5)]
    # empty chunks between, and a hash that only stands behind the end
    rows += [("gap", 0, content[:20].encode(), False), ("gap", 1, b"", False), ("gap", 2, None, False), ("gap", 3, content[20:].encode(), True)]
    rows += [("late", 0, content[:20].encode(), True), ("late", 1, content[20:].encode(), False)]
    got = {(r.content_id, r.item_id) for r in staging.scan_chunks(spark.createDataFrame(rows, CHUNKS), candidates).collect()}
    every = {r[0] for r in rows} - {"late"}
    assert got == {(p, t) for p in every for t in token if p != t}
