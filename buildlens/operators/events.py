"""Counters, buffers, credits and timeouts over lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.functions.scalars import EVENT_OVERHEAD
from buildlens.operators.running import running_sums

REPLAY_CAP = 256 << 20
MAX_RESENDS, MAX_ATTEMPTS, MAX_RECONNECTS = 3, 3, 30
BACKLOG = 1024
COUNTERS = ("submitted", "dispatched", "declined", "requeued", "failed", "succeeded")


def lifecycle_counters(events: DataFrame) -> DataFrame:
    """AGG-1: one row per counter of ``events(kind, duplicate)``. Duplicates are no submissions;
    abandoned and unservable jobs reach no counter."""
    counts = events.where(F.col("kind").isin(*COUNTERS) & ~((F.col("kind") == "submitted") & F.col("duplicate")))
    every = events.sparkSession.createDataFrame([(c,) for c in COUNTERS], "counter string")
    found = counts.groupBy(F.col("kind").alias("counter")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(found), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def queue_depth(events: DataFrame, at: Column) -> DataFrame:
    """AGG-12: jobs whose last event up to ``at`` put them in the queue."""
    last = events.where(F.col("ts") <= at).groupBy("job_id").agg(F.max(F.struct("ts", "seq", "kind"))["kind"].alias("kind"))
    return last.agg(F.count_if(F.col("kind").isin("submitted", "requeued")).alias("depth"))


def verdicts(events: DataFrame) -> DataFrame:
    """AGG-9: per build whether a code or an error concluded it; else it is to be resubmitted."""
    ends = F.col("kind").isin("exit_code", "error")
    return events.groupBy("build_id").agg(
        F.coalesce(F.bool_or(ends), F.lit(False)).alias("concluded"),
        F.max(F.when(ends, F.struct("seq", "kind")))["kind"].alias("last_end"),
    ).withColumn("verdict", F.when(F.col("concluded"), "concluded").otherwise("resubmit"))


def cap_violations(events: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """AGG-10: ``events(id, kind)`` counted; resend rounds and reconnects over their cap, and
    attempts that reach theirs."""
    caps = caps or {"resend": MAX_RESENDS, "attempt": MAX_ATTEMPTS, "reconnect": MAX_RECONNECTS}
    over = F.lit(False)
    for kind, cap in caps.items():
        over = over | ((F.col("kind") == kind) & ((F.col("n") >= cap) if kind == "attempt" else (F.col("n") > cap)))
    return events.where(F.col("kind").isin(*caps)).groupBy("id", "kind").agg(F.count("*").alias("n")).where(over)


def running_jobs(beats: DataFrame) -> DataFrame:
    """AGG-13: ``beats(worker, ts, seq, max_jobs, free, pending, active, load1)``: jobs that the
    latest beat of each worker shows running, and its load."""
    last = beats.groupBy("worker").agg(F.max(F.struct("ts", "seq", "max_jobs", "free", "pending", "active", "load1")).alias("b"))
    return last.select(
        "worker",
        F.greatest(F.lit(0), F.col("b.max_jobs") - F.col("b.free") - (F.col("b.pending") + F.col("b.active"))).cast("bigint").alias("running"),
        F.col("b.load1").alias("load1"),
    )


def replay_accounting(events: DataFrame, cap: int = REPLAY_CAP) -> DataFrame:
    """WIN-1: ``events(build_id, seq, bytes)`` with the running cost and whether the buffer has
    overflowed, for good, once the cost would exceed ``cap``."""
    run = running_sums(events, "build_id", "seq", {"running": F.col("bytes") + EVENT_OVERHEAD})
    # costs are positive, so that a sum over the cap stays there
    return run.withColumn("overflowed", F.col("running") > cap).withColumn("backlog", F.when(F.col("overflowed"), 0).otherwise(F.col("running")))


def late_subscribers(subscriptions: DataFrame, accounting: DataFrame) -> DataFrame:
    """WIN-1: subscriptions after the overflow of their build are rejected."""
    over = accounting.where("overflowed").groupBy("build_id").agg(F.min("seq").alias("over_at"))
    return subscriptions.join(over, "build_id", "left").withColumn("rejected", F.coalesce(F.col("seq") >= F.col("over_at"), F.lit(False)))


def trim_restarts(events: DataFrame) -> DataFrame:
    """WIN-3: the chunks of each (build, path) after its last restart."""
    w = W.partitionBy("build_id", "path_id")
    last = F.max(F.when(F.col("kind") == "restart", F.col("seq"))).over(w)
    return events.withColumn("last_restart", last).where(
        (F.col("kind") == "chunk") & (F.col("last_restart").isNull() | (F.col("seq") > F.col("last_restart")))
    ).drop("last_restart")


def credit_ledger(events: DataFrame) -> DataFrame:
    """WIN-5: ``events(session, seq, kind)`` with the running balance: a request adds one, an
    assignment takes one, a resumed assignment nothing; ``ok`` unless it has been below 0."""
    change = F.when(F.col("kind") == "request_job", 1).when(F.col("kind") == "assignment", -1).otherwise(0)
    run = running_sums(events, "session", "seq", {"balance": change}, ("balance",))
    return run.withColumn("ok", F.col("balance_low") >= 0).drop("balance_low")


def backoff(sessions: DataFrame, longest: int = 60) -> DataFrame:
    """WIN-6: ``sessions(worker, n, seconds)`` with the delay after each: 1 s, doubled up to
    ``longest``, and 1 s again after a session of more than a minute."""
    w = W.partitionBy("worker").orderBy("n")
    reset = (F.col("seconds") > 60).cast("int")
    return (
        sessions.withColumn("island", F.sum(reset).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(W.partitionBy("worker", "island").orderBy("n")) - 1)
        .withColumn("delay", F.least(F.lit(longest), F.pow(F.lit(2), F.least("place", F.lit(30)))).cast("bigint"))
        .drop("island", "place")
    )


def slow_subscribers(events: DataFrame, limit: int = BACKLOG) -> DataFrame:
    """WIN-9: ``events(build_id, seq, subscriber)``: a null subscriber is a produced event, else
    that subscriber consumed one. The first position at which a subscriber lags by more than ``limit``."""
    w = W.partitionBy("build_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    made = events.withColumn("produced", F.count_if(F.col("subscriber").isNull()).over(w))
    v = W.partitionBy("build_id", "subscriber").orderBy("seq")
    reads = made.where("subscriber is not null").withColumn("consumed", F.row_number().over(v))
    # between two reads the lag is greatest just before the later one
    lag = F.col("produced") - (F.col("consumed") - 1)
    return reads.where(lag > limit).groupBy("build_id", "subscriber").agg(F.min("seq").alias("seq"), F.max(lag).alias("lag"))
