"""Timeout rules on bounded tables; the streams must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.operators.running import as_of


def seconds(n: int) -> Column:
    return F.make_interval(secs=F.lit(n))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def silent_workers(messages: DataFrame, gap: int = 180) -> DataFrame:
    """STR-1: ``messages(worker, ts)`` to sessions: a silence of more than ``gap`` seconds ends one."""
    w = W.partitionBy("worker").orderBy("ts")
    fresh = micros(F.col("ts")) - micros(F.lag("ts").over(w)) > gap * 1_000_000
    island = F.sum(F.coalesce(fresh.cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return (
        messages.withColumn("session", island)
        .groupBy("worker", "session")
        .agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("messages"))
        .select("worker", "started", "last_seen", "messages")
    )


def abort_reasons(ticks: DataFrame, max_bytes: int, max_silence: int) -> DataFrame:
    """STR-2: ``ticks(build_id, ts, seq, bytes, cancelled, deadline)``: the first tick with a
    reason, and that reason. A tick carries new log bytes, or none when only the clock moved.

    Cancelled comes before timed out (``ts >= deadline``), log size (``> max_bytes``) and
    silence (``> max_silence`` seconds since the last log); a limit of 0 is off.
    """
    w = W.partitionBy("build_id").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    size = F.sum("bytes").over(upto)
    quiet = micros(F.col("ts")) - micros(
        F.coalesce(F.last(F.when(F.col("bytes") > 0, F.col("ts")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("ts").over(upto))
    )
    reason = F.when(F.col("cancelled"), "cancelled").when(F.col("ts") >= F.col("deadline"), "timed out")
    if max_bytes > 0:
        reason = reason.when(F.col("log_bytes") > max_bytes, "log size")
    if max_silence > 0:
        reason = reason.when(F.col("quiet") > max_silence * 1_000_000, "silence")
    judged = ticks.withColumn("log_bytes", size).withColumn("quiet", quiet).withColumn("reason", reason).where("reason is not null")
    return judged.groupBy("build_id").agg(F.min(F.struct("ts", "seq", "reason")).alias("f")).select("build_id", "f.ts", "f.reason")


def aborts_by_clock(ticks: DataFrame, max_bytes: int, max_silence: int, until: Column) -> DataFrame:
    """STR-2 where the clock is watched between ticks too: the first reason of ``abort_reasons``, or
    the deadline, or the end of ``max_silence`` seconds without a log, whichever comes first; as known
    at ``until``. A tick at that very moment is looked at first."""
    w = W.partitionBy("build_id").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    log = F.when(F.col("bytes") > 0, F.col("ts"))
    quiet = micros(F.col("ts")) - micros(F.coalesce(F.last(log, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("ts").over(upto)))
    reason = F.when(F.col("cancelled"), "cancelled").when(F.col("ts") >= F.col("deadline"), "timed out")
    ends, out_of_time = F.lit(None).cast(ticks.schema["ts"].dataType), F.col("deadline")
    if max_bytes > 0:
        reason = reason.when(F.col("log_bytes") > max_bytes, "log size")
    if max_silence > 0:
        reason = reason.when(F.col("quiet") > max_silence * 1_000_000, "silence")
        ends = F.coalesce(F.last(log, ignorenulls=True).over(upto), F.first("ts").over(upto)) + seconds(max_silence)
    seen = ticks.withColumns({"log_bytes": F.sum("bytes").over(upto), "quiet": quiet, "ends": ends, "next": F.lead("ts").over(w)})
    seen = seen.withColumns({"reason": reason, "clock": F.least(out_of_time, F.col("ends"))})
    by_tick = seen.where("reason is not null").select("build_id", "ts", F.lit(0).alias("order"), "seq", "reason")
    by_clock = seen.where("next is null or next > clock").select(
        "build_id", F.col("clock").alias("ts"), F.lit(1).alias("order"), "seq", F.when(F.col("deadline") <= F.coalesce("ends", "deadline"), "timed out").otherwise("silence").alias("reason")
    )
    first = by_tick.unionByName(by_clock).where(F.col("ts") <= until).groupBy("build_id").agg(F.min(F.struct("ts", "order", "seq", "reason")).alias("f"))
    return first.select("build_id", "f.ts", "f.reason")


def abandoned(subs: DataFrame, grace: int = 10, until: Column | None = None) -> DataFrame:
    """STR-3: ``subs(build_id, ts, seq, change)`` with +1 and -1 for listeners: the first time
    that no listener has been there for more than ``grace`` seconds; a return resets the clock,
    a further leave does not. What is not over at ``until``, the last event unless given, is
    not yet abandoned."""
    until = subs.agg(F.max("ts")).scalar() if until is None else until
    w = W.partitionBy("build_id").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    counted = subs.withColumn("listeners", F.sum("change").over(upto))
    gone = F.col("listeners") <= 0
    runs = counted.withColumn("run", F.count_if(~gone).over(upto)).withColumn("back", F.min(F.when(~gone, F.col("ts"))).over(w.rowsBetween(1, W.unboundedFollowing)))
    spans = runs.where(gone).groupBy("build_id", "run").agg(F.min("ts").alias("left_at"), F.max("back").alias("back"))
    ended = spans.where((F.col("back") > F.col("left_at") + seconds(grace)) | F.col("back").isNull()).where(F.col("left_at") + seconds(grace) <= until)
    return ended.groupBy("build_id").agg(F.min("left_at").alias("left_at")).select("build_id", "left_at", (F.col("left_at") + seconds(grace)).alias("abandoned_at"))


def expired_results(finished: DataFrame, acks: DataFrame, ttl: int = 300) -> DataFrame:
    """STR-4: ``finished(result_id, finished_at)`` without an ``acks(result_id, acked_at)``
    within ``ttl`` seconds. Strictly later acknowledgements come too late."""
    in_time = finished.join(acks, "result_id").where(
        (F.col("acked_at") >= F.col("finished_at")) & (F.col("acked_at") <= F.col("finished_at") + seconds(ttl))
    )
    return finished.join(in_time.select("result_id").distinct(), "result_id", "left_anti").select("result_id", "finished_at")


def dedupe_results(results: DataFrame) -> DataFrame:
    """STR-5: the first delivery of each key (``dedupe_key``)."""
    return results.groupBy("dedupe_key").agg(F.min(F.struct("ts", "seq"))["seq"].alias("seq"))


def requeues(events: DataFrame, grace: int, most: int = 3) -> DataFrame:
    """STR-6: ``events(job_id, ts, seq, kind)`` where ``lost`` is a lost session: attempts after
    each loss, whether the job was requeued, and until when a sweep spares it. A job is requeued
    while it has been less than ``most`` times before; the loss after that fails it."""
    w = W.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    lost = events.where(F.col("kind") == "lost").withColumn("attempts", F.count("*").over(w))
    again = F.col("attempts") <= most
    return lost.where(F.col("attempts") <= most + 1).select(
        "job_id", "ts", "attempts", again.alias("requeued"), F.when(again, F.col("ts") + seconds(grace)).alias("protected_until")
    )


def admissions(submits: DataFrame, intervals: DataFrame, grace: int, until: Column | None = None) -> DataFrame:
    """STR-7: ``submits(job_id, system, ts)`` against ``intervals(system, opens, closes)`` in
    which a capable worker is there: served now, waits until it opens within ``grace``, or
    declined. With ``until`` only what has been decided by then. An interval that closes no
    later than it opens holds nothing."""
    held = as_of(submits, intervals.where("closes > opens"), ["system"], "ts", "opens", "closes")
    last = F.col("ts") + seconds(grace)
    served = F.when(F.col("best") > F.col("ts"), F.col("ts")).when(F.col("next") <= last, F.col("next"))
    decided = held.withColumn("served_at", served).where(F.lit(True) if until is None else F.coalesce("served_at", last) <= until)
    return decided.select(
        "job_id",
        F.when(F.col("served_at").isNull(), "declined").when(F.col("served_at") == F.col("ts"), "now").otherwise("waits").alias("decision"),
        "served_at",
    )


def live_log_bytes(messages: DataFrame) -> DataFrame:
    """STR-9 on a bounded table: bytes, first and last time of each build's log. Bytes a second are
    the one by the span of the others (``log_rate``)."""
    return messages.groupBy("build_id").agg(F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def log_rate(logs: DataFrame) -> DataFrame:
    """STR-9: ``live_log_bytes``, of a table or a stream, with ``bytes_per_second``; null for a log of one moment."""
    span = (micros(F.col("last_ts")) - micros(F.col("first_ts"))) / 1_000_000
    return logs.withColumn("bytes_per_second", F.when(span > 0, F.col("bytes") / span))
