"""Rules that act when time passes and nothing arrives, as stateful processors with event-time timers.

A group's rows wait in its state until the watermark has passed them, so that they are taken in the
order of their time, however they arrived. A timer stands at the next moment at which something is to
be done: the next waiting row, or a deadline. What the rule announces comes out when the watermark
reaches that moment, never before, and once. Times are microseconds since the epoch; timers
have milliseconds. All need the RocksDB state store (``with_timers``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ways in which the submissions to one system are dealt out; its intervals go to each.
WAYS = 8
#: Waiting rows of a key that are stored as one entry of its state.
PACK = 10_000
#: A stream in which only the time passes.
MOMENTS = "ts timestamp"


def with_timers(spark: SparkSession) -> SparkSession:
    """A session of the same application that can run these rules; the caller's options stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def _milli(micros: int) -> int:
    """The first millisecond that is not before ``micros``."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (at, rank), and one timer at a time. Waiting rows are stored by
    column, up to PACK in an entry, since each entry has a cost of its own, as each call to the state has.

    Subclasses say which ``columns`` a row has, beginning with ``at`` and ``rank``, how they are
    stored (``stored``) and what is kept per key (``kept``, ``new``). ``take`` gets the kept
    values and the next row, ``pass_time`` the time up to which every row has been taken; both
    return the output rows of that moment. ``next_moment`` is when to look again without a row.
    """

    columns: tuple[str, ...]
    stored: str
    kept: str
    new: tuple
    out: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", re.sub(r"(\w+) (\w+)", r"\1 array<\2>", self.stored))
        self.value = handle.getValueState("kept", self.kept + ", timer bigint")

    def take(self, kept: list, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def pass_time(self, kept: list, upto: int) -> list[tuple]:
        raise NotImplementedError

    def next_moment(self, kept: list) -> int | None:
        raise NotImplementedError

    def _load(self) -> tuple[list, int | None]:
        *kept, timer = self.value.get() or (*self.new, None)
        return kept, timer

    def _waiting(self) -> list[tuple]:
        return [row for entry in self.waiting.get() for row in zip(*entry, strict=True)]

    def _packed(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[k : k + PACK], strict=True))) for k in range(0, len(rows), PACK)]

    def _set_timer(self, kept: list, timer: int | None, row_at: int | None) -> None:
        moments = [m for m in (row_at, self.next_moment(kept)) if m is not None]
        wanted = _milli(min(moments)) if moments else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self._save(kept, wanted)

    def _save(self, kept: list, timer: int | None) -> None:
        if timer is None and kept == list(self.new[: len(kept)]):
            self.value.clear()
        else:
            self.value.update((*kept, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = list(rows)
        places = [found[0].__fields__.index(c) for c in self.columns]
        fresh = [tuple(r[i] for i in places) for r in found]
        self.waiting.appendList(self._packed(fresh))
        kept, timer = self._load()
        first = min(r[0] for r in fresh)
        self._set_timer(kept, timer, first if timer is None else min(first, timer * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self._waiting(), key=lambda r: r[:2])
        kept, _ = self._load()
        found: list[tuple] = []
        due = [r for r in rows if r[0] <= upto]
        for row in due:
            found += self.pass_time(kept, row[0] - 1)
            found += self.take(kept, row)
        found += self.pass_time(kept, upto)
        later = rows[len(due) :]
        if later and due:
            self.waiting.put(self._packed(later))
        elif due:
            self.waiting.clear()
        # the timer that has fired is gone
        self._set_timer(kept, None, later[0][0] if later else None)
        made = Row(*self.out)
        for row in found:
            yield made(*key, *row)

    def close(self) -> None:
        pass


class Abandoned(InOrder):
    """STR-3. Kept: listeners, since when there are none, and until when an announced build is remembered."""

    columns, stored = ("at", "rank", "change"), "at bigint, rank bigint, change bigint"
    kept, new = "listeners bigint, gone bigint, forget bigint", (0, None, None)
    out = ("build_id", "left_at", "abandoned_at")

    def __init__(self, grace: int, remember: int):
        self.grace, self.remember = grace * 1_000_000, remember * 1_000_000

    def take(self, kept, row):
        if kept[2] is None:
            kept[0] += row[2]
            kept[1] = None if kept[0] > 0 else row[0] if kept[1] is None else kept[1]
        return []

    def pass_time(self, kept, upto):
        listeners, gone, forget = kept
        if forget is not None:
            if forget <= upto:
                kept[:] = self.new
            return []
        if gone is None or gone + self.grace > upto:
            return []
        kept[:] = [0, None, gone + self.grace + self.remember]
        return [(gone, gone + self.grace)]

    def next_moment(self, kept):
        return kept[2] if kept[2] is not None else None if kept[1] is None else kept[1] + self.grace


class Aborts(InOrder):
    """STR-2. Kept: log bytes, time of the last log (or the first tick), deadline, and until when an ended build is remembered."""

    columns = ("at", "rank", "bytes", "cancelled", "deadline")
    stored = "at bigint, rank bigint, bytes bigint, cancelled boolean, deadline bigint"
    kept, new = "bytes bigint, heard bigint, deadline bigint, forget bigint", (0, None, None, None)
    out = ("build_id", "at", "reason")

    def __init__(self, max_bytes: int, max_silence: int, remember: int):
        self.max_bytes, self.max_silence, self.remember = max_bytes, max_silence * 1_000_000, remember * 1_000_000

    def _end(self, kept, at, reason):
        kept[:] = [0, None, None, at + self.remember]
        return [(at, reason)]

    def take(self, kept, row):
        at, _, n, cancelled, deadline = row
        if kept[3] is not None:
            return []
        kept[0] += n or 0
        kept[1] = at if kept[1] is None else kept[1]
        kept[2] = deadline
        if cancelled:
            return self._end(kept, at, "cancelled")
        if deadline is not None and at >= deadline:
            return self._end(kept, at, "timed out")
        if 0 < self.max_bytes < kept[0]:
            return self._end(kept, at, "log size")
        if 0 < self.max_silence < at - kept[1]:
            return self._end(kept, at, "silence")
        if (n or 0) > 0:
            kept[1] = at
        return []

    def pass_time(self, kept, upto):
        if kept[3] is not None:
            if kept[3] <= upto:
                kept[:] = self.new
            return []
        at, reason = self._clock(kept)
        return self._end(kept, at, reason) if at is not None and at <= upto else []

    def _clock(self, kept):
        _, heard, deadline, _ = kept
        silent = heard + self.max_silence if heard is not None and self.max_silence > 0 else None
        if deadline is not None and (silent is None or deadline <= silent):
            return deadline, "timed out"
        return silent, "silence"

    def next_moment(self, kept):
        return kept[3] if kept[3] is not None else self._clock(kept)[0]


class Admissions(InOrder):
    """STR-7. A row is an interval (rank 0, ``closes``) or a submission (rank 1, ``job``). Kept: until when
    a worker is there, and in a list the submissions that wait."""

    columns, stored = ("at", "rank", "job", "closes"), "at bigint, rank bigint, job bigint, closes bigint"
    kept, new = "reach bigint", (None, [])
    out = ("system", "way", "job_id", "decision", "served_at")

    def __init__(self, grace: int):
        self.grace = grace * 1_000_000

    def init(self, handle):
        super().init(handle)
        self.jobs = handle.getListState("jobs", "at bigint, job bigint")

    def _load(self):
        reach, timer = self.value.get() or (None, None)
        return [reach, list(self.jobs.get())], timer

    def _save(self, kept, timer):
        if kept[1]:
            self.jobs.put(kept[1])
        else:
            self.jobs.clear()
        super()._save(kept[:1], timer)

    def take(self, kept, row):
        at, rank, job, closes = row
        if rank:
            if kept[0] is not None and kept[0] > at:
                return [(job, "now", at)]
            kept[1].append((at, job))
            return []
        if closes <= at:
            return []
        served = [(j, "waits" if at > t else "now", at) for t, j in kept[1]]
        kept[:] = [closes if kept[0] is None else max(kept[0], closes), []]
        return served

    def pass_time(self, kept, upto):
        declined = [(j, "declined", None) for t, j in kept[1] if t + self.grace <= upto]
        kept[1] = [(t, j) for t, j in kept[1] if t + self.grace > upto]
        if kept[0] is not None and kept[0] <= upto:
            kept[0] = None
        return declined

    def next_moment(self, kept):
        # when the interval has closed there is something to let go
        moments = [t + self.grace for t, _ in kept[1]] + ([] if kept[0] is None else [kept[0]])
        return min(moments, default=None)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _timed(rows: DataFrame, late: str, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    held = rows.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return held.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _times(*names: str) -> dict[str, Column]:
    return {n: F.timestamp_micros(n) for n in names}


def abandoned(subs: DataFrame, grace: int = 10, late: str = "10 seconds", remember: int = 86_400) -> DataFrame:
    """STR-3: ``subs(build_id, ts, seq, change)`` to (build_id, left_at, abandoned_at), when the
    watermark reaches the end of the grace. A build is announced once; events that reach it
    within ``remember`` seconds afterwards change nothing."""
    rows = subs.select("build_id", _micros("ts").alias("at"), F.col("seq").cast("bigint").alias("rank"), F.col("change").cast("bigint").alias("change"))
    got = _timed(rows, late, ["build_id"], Abandoned(grace, remember), f"build_id {rows.schema['build_id'].dataType.simpleString()}, left_at bigint, abandoned_at bigint")
    return got.withColumns(_times("left_at", "abandoned_at"))


def abort_reasons(ticks: DataFrame, max_bytes: int, max_silence: int, late: str = "10 seconds", remember: int = 86_400) -> DataFrame:
    """STR-2: ``ticks(build_id, ts, seq, bytes, cancelled, deadline)`` to the first reason to abort
    each build. Deadline and silence end a build without a further tick; its state goes ``remember``
    seconds later, and ticks that reach it until then change nothing."""
    rows = ticks.select(
        "build_id", _micros("ts").alias("at"), F.col("seq").cast("bigint").alias("rank"), F.col("bytes").cast("bigint").alias("bytes"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"), _micros("deadline").alias("deadline")
    )
    got = _timed(rows, late, ["build_id"], Aborts(max_bytes, max_silence, remember), f"build_id {rows.schema['build_id'].dataType.simpleString()}, at bigint, reason string")
    return got.select("build_id", F.timestamp_micros("at").alias("ts"), "reason")


def admissions(submits: DataFrame, intervals: DataFrame, grace: int, late: str = "10 seconds", ways: int = WAYS, moments: DataFrame | None = None) -> DataFrame:
    """STR-7: ``submits(job_id, system, ts)`` and ``intervals(system, opens, closes)`` to (job_id,
    decision, served_at): at once where a worker is there, when one comes within ``grace``
    seconds, or declined when that time is over. A system's submissions are dealt out in
    ``ways``, so that one with most of them is no single state. ``moments(ts)`` only move the clock."""
    asked = submits.select(
        "system", F.pmod(F.xxhash64("job_id"), F.lit(ways)).alias("way"), _micros("ts").alias("at"), F.lit(1).cast("bigint").alias("rank"), F.col("job_id").cast("bigint").alias("job"), F.lit(None).cast("bigint").alias("closes")
    )
    there = intervals.select(
        "system", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint"))).alias("way"), _micros("opens").alias("at"), F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("job"), _micros("closes").alias("closes")
    )
    schema = f"system {submits.schema['system'].dataType.simpleString()}, way bigint, job_id bigint, decision string, served_at bigint"
    rows = asked.unionByName(there)
    if moments is not None:
        # an interval of no system that closes as it opens
        none = {c: F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes}
        rows = rows.unionByName(moments.select(none["system"], F.lit(0).cast("bigint").alias("way"), _micros("ts").alias("at"), F.lit(0).cast("bigint").alias("rank"), none["job"], _micros("ts").alias("closes")))
    got = _timed(rows, late, ["system", "way"], Admissions(grace), schema)
    return got.select("job_id", "decision", F.timestamp_micros("served_at").alias("served_at"))


def settled(df: Callable[..., DataFrame], spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """What a stream, made in the session it is given, has announced of all that its sources have now.
    With ``end``, a time behind every deadline (before 2262, for pandas), nothing more is to come: ``df`` also gets a stream
    of moments, which has that one when the sources have been read, so that the rest is announced too."""
    own = with_timers(spark)
    if end is not None:
        ends = f"{path}/moments"
        spark.createDataFrame([], MOMENTS).write.parquet(ends)
        made = df(own, own.readStream.schema(MOMENTS).parquet(ends))
    else:
        made = df(own)
    run = made.writeStream.format("parquet").option("path", f"{path}/result").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    run.start().awaitTermination()
    if end is not None:
        spark.range(1).select(F.lit(end).cast("timestamp").alias("ts")).write.mode("append").parquet(ends)
        run.start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/result")
