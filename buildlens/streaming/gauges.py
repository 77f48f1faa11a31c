"""STR-8: gauges that follow a stream, by retraction.

An entity (a job, a worker's session) stands for some rows of the gauges: a queued job for one of
``queue_depth``, a session for one of ``workers_connected`` and one or two per system. The first
query keeps what each entity stands for and sends out only changes: -1 for what it no longer stands
for, +1 for what is new. The second adds the changes up per gauge. Both need the RocksDB state
store (``timed.with_timers``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "struct<gauge:string,worker:string,system:string>"
CHANGE = "gauge string, worker string, system string, change bigint"
#: Rows of a task that are looked through at a time for the newest of each entity.
AT_ONCE = 1 << 17
STEP = Row("gauge", "worker", "system", "change")
#: How long after its event an entity that stands for nothing is remembered, so that earlier events change nothing.
REMEMBER_MS = 7 * 86_400_000


class Standing(StatefulProcessor):
    """The newest state of an entity by (at, rank). One that stands for something stays; one that
    stands for nothing has a timer, by which it goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at bigint, rank bigint, gauges array<string>, workers array<string>, systems array<string>, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.newest.get()
        newest = max(rows, key=lambda r: (r.at, r.rank))
        at, rank = newest.at, newest.rank
        if held is not None and (at, rank) <= (held[0], held[1]):
            return
        columns = [newest.gauges, newest.workers, newest.systems]
        now = set(zip(*columns, strict=True))
        was = set(zip(*held[2:5], strict=True)) if held is not None else set()
        if held is not None and held[5] is not None:
            self.handle.deleteTimer(held[5])
        timer = None
        if not now:
            timer = max(at // 1000 + REMEMBER_MS, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.newest.update((at, rank, *columns, timer))
        for r in was - now:
            yield STEP(*r, -1)
        for r in now - was:
            yield STEP(*r, 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def _row(gauge: str, worker: Column | None = None, system: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(gauge).alias("gauge"), (none if worker is None else worker).alias("worker"), (none if system is None else system).alias("system"))


def job_rows(lifecycle: DataFrame) -> DataFrame:
    """``lifecycle(job_id, ts, seq, kind)`` to what a job stands for after each event."""
    queued = F.col("kind").isin("submitted", "requeued")
    rows = F.when(queued, F.array(_row("queue_depth"))).otherwise(F.array().cast(f"array<{ROW}>"))
    return _entities(lifecycle, "job", F.col("job_id"), rows)


def session_rows(sessions: DataFrame) -> DataFrame:
    """``sessions(session, ts, seq, worker_name, systems)``; no systems (null) when a session has closed."""
    systems = F.array_distinct("systems")
    each = F.flatten(F.transform(systems, lambda s: F.array(_row("builder_up", F.col("worker_name"), s), _row("workers_for_system", None, s))))
    rows = F.when(F.col("systems").isNotNull(), F.concat(F.array(_row("workers_connected")), each)).otherwise(F.array().cast(f"array<{ROW}>"))
    return _entities(sessions, "session", F.col("session"), rows)


def _entities(df: DataFrame, kind: str, name: Column, rows: Column) -> DataFrame:
    stands = df.select(
        F.concat_ws(":", F.lit(kind), name.cast("string")).alias("entity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("seq").cast("bigint").alias("rank"),
        rows.alias("rows"),
    )
    return stands.select("entity", "at", "rank", *(F.col(f"rows.{c}").alias(f"{c}s") for c in ("gauge", "worker", "system")))


def _newest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows without those that another row of the same entity comes behind."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("entity", "at", "rank")])
    entity = rows["entity"].take(order)
    last = pa.chunked_array([*pc.not_equal(entity[:-1], entity[1:]).chunks, pa.array([True])])
    return rows.take(order.filter(last)).combine_chunks().to_batches()[0]


def _newest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(h.num_rows for h in held) >= AT_ONCE:
            held = [_newest(held)]
            if held[0].num_rows >= AT_ONCE // 2:
                yield held.pop()
    if held:
        yield _newest(held)


def changes(entities: DataFrame, late: str = "7 days") -> DataFrame:
    """What ``job_rows`` and ``session_rows`` (one, or their union) change in the gauges. Events later
    than ``late`` are left out."""
    # what is older than another row of its entity changes nothing, and is left out before rows are shuffled and
    # taken one by one; the newest are also those that are late last, so that the watermark does the same
    newest = entities.mapInArrow(_newest_of_task, entities.schema)
    held = newest.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return held.groupBy("entity").transformWithState(statefulProcessor=Standing(), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def added_up(changed: DataFrame) -> DataFrame:
    """Changes to gauges (metric, worker, system, value) without those that are 0. Workers of one name
    are up once, however many sessions they have."""
    sums = changed.groupBy("gauge", "worker", "system").agg(F.sum("change").alias("n")).where("n <> 0")
    value = F.when(F.col("gauge") == "builder_up", F.lit(1).cast("bigint")).otherwise(F.col("n"))
    return sums.select(F.col("gauge").alias("metric"), "worker", "system", value.alias("value"))


def live_gauges(make, spark: SparkSession, path: str) -> DataFrame:
    """The gauges after all that the sources now have. ``make(session)`` gives the entities as a
    stream; changes go to files below ``path``, from which the second query adds them up."""
    from buildlens.streaming.streams import drained
    from buildlens.streaming.timed import with_timers

    own = with_timers(spark)
    run = changes(make(own)).writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return drained(added_up(spark.readStream.schema(CHANGE).parquet(f"{path}/changes")))
