"""The timeout rules as Structured Streaming queries.

Every stateful query has a watermark, twice the rule's own timeout unless given. Rows later
than that are left to the batch twins. ``events.ts`` must be a timestamp with zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.operators.events import COUNTERS
from buildlens.sources.shared import fresh_path


def drained(df: DataFrame) -> DataFrame:
    """The complete result of a streaming aggregation over all that its source has now. Every
    batch replaces the result in the cluster's shared folder; the last one is returned."""
    spark = df.sparkSession
    path = fresh_path(spark, "stream")

    def step(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = (
        df.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/result")


def _late(seconds: int, given: str | None) -> str:
    return given or f"{2 * seconds} seconds"


def silent_workers(messages: DataFrame, gap: int = 180, late: str | None = None) -> DataFrame:
    """STR-1: sessions that have ended by silence. ``session_window`` joins events exactly one
    gap apart, as the rule does."""
    held = messages.withWatermark("ts", _late(gap, late))
    return (
        held.groupBy(F.session_window("ts", f"{gap} seconds"), "worker")
        .agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("messages"))
        .select("worker", "started", "last_seen", "messages")
    )


def expired_results(finished: DataFrame, acks: DataFrame, ttl: int = 300, late: str | None = None) -> DataFrame:
    """STR-4: a left outer interval join; results come out once no acknowledgement can arrive in time."""
    f = finished.withWatermark("finished_at", _late(ttl, late))
    a = acks.withColumnRenamed("result_id", "ack_id").withWatermark("acked_at", _late(ttl, late))
    joined = f.join(
        a,
        F.expr(f"result_id = ack_id AND acked_at >= finished_at AND acked_at <= finished_at + interval {ttl} seconds"),
        "left_outer",
    )
    return joined.where("ack_id is null").select("result_id", "finished_at")


def dedupe_results(results: DataFrame, late: str = "1 day") -> DataFrame:
    """STR-5: one delivery per key."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def live_counters(events: DataFrame) -> DataFrame:
    """STR-8: counters in update mode."""
    counted = events.where(F.col("kind").isin(*COUNTERS) & ~((F.col("kind") == "submitted") & F.col("duplicate")))
    return counted.groupBy(F.col("kind").alias("counter")).agg(F.count("*").alias("n"))


def live_log_bytes(messages: DataFrame) -> DataFrame:
    """STR-9: size and time span of each build's log in update mode."""
    return messages.groupBy("build_id").agg(F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
