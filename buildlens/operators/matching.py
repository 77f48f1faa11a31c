"""Which worker can serve which job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.operators.running import as_of

BASELINE_FEATURES: tuple[str, ...] = ()


def serves(need: str = "features", have: str = "have") -> Column:
    """JOIN-1's feature test: every needed feature is offered."""
    return F.size(F.array_except(need, have)) == 0


def capability_rows(workers: DataFrame) -> DataFrame:
    """``workers(worker, caps array<struct<system, features>>)`` to (worker, system, have)."""
    return workers.select("worker", F.explode("caps").alias("c")).select("worker", "c.system", F.col("c.features").alias("have"))


def distinct_needs(jobs: DataFrame) -> DataFrame:
    """The distinct (system, features) that jobs ask for, features sorted."""
    return jobs.select("system", F.array_sort(F.array_distinct("features")).alias("features")).distinct()


def match_workers(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """JOIN-1: ``jobs(job_id, system, features)`` with each worker of ``caps(worker, system,
    have)`` that offers the system and, under it, every feature.

    Jobs share few distinct needs, so needs are matched first and jobs join the matches.
    """
    needs = distinct_needs(jobs)
    fit = needs.join(caps, "system").where(serves()).select("system", "features", "worker").distinct()
    keyed = jobs.withColumn("need", F.array_sort(F.array_distinct("features")))
    return keyed.join(fit.withColumnRenamed("features", "need"), ["system", "need"]).select("job_id", "worker")


def unservable(jobs: DataFrame, caps: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """JOIN-2: jobs that no worker serves and that no requeue within the grace protects."""
    needs = distinct_needs(jobs)
    served = needs.join(caps, "system").where(serves()).select("system", F.col("features").alias("need")).distinct()
    protected = F.coalesce(
        F.col("requeued_at").cast("timestamp") + F.make_interval(secs=F.lit(grace_seconds)) > now.cast("timestamp"), F.lit(False)
    )
    keyed = jobs.withColumn("need", F.array_sort(F.array_distinct("features")))
    return keyed.where(~protected).join(served, ["system", "need"], "left_anti").select(jobs.columns)


def count_matches(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """JOIN-1 counted: per job the number of workers that serve it and the least of them,
    without listing the pairs."""
    needs = distinct_needs(jobs)
    fit = needs.join(caps, "system").where(serves()).groupBy("system", F.col("features").alias("need")).agg(
        F.countDistinct("worker").alias("n_workers"), F.min("worker").alias("first_worker")
    )
    keyed = jobs.withColumn("need", F.array_sort(F.array_distinct("features")))
    return keyed.join(fit, ["system", "need"], "left").select("job_id", F.coalesce("n_workers", F.lit(0)).alias("n_workers"), "first_worker")


def first_eligible(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """SRT-1: per worker the first job in queue order (``position``) that it serves. The first
    job of each distinct need is enough to decide."""
    heads = (
        jobs.withColumn("features", F.array_sort(F.array_distinct("features")))
        .groupBy("system", "features")
        .agg(F.min(F.struct("position", "job_id")).alias("head"))
    )
    return (
        heads.join(caps, "system").where(serves()).groupBy("worker").agg(F.min("head").alias("j")).select("worker", "j.job_id", "j.position")
    )


def dropped_jobs(jobs: DataFrame, listeners: DataFrame) -> DataFrame:
    """SRT-1: jobs that nobody listens to."""
    return jobs.join(listeners.select("job_id"), "job_id", "left_anti")


def check_signers(regs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """JOIN-6: ``trusted`` for each registration; without a list all are."""
    if keys is None:
        return regs.withColumn("trusted", F.lit(True))
    known = keys.select(F.col("key").alias("signing_public_key"), F.lit(True).alias("trusted")).distinct()
    return regs.join(known, "signing_public_key", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def expected_deadline(jobs: DataFrame, departures: DataFrame, started_at: Column, grace_seconds: int) -> DataFrame:
    """JOIN-10: ``jobs(job_id, submitted_at, system, features)`` with ``deadline``.

    Within the grace after the start it is the end of that grace; later the latest departure
    and grace among workers that served the job, departed before and are within their grace;
    else null. ``departures(system, have, departed_at)``.
    """
    grace = F.make_interval(secs=F.lit(grace_seconds))
    startup = started_at + grace
    plain = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    asked = jobs.withColumn("_need", plain("features"))
    gone = departures.select("system", plain("have").alias("have"), "departed_at")
    # kinds of needs and of workers are few; departures are told to the needs that they could have served
    served = asked.select("system", "_need").distinct().join(gone.select("system", "have").distinct(), "system").where(serves("_need"))
    told = gone.join(served, ["system", "have"]).select("system", "_need", "departed_at")
    held = as_of(asked, told, ["system", "_need"], "submitted_at", "departed_at", "departed_at")
    back = F.when(F.col("submitted_at") < F.col("best") + grace, F.col("best") + grace)
    return held.select("job_id", F.when(F.col("submitted_at") < startup, startup).otherwise(back).alias("deadline"))


def resume_matches(jobs: DataFrame, registrations: DataFrame) -> DataFrame:
    """JOIN-12: queued jobs that go to the session announcing their key; capabilities play no
    part. Each announced key is honoured once per session: by its first job in the queue."""
    announced = registrations.select("session", F.explode("resumable_keys").alias("key")).distinct()
    w = W.partitionBy("session", "key").orderBy("position", "job_id")
    return (
        jobs.join(announced, "key").withColumn("n", F.row_number().over(w)).where("n = 1").select("session", "key", "job_id")
    )


def effective_caps(workers: DataFrame, emulated: DataFrame, baseline: tuple[str, ...] = BASELINE_FEATURES) -> DataFrame:
    """JOIN-14: native systems with the worker's features, emulated ones with the baseline."""
    native = workers.select("worker", F.explode("systems").alias("system"), "features")
    extra = emulated.join(native.select("worker", "system"), ["worker", "system"], "left_anti").select(
        "worker", "system", F.array(*map(F.lit, baseline)).cast("array<string>").alias("features")
    )
    return native.unionByName(extra.distinct())
