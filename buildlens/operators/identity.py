"""Keys of identical requests, and the groups they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.functions.scalars import sorted_entries, u64_le


def _fed(text: Column) -> Column:
    """A string behind its length in bytes."""
    return F.concat(u64_le(F.octet_length(text)), text.cast("binary"))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p))


def _list(items: Column) -> Column:
    return F.concat(u64_le(F.size(items)), _joined(F.transform(items, _fed)))


def _map(m: Column) -> Column:
    return F.concat(
        u64_le(F.size(m)), _joined(F.transform(sorted_entries(m), lambda e: F.concat(_fed(e["key"]), _fed(e["value"]))))
    )


def dedupe_key(df: DataFrame) -> DataFrame:
    """AGG-5: ``key``, the SHA-256 of the canonical request. Arguments keep their order;
    environment, outputs and inputs are sorted; every string and list carries its length."""
    return df.withColumn(
        "key",
        F.sha2(
            F.concat(
                _fed(F.col("system")),
                _fed(F.col("builder")),
                _list(F.col("args")),
                _map(F.col("env")),
                _map(F.col("outputs")),
                _list(F.array_sort("input_paths")),
                _fed(F.col("store_dir")),
                _fed(F.col("tmp_dir_in_sandbox")),
                F.when(F.col("fixed_output"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))),
            ),
            256,
        ),
    )


def dedupe_groups(df: DataFrame) -> DataFrame:
    """AGG-6: per key the leader (first submitted, then least id) and its number of followers."""
    return df.groupBy("key").agg(
        F.min(F.struct("submitted_at", "job_id"))["job_id"].alias("leader"), (F.count("*") - 1).alias("followers")
    )


def latest_assignment(df: DataFrame) -> DataFrame:
    """WIN-2: the newest assignment of each dedupe key; of equal times the greatest build id."""
    w = W.partitionBy("dedupe_key").orderBy(F.desc("assigned_at"), F.desc("build_id"))
    return df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def inflight_groups(builds: DataFrame) -> DataFrame:
    """WIN-7: ``builds(key, job_id, submitted_at, finished_at)`` with the island of in-flight
    builds each joins and whether it leads.

    A submission leads if every earlier build of its key has finished by then.
    """
    w = W.partitionBy("key").orderBy("submitted_at", "job_id")
    before = F.max("finished_at").over(w.rowsBetween(W.unboundedPreceding, -1))
    lead = before.isNull() | (before <= F.col("submitted_at"))
    return (
        builds.withColumn("leads", lead)
        .withColumn("island", F.sum(F.col("leads").cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .select("key", "job_id", "island", "leads")
    )


def first_occurrence(df: DataFrame) -> DataFrame:
    """WIN-8: ``df(id, items array)`` to one row per position: item, pos, and whether an
    earlier position has the item."""
    rows = df.select("id", F.posexplode("items").alias("pos", "item"))
    w = W.partitionBy("id", "item").orderBy("pos")
    return rows.withColumn("duplicate", F.row_number().over(w) > 1)
