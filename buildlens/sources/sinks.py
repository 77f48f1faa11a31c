"""Sinks: snapshots, path lists and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_if_changed(df: DataFrame, path: str) -> bool:
    """SNK-2: write a JSON snapshot unless ``path`` holds the same rows; whether it was written."""
    spark = df.sparkSession
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        old = spark.read.text(path)
        if old.exceptAll(rows).isEmpty() and rows.exceptAll(old).isEmpty():
            return False
    rows.write.mode("overwrite").text(path)
    return True


def added_paths(events: DataFrame) -> DataFrame:
    """SNK-3: ``events(build_id, kind, path, code)``: per build with exit code 0 the added
    paths, distinct and sorted; builds without any are left out."""
    paths = F.array_sort(F.collect_set(F.when(F.col("kind") == "added_path", F.col("path"))))
    code = F.max(F.when(F.col("kind") == "exit_code", F.col("code")))
    return events.groupBy("build_id").agg(paths.alias("paths"), code.alias("code")).where((F.col("code") == 0) & (F.size("paths") > 0)).select("build_id", "paths")


def latest_states(df: DataFrame) -> DataFrame:
    """SNK-4: one state per dedupe key: finished before running, then the newest (``updated_at``)."""
    w = W.partitionBy("dedupe_key").orderBy(F.desc(F.col("phase") == "finished"), F.desc("updated_at"), F.desc("build_id"))
    return df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
