"""Tables that a stream upserts, as versions of hash buckets.

A micro-batch writes only the buckets of the keys that it touches, below ``version=n``, and never
in place: what a reader has listed stays as it is, and a batch that runs again replaces its own
version alone. A bucket's rows are those of its newest finished version; the one before is kept for
readers that are under way, older ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

#: Buckets of a table. A batch with more keys than these touches most of them, and then writes most of the table.
BUCKETS = 64
#: Versions of a bucket that stay.
STAY = 2


def bucket_of(key: str) -> Column:
    """The bucket of a key, the same whatever its type; null is a key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def touched_buckets(df: DataFrame, key: str) -> list[int]:
    """At most BUCKETS numbers."""
    return sorted(r["bucket"] for r in df.select(bucket_of(key).alias("bucket")).distinct().collect())


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbered(fs, folder, prefix: str) -> list[int]:
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix)]


def versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[int]]:
    """Finished versions of each bucket, the newest first; with ``before`` only earlier ones."""
    folder, fs = _folder(spark, table)
    found: dict[int, list[int]] = {}
    for n in sorted(_numbered(fs, folder, "version="), reverse=True):
        one, _ = _folder(spark, f"{table}/version={n}")
        if (before is None or n < before) and fs.exists(_folder(spark, f"{table}/version={n}/_SUCCESS")[0]):
            for b in _numbered(fs, one, "bucket="):
                found.setdefault(b, []).append(n)
    return found


def upserted(spark: SparkSession, table: str, schema: StructType, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of a table, or of some of its buckets, as they are now or were ``before`` a version."""
    found = versions(spark, table, before)
    paths = [f"{table}/version={v[0]}/bucket={b}" for b, v in found.items() if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema, *_LIVE])).parquet(*paths).where("live").select(schema.names)


_LIVE = StructType().add("live", BooleanType())


def put(new: DataFrame, key: str, buckets: list[int], table: str, n: int) -> None:
    """``new``, all rows that ``buckets`` have from now on, as version ``n``. A bucket that has none
    left gets a row that stands for no row, so that its earlier version does not come back."""
    spark = new.sparkSession
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema]
    marks = spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*nulls, F.lit(False).alias("live"), "bucket")
    rows = new.withColumns({"live": F.lit(True), "bucket": bucket_of(key)}).unionByName(marks)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={n}")
    for b, old in versions(spark, table).items():
        for v in old[STAY:]:
            folder, fs = _folder(spark, f"{table}/version={v}/bucket={b}")
            fs.delete(folder, True)


def _of_keys(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of ``df`` whose key is (``left_anti``: is not) in ``keys(touched)``; null is a key."""
    return df.join(keys, F.col(key).eqNullSafe(F.col("touched")), how)


def by_batch(stream: DataFrame, rule, table: str, events: str):
    """STR-6 needs no timer: each micro-batch is added to the buckets of a table of ``events``, the
    batch rule runs over all events of the keys that the batch touches, and their rows take the
    place of the rows that those keys have in ``table`` (``upserted`` reads it). The first column of
    the stream is the key, in the rule's result too."""

    def step(batch: DataFrame, n: int) -> None:
        spark, key = batch.sparkSession, batch.columns[0]
        batch.withColumn("bucket", bucket_of(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{events}/micro_batch={n}")
        # read again: a batch is computed anew for each use
        now = spark.read.schema(batch.schema).parquet(f"{events}/micro_batch={n}")
        touched = touched_buckets(now, key)
        if not touched:
            return
        parts = StructType([*batch.schema, *StructType().add("micro_batch", IntegerType()).add("bucket", IntegerType())])
        kept = spark.read.schema(parts).parquet(events).where((F.col("micro_batch") <= n) & F.col("bucket").isin(*touched)).select(batch.columns)
        keys = now.select(F.col(key).alias("touched")).distinct()
        new = rule(_of_keys(kept, keys, key, "left_semi"))
        before = upserted(spark, table, new.schema, touched, n)
        put(new.unionByName(_of_keys(before, keys, key, "left_anti")), key, touched, table, n)

    return stream.writeStream.foreachBatch(step)


def latest_state_stream(stream: DataFrame, table: str):
    """STR-10: newest state per key; ``upserted`` reads the table. A cancel flag counts once and
    never for a build that has finished, since finished states come first in SNK-4."""
    from buildlens.sources.sinks import latest_states

    def step(batch: DataFrame, n: int) -> None:
        best = latest_states(batch).persist()
        try:
            if touched := touched_buckets(best, "dedupe_key"):
                before = upserted(batch.sparkSession, table, batch.schema, touched, n)
                put(latest_states(best.unionByName(before)), "dedupe_key", touched, table, n)
        finally:
            best.unpersist()

    return stream.writeStream.foreachBatch(step)
