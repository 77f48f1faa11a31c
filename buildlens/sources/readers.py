"""Sources: records as files or raw tables, to typed tables and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.scalars import empty_to_null, is_fixed_output, is_store_path
from buildlens.sources.schemas import (
    BUILD_STATE,
    LIVENESS_ONLY,
    LOG_CHUNK,
    REFS,
    REQUEST_DOCUMENT,
    VALID_PATHS,
    WORKER_PAYLOADS,
)

BAD = "_corrupt_record"


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1: request documents, one JSON object per line, to good requests and rejects with a
    ``reason``. Unknown keys are ignored, every declared key is required, and only version 1 is read."""
    raw = (
        spark.read.schema(f"{REQUEST_DOCUMENT}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    )
    names = [c for c in raw.columns if c != BAD]
    reason = F.when(F.col(BAD).isNotNull(), "not a request document")
    for c in names:
        reason = reason.when(F.col(c).isNull(), f"missing {c}")
    reason = reason.when(F.col("version") != 1, "unsupported version")
    judged = raw.withColumn("reason", reason)
    ok = judged.where("reason is null").select(
        "system",
        "builder",
        "args",
        "env",
        "outputs",
        F.col("inputPaths").alias("input_paths"),
        F.col("tmpDirInSandbox").alias("tmp_dir_in_sandbox"),
        F.col("storeDir").alias("store_dir"),
        is_fixed_output(F.col("env")).alias("fixed_output"),
    )
    return ok, judged.where("reason is not null")


def read_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC-2: ``valid_paths`` and ``refs`` of one snapshot folder."""
    return (
        spark.read.schema(VALID_PATHS).parquet(f"{folder}/valid_paths"),
        spark.read.schema(REFS).parquet(f"{folder}/refs"),
    )


def normalize_path_infos(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-3: empty strings to null, references and signatures as sorted sets, and rejects that
    name the first bad ``field``."""
    deriver = empty_to_null(F.col("deriver"))
    field = (
        F.when(~is_store_path(F.col("store_path")), "path")
        .when(deriver.isNotNull() & ~is_store_path(deriver), "deriver")
        .when(~F.coalesce(F.octet_length("nar_sha256") == 32, F.lit(False)), "nar hash")
        .when(~F.forall("references", is_store_path), "references")
    )
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    judged = df.withColumn("field", field)
    good = (
        judged.where("field is null")
        .withColumns({"deriver": deriver, "ca": empty_to_null(F.col("ca")), "references": as_set("references"), "signatures": as_set("signatures")})
        .drop("field")
    )
    return good, judged.where("field is not null")


def key_list(lines: DataFrame) -> DataFrame:
    """SRC-4: trimmed lines, without blank ones and comments."""
    key = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    return lines.select(key.alias("key")).where((F.col("key") != "") & ~F.col("key").startswith("#"))


def read_trusted_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC-4: None without a file (no restriction); an empty table rejects all."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return key_list(spark.read.text(path))


def demux(df: DataFrame) -> dict[str, DataFrame]:
    """SRC-6: tagged messages to a table per kind, and ``liveness`` of every message; kinds
    without a build id count there only."""
    tables = {
        k: df.where(F.col("kind") == k).select("worker", "ts", "seq", f"{k}.*") for k in WORKER_PAYLOADS if k not in LIVENESS_ONLY
    }
    return tables | {"liveness": df.select("worker", "ts")}


def tail_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """SRC-7: a stream of log chunks from files as they arrive. The checkpoint of the query
    that reads it holds the accepted offset: a batch that fails does not advance it, and a
    restarted query goes on after the last one that didn't. A build without a log yields nothing.
    Logs that grow within one file are ``logtail.tail_growing_logs``."""
    return spark.readStream.schema(LOG_CHUNK).option("maxFilesPerTrigger", max_files).parquet(path)


def read_build_states(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-8: ``df(value JSON)`` to build states and rejects. Extras and their references
    default to empty lists; a finished state needs an exit code, a running one a deadline."""
    parsed = df.select("value", F.from_json("value", BUILD_STATE, {"mode": "PERMISSIVE"}).alias("s"))
    whole = (
        F.col("s.dedupe_key").isNotNull()
        & F.col("s.build_id").isNotNull()
        & F.coalesce(
            ((F.col("s.phase") == "running") & F.col("s.deadline_unix").isNotNull())
            | ((F.col("s.phase") == "finished") & F.col("s.exit_code").isNotNull()),
            F.lit(False),
        )
    )
    good = parsed.where(whole).select("s.*")
    none = F.array().cast("array<string>")
    extras = F.transform(
        F.coalesce("extras", F.array().cast("array<struct<store_path:string,references:array<string>>>")),
        lambda e: F.struct(e["store_path"].alias("store_path"), F.coalesce(e["references"], none).alias("references")),
    )
    return good.withColumn("extras", extras), parsed.where(~F.coalesce(whole, F.lit(False))).select("value")


def oom_flags(df: DataFrame) -> DataFrame:
    """SRC-9: ``df(build_id, events)`` with ``oom``: a line ``oom_kill N`` with N other than 0."""
    lines = F.split("events", "\n")
    return df.select(
        "build_id",
        F.coalesce(
            F.exists(lines, lambda x: x.startswith("oom_kill ") & (F.trim(F.substring(x, F.lit(10), F.length(x))) != "0")), F.lit(False)
        ).alias("oom"),
    )
