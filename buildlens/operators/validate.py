"""Checks of requests, assignments, exit codes, sizes and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.scalars import STORE_DIR, is_plain_absolute, is_store_path, short_name

#: Bytes: archive of the temporary directory, one path's content, unpacked temporary directory.
CAPS = {"tmp_archive": 64 << 20, "nar": 64 << 30, "tmp_unpacked": 1 << 30}


def validate_requests(df: DataFrame) -> DataFrame:
    """SEL-1: ``reject_reason`` of the first rule that fails, null for a good request.

    Inputs are judged one by one in order, each first as a path and then as a duplicate of an
    earlier one; outputs likewise, in order of name, and then against the inputs.
    """
    outs = F.transform(F.array_sort(F.map_entries("outputs")), lambda e: e["value"])

    def first_fault(paths, also_input: bool):
        def fault(p, i):
            found = F.when(~is_store_path(p), "bad path").when(F.array_position(paths, p) < i + 1, "duplicate")
            return found.when(F.array_contains("input_paths", p), "also an input") if also_input else found

        return F.get(F.filter(F.transform(paths, fault), lambda x: x.isNotNull()), F.lit(0))

    inputs, outputs = first_fault(F.col("input_paths"), False), first_fault(outs, True)
    return df.withColumn(
        "reject_reason",
        F.when(F.coalesce(F.size("outputs"), F.lit(0)) <= 0, "no outputs")
        .when(~F.col("store_dir").eqNullSafe(STORE_DIR), "invalid store dir")
        .when(inputs.isNotNull(), F.concat(F.lit("input: "), inputs))
        .when(outputs.isNotNull(), F.concat(F.lit("output: "), outputs))
        .when(~F.coalesce(F.col("builder").startswith("/"), F.lit(False)), "builder not absolute")
        .when(
            ~F.coalesce(is_plain_absolute(F.col("tmp_dir_in_sandbox")), F.lit(False))
            | F.col("tmp_dir_in_sandbox").startswith(STORE_DIR),
            "invalid tmp dir",
        ),
    )


def validate_assignments(df: DataFrame) -> DataFrame:
    """SEL-2: ``reject_reason``, null for a good assignment."""
    return df.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col("build_id").rlike(r"\A[0-9a-fA-F]{32}\z"), F.lit(False)), "invalid build id")
        .when(~F.coalesce(F.col("builder").startswith("/"), F.lit(False)), "builder not absolute")
        .when(~F.coalesce(is_plain_absolute(F.col("tmp_dir_in_sandbox")), F.lit(False)), "invalid tmp dir")
        .when(~F.forall(F.map_values("outputs"), is_store_path), "invalid output path"),
    )


def check_exit_codes(df: DataFrame) -> DataFrame:
    """SEL-4: ``valid`` (0, or 1 to 255) and ``success`` (0 only)."""
    code = F.col("exit_code")
    return df.withColumn("valid", (code == 0) | code.between(1, 255)).withColumn("success", code == 0)


def screen_sizes(chunks: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """SEL-7: ``chunks(kind, id, bytes)`` summed by id, with ``rejected`` for sums over the cap
    of their kind; an unpacked temporary directory may not even reach it."""
    caps = caps or CAPS
    total = chunks.groupBy("kind", "id").agg(F.sum("bytes").alias("bytes"))
    over = F.lit(False)
    for kind, cap in caps.items():
        beyond = F.col("bytes") >= cap if kind == "tmp_unpacked" else F.col("bytes") > cap
        over = over | ((F.col("kind") == kind) & beyond)
    return total.withColumn("rejected", over)


def admit_peers(peers: DataFrame, allowed: list[str]) -> DataFrame:
    """SEL-8: peers with one of the allowed tags, all if none is listed, by their short name."""
    fit = peers if not allowed else peers.where(F.arrays_overlap("tags", F.array(*map(F.lit, allowed))))
    return fit.withColumn("name", short_name(F.col("node_name")))
