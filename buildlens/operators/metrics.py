"""Fleet metrics: who is up, what it can do, and how it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.scalars import label_value


def builder_up(regs: DataFrame) -> DataFrame:
    """AGG-2: ``regs(session, worker_name, systems)`` to one row per worker and system."""
    return order_export(regs.select("worker_name", F.explode("systems").alias("system")).distinct())


def order_export(df: DataFrame) -> DataFrame:
    """SRT-2."""
    return df.orderBy("worker_name", "system")


def workers_connected(regs: DataFrame) -> DataFrame:
    """AGG-3: open sessions."""
    return regs.agg(F.countDistinct("session").alias("connected"))


def workers_per_system(regs: DataFrame) -> DataFrame:
    """AGG-3: sessions that offer each system."""
    return regs.select("session", F.explode("systems").alias("system")).groupBy("system").agg(F.countDistinct("session").alias("workers"))


def all_systems(regs: DataFrame) -> DataFrame:
    """SET-1."""
    return regs.select(F.explode("systems").alias("system")).distinct()


def fleet_capacity(regs: DataFrame, percent: int = 200, cap: int = 256) -> DataFrame:
    """AGG-4: sorted systems, and the job slots to announce: a percentage of the sum of
    ``max_jobs``, at least 1 and at most ``cap``, null without any slot."""
    slots = regs.agg(F.coalesce(F.sum("max_jobs"), F.lit(0)).alias("slots"))
    systems = all_systems(regs).agg(F.array_sort(F.collect_set("system")).alias("systems"))
    scaled = F.floor(F.col("slots") * percent / 100)
    return slots.crossJoin(systems).select(
        "systems", F.when(F.col("slots") > 0, F.greatest(F.lit(1), F.least(F.lit(cap), scaled))).cast("bigint").alias("max_jobs")
    )


def metrics_table(counters: DataFrame, depth: DataFrame, regs: DataFrame) -> DataFrame:
    """SNK-1: metric, labels (worker, system; null where there is none), value."""
    none = F.lit(None).cast("string")
    row = lambda df, name, worker, system, value: df.select(
        name.alias("metric"), worker.alias("worker"), system.alias("system"), value.cast("bigint").alias("value")
    )
    return (
        row(counters, F.concat(F.lit("builds_"), F.col("counter"), F.lit("_total")), none, none, F.col("n"))
        .unionByName(row(depth, F.lit("queue_depth"), none, none, F.col("depth")))
        .unionByName(row(workers_connected(regs), F.lit("workers_connected"), none, none, F.col("connected")))
        .unionByName(row(builder_up(regs), F.lit("builder_up"), F.col("worker_name"), F.col("system"), F.lit(1)))
        .unionByName(row(workers_per_system(regs), F.lit("workers_for_system"), none, F.col("system"), F.col("workers")))
    )


#: Help texts of the exposition.
HELP = {
    "builds_submitted_total": "Builds accepted.",
    "builds_dispatched_total": "Builds given to a worker.",
    "builds_declined_total": "Builds that no worker could take in time.",
    "builds_requeued_total": "Builds queued again after a lost session.",
    "builds_failed_total": "Builds that failed.",
    "builds_succeeded_total": "Builds that succeeded.",
    "queue_depth": "Builds in the queue.",
    "workers_connected": "Open worker sessions.",
    "builder_up": "Connected builder by name and system.",
    "workers_for_system": "Connected workers by system.",
}


def metrics_text(table: DataFrame, prefix: str = "fleet_") -> DataFrame:
    """SNK-1: the lines of the text exposition in order: (position, line)."""
    names = list(HELP)
    head = [(i, k, p, f"# {word} {prefix}{k} {text}") for i, k in enumerate(names) for p, word, text in ((0, "HELP", HELP[k]), (1, "TYPE", "counter" if k.endswith("_total") else "gauge"))]
    heads = table.sparkSession.createDataFrame(head, "at int, metric string, part int, line string")
    pairs = F.concat_ws(
        ",",
        F.when(F.col("worker").isNotNull(), F.concat(F.lit('worker="'), label_value(F.col("worker")), F.lit('"'))),
        F.when(F.col("system").isNotNull(), F.concat(F.lit('system="'), label_value(F.col("system")), F.lit('"'))),
    )
    at = F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int") - 1
    lines = table.select(
        at.alias("at"),
        "metric",
        F.lit(2).alias("part"),
        F.concat(F.lit(prefix), F.col("metric"), F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"),
    )
    return heads.unionByName(lines).orderBy("at", "part", "line").select("at", "part", "line")
