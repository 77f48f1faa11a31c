"""Running sums and as-of joins in two levels, for keys with any number of rows.

Rows are windowed within (key, bucket), a bucket being a range of positions or of time; what the buckets
before (or after) have to add comes from a window over one row per bucket. So a key with half of the
rows is worked on in as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions, and seconds, of a bucket.
POSITIONS, SECONDS = 1 << 16, 3600


def running_sums(rows: DataFrame, key: str, position: str, sums: dict[str, Column], lows: tuple[str, ...] = (), size: int = POSITIONS) -> DataFrame:
    """``rows`` with the running ``sums`` of each ``key`` in the order of ``position``, an integer,
    and for those named in ``lows`` as ``<name>_low`` the least value so far. Null is a key."""
    bucketed = rows.withColumns({f"_{n}": c for n, c in sums.items()} | {"_bucket": F.floor(F.col(position) / size)})
    inside = W.partitionBy(key, "_bucket").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    local = bucketed.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums})
    local = local.withColumns({f"{n}_low": F.min(n).over(inside) for n in lows})
    per = local.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(
        *(F.sum(f"_{n}").alias(f"_{n}_all") for n in sums), *(F.min(n).alias(f"_{n}_least") for n in lows)
    )
    before = W.partitionBy("_key").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    carried = per.withColumns({f"_{n}_before": F.coalesce(F.sum(f"_{n}_all").over(before), F.lit(0)) for n in sums})
    carried = carried.withColumns({f"_{n}_low_before": F.min(F.col(f"_{n}_least") + F.col(f"_{n}_before")).over(before) for n in lows})
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    out = {n: F.col(n) + F.col(f"_{n}_before") for n in sums} | {f"{n}_low": F.least(F.col(f"{n}_low") + F.col(f"_{n}_before"), f"_{n}_low_before") for n in lows}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def as_of(rows: DataFrame, facts: DataFrame, on: list[str], at: str, fact_at: str, reach: str, seconds: int = SECONDS) -> DataFrame:
    """``rows`` with two columns of the ``facts`` that have the same ``on``: ``best``, the greatest
    ``reach`` of those with ``fact_at`` up to ``at``, and ``next``, the least ``fact_at`` from ``at`` on.
    Nothing is paired: both sides are united and sorted by time within (on, bucket of time). A null in ``on`` meets nothing."""
    kinds = {c: facts.schema[c].dataType for c in (fact_at, reach)}
    both = rows.select(*on, F.col(at).alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kinds[fact_at]).alias("_start"), F.lit(None).cast(kinds[reach]).alias("_reach"))
    known = facts.dropna(subset=[*on, fact_at]).select(*on, F.col(fact_at).alias("_at"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(fact_at).alias("_start"), F.col(reach).alias("_reach"))
    both = both.unionByName(known).withColumn("_bucket", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (seconds * 1_000_000)))
    inside = W.partitionBy(*on, "_bucket").orderBy("_at")
    upto, onward = inside.rangeBetween(W.unboundedPreceding, 0), inside.rangeBetween(0, W.unboundedFollowing)
    local = both.withColumns({"_best": F.max("_reach").over(upto), "_next": F.min("_start").over(onward)}).where("_row is not null")
    per = both.groupBy(*on, "_bucket").agg(F.max("_reach").alias("_most"), F.min("_start").alias("_least"))
    by_bucket = W.partitionBy(*on).orderBy("_bucket")
    carried = per.select(
        *on, "_bucket", F.max("_most").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.min("_least").over(by_bucket.rowsBetween(1, W.unboundedFollowing)).alias("_after")
    )
    joined = local.join(carried, [*on, "_bucket"], "left")
    return joined.select("_row.*", F.greatest("_best", "_before").alias("best"), F.coalesce("_next", "_after").alias("next"))
