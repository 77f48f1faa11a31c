"""Mixing sources to target weights by histograms of a hash.

A document's place in its source is a hash of its id and text, so that the documents below a
threshold are a random part of the source, and parts for smaller budgets lie within those for
larger ones. Sizes are summed by source and leading digits of the hash; the bucket in which
the budget ends is found by a running sum over the few buckets of a source, and only its rows
go on to the next digits, until one hash is left. The mix is then a filter on the hash:
documents are never sorted. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.llm.shared import join_facts, whole, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has so many hundredths of the words of all documents, and a source so many times its own words at most.
PERCENT, MOST_TIMES = 150, 2
#: Digits of the hash, to the base of 16, and how many of them a histogram takes in.
DIGITS, STEP = 12, 3
#: Sources up to this number are broadcast, a row of a name and five numbers each.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, null text as 0: each word shrinks to a letter,
    then white space goes."""
    letters = F.regexp_replace(whole(text), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(letters, " \t\n\x0b\f\r", "")).cast("bigint")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _sources(sized: DataFrame) -> DataFrame:
    """(key, source, source_size, weight) with weights by the order of sources. Ranges of sources
    are numbered apart and put one behind the other, so that no task holds them all."""
    by = [F.col("source").isNull(), F.col("source")]
    own = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    parts = written(own.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1 + F.col("before")
    weights = F.array(*map(F.lit, WEIGHTS))
    return parts.join(before, "part").select("key", "source", "source_size", F.get(weights, (place % len(WEIGHTS)).cast("int")).alias("weight"))


def source_targets(sized: DataFrame) -> DataFrame:
    """(key, source, source_size, target, up, down): ``target`` = ``up / down``, exact integers.

    Every source gets as many words per weight as the others, but for those whose cap is below
    that: they get their cap. A source with cap / weight = r is capped if all sources of a ratio
    up to r can have their cap and the others r per weight; so sums over the distinct ratios tell
    where the caps end. In units of half words, as the whole mix is a multiple of those.
    """
    unit = 100 // _gcd(PERCENT, 100)
    parts = _sources(sized).withColumn("cap", _wide(F.col("source_size") * MOST_TIMES * unit)).withColumn("ratio", F.col("cap") * F.lit(_all_weights()) / F.col("weight"))
    parts = written(parts.withColumn("ratio", _wide(F.col("ratio"))), "mix-weights")
    total = parts.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("decimal(38,0)").alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights"))
    # running sums over the ratios, in ranges of them as above
    ratios = parts.groupBy("ratio").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    ranged = written(ratios.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "mix-ratios")
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("caps").alias("c"), F.sum("weights").alias("w"))
    sums = sums.select("part", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"))
    inside = W.partitionBy("part").orderBy("ratio")
    run = ranged.join(sums, "part").select("ratio", _wide(F.sum("caps").over(inside) + F.col("c0")).alias("c"), _wide(F.sum("weights").over(inside) + F.col("w0")).alias("w"))
    budget = total.select(_wide(F.col("words") * PERCENT * unit / 100).alias("budget"), _wide(F.col("weights")).alias("all"))
    all_words, all_weights = budget.select("budget").scalar(), budget.select("all").scalar()
    fits = run.withColumn("budget", all_words).withColumn("all", all_weights).where(
        F.col("c") * _all_weights() + F.col("ratio") * (F.col("all") - F.col("w")) <= F.col("budget") * _all_weights()
    )
    end = written(fits.agg(F.max("ratio").alias("ratio"), F.coalesce(F.max("c"), _wide(F.lit(0))).alias("c"), F.coalesce(F.max("w"), _wide(F.lit(0))).alias("w")), "mix-level")
    level = {c: end.select(c).scalar() for c in end.columns}
    capped = F.coalesce(F.col("ratio") <= F.col("last"), F.lit(False))
    out = parts.withColumns({"budget": all_words, "all": all_weights, "last": level["ratio"], "c": level["c"], "w": level["w"]})
    up = F.when(capped, F.col("cap")).otherwise(_wide((F.col("budget") - F.col("c")) * F.col("weight")))
    down = F.when(capped, _wide(F.lit(unit))).otherwise(_wide((F.col("all") - F.col("w")) * unit))
    out = out.withColumn("up", up).withColumn("down", down)
    return out.select("key", "source", "source_size", (F.col("up").cast("double") / F.col("down").cast("double")).alias("target"), "up", "down")


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def _all_weights() -> int:
    """A number that every weight divides."""
    out = 1
    for w in WEIGHTS:
        out *= w // _gcd(out, w)
    return out


def _of_source(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with their source's facts, which are broadcast up to a number of sources."""
    if facts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), on)
    return join_facts(rows, facts, on)


def _ends(hist: DataFrame, budgets: DataFrame) -> DataFrame:
    """The bucket of each source in which its budget ends: ``hist(key, bucket, words)`` and
    ``budgets(key, rest_up, down, before)``; ``before`` is then what lies in front of the bucket."""
    w = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = hist.join(budgets.drop("bucket"), "key").withColumn("upto", _wide(F.col("before") + F.sum("words").over(w)))
    over = run.where(F.col("upto") * F.col("down") > F.col("rest_up"))
    return over.groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"), F.first("rest_up").alias("rest_up"), F.first("down").alias("down")).select(
        "key", F.col("e.bucket").alias("bucket"), _wide(F.col("e.before")).alias("before"), "rest_up", "down"
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size bigint, source_size bigint, target double, taken bigint) for every row of ``docs``.

    ``taken`` is 0, 1 or 2 times ``size``: whole rounds over the source, then the documents below
    the hash threshold once more. Documents come in the order of their hash as long as they fit
    into the target; the one that crosses it is taken if that is nearer to the target than leaving
    it. So a source's words differ from its target by half of that document's at most.

    Null text has no words; null source is a source of its own and the last. Repeated rows count
    each; among equal hashes, such as those of equal rows, as many are taken as fit. A source
    without words has the target 0. An empty table gives no rows; other columns play no part.
    """
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), whole()).cast("binary"))
    sized = written(docs.select("doc_id", "source", key.alias("key"), word_count().alias("size"), F.substring(digest, 1, DIGITS).alias("hash")), "mix-sizes")
    targets = written(source_targets(sized), "mix-targets")
    # whole rounds, and the budget of the rest
    rounds = F.call_function("div", F.col("up"), F.col("down") * _wide(F.col("source_size")))
    targets = targets.withColumn("rounds", F.when(F.col("source_size") > 0, rounds).otherwise(F.lit(0)))
    targets = targets.withColumn("rest_up", _wide(F.col("up") - _wide(F.col("rounds") * F.col("source_size")) * F.col("down")))

    rows = sized.where("size > 0").select("key", "doc_id", "size", "hash")
    ends = targets.where("source_size > 0").select("key", "rest_up", _wide(F.col("down")).alias("down"), _wide(F.lit(0)).alias("before"))
    for upto in range(STEP, DIGITS + 1, STEP):
        bucket = F.substring("hash", 1, upto)
        hist = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        ends = written(_ends(hist, ends), "mix-ends")
        if upto < DIGITS:
            held = _of_source(rows.withColumn("bucket", bucket), ends.select("key", "bucket"), ["key", "bucket"])
            rows = written(held.select("key", "doc_id", "size", "hash"), "mix-boundary")

    # rows of the last bucket, that is of one hash, by kind and number
    cuts = targets.join(ends.select("key", F.col("bucket").alias("cut")), "key", "left").select("key", "source_size", "target", "rounds", "cut")
    cuts = written(cuts, "mix-cuts")
    placed = _of_source(sized.select("key", "doc_id", "size", "hash"), cuts, ["key"])
    at_cut = (F.col("size") > 0) & (F.col("hash") == F.col("cut"))
    again = F.when((F.col("size") > 0) & (F.col("hash") < F.col("cut")), F.col("size")).otherwise(F.lit(0))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    clear = placed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("taken", F.col("size") * F.col("rounds") + again)
    tied = placed.where(at_cut).groupBy("key", "doc_id", "size", "source_size", "target", "rounds").agg(F.count("*").alias("copies"))
    w = W.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    tied = tied.join(ends.select("key", "before", "rest_up", "down"), "key")
    tied = tied.withColumn("front", _wide(F.col("before") + F.coalesce(F.sum(F.col("copies") * F.col("size")).over(w), F.lit(0))))
    # twice the words of whole copies that fit, plus one copy: the number that is nearest to what is left
    left = _wide(F.greatest(F.col("rest_up") - F.col("front") * F.col("down"), _wide(F.lit(0))))
    fit = F.call_function("div", left * 2 + _wide(F.col("size") * F.col("down")) - 1, _wide(F.col("size") * F.col("down")) * 2)
    tied = tied.withColumn("taken_copies", F.least("copies", fit)).withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    tied = tied.withColumn("taken", F.col("size") * F.col("rounds") + F.when(F.col("n") <= F.col("taken_copies"), F.col("size")).otherwise(F.lit(0)))
    return clear.select(*columns).unionByName(tied.select(*columns))
