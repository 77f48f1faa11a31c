"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

Per language, an interpolated modified Kneser-Ney model of character 4-grams, none folded, is
trained on three quarters of the trusted documents; the rest, unseen in training as other documents are,
calibrates. A document is kept if its perplexity lies between two quantiles of the
perplexities of its language's calibrating documents of about its length; the fewer those are,
the more the quantiles lean on those of the language and of all documents: text that is less
predictable than trusted text is noise, text that is far more predictable repeats itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.kn_table import Model, count_grams, perplexities
from buildlens.llm.shared import picked_rows, whole, written

#: Quantiles of trusted perplexities outside which a document is rejected.
LOW, HIGH = 0.002, 0.998
#: Widening of both limits, and the calibrating documents whose quantile counts as much as the wider group's.
SLACK, ENOUGH = 0.01, 150


def band() -> Column:
    """Length band: perplexities of short texts scatter more, so limits are kept by powers of 4."""
    return F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) / 2), F.lit(7)).cast("int")


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``trusted(doc_id)``."""
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return picked_rows(docs, ids)


def quality_scores(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n, perplexity, floor, ceiling, kept for every row of ``docs(doc_id, text, lang, ...)``.

    ``labels(doc_id, quality, toxic)``: a document is trusted where quality is 1 and toxic is
    not 1. A null language is one of its own, scored by the pooled model against the pooled
    quantiles, as are languages without trusted text; a language whose trusted text all went
    into training is judged by the pooled quantiles. A null or empty text has no perplexity
    and is rejected. With no calibrating text in any language nothing can be rejected but empty texts.
    Repeated rows each give a row; an empty table gives an empty result; other columns are
    ignored.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), whole().alias("text")
    )
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).select("doc_id")
    train = trusted_rows(texts, good.where(~calibrates))
    own = written(count_grams(train), "quality-counts")
    pooled = own.groupBy("ctx", "w").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "ctx", "w", "n")
    counts = written(own.where("lang <> ''").unionByName(pooled), "quality-all-counts")
    with_model = sorted(r["lang"] for r in own.where("lang <> ''").select("lang").distinct().collect())
    model = F.when(F.col("lang").isin(*with_model), F.col("lang")).otherwise("") if with_model else F.lit("")
    scores = written(perplexities(texts.withColumn("model", model), Model(counts)), "quality-scores")
    seen = trusted_rows(scores, good.where(calibrates)).where("n > 0")
    q = lambda p: F.percentile_approx("perplexity", F.lit(p), F.lit(100_000))
    # every trusted row counts for its language and for the pool, in its band and in all lengths
    counted = seen.withColumn("model", F.explode(F.array_distinct(F.array(model, F.lit(""))))).withColumn(
        "at", F.explode(F.array(band(), F.lit(-1)))
    )
    stats = written(
        counted.groupBy("model", "at").agg(
            F.count("*").alias("m"), F.log(q(low)).alias("low"), F.log(q(high)).alias("high"), F.log(q(0.5)).alias("mid")
        ),
        "quality-limits",
    )
    # pool, band of the pool, language, band of the language
    named = lambda df, s: df.select(*[c for c in ("model", "band") if c in df.columns], *[F.col(c).alias(c + s) for c in ("m", "low", "high", "mid")])
    pool = named(stats.where("model = '' and at = -1").drop("model"), "_p")
    pool_band = named(stats.where("model = '' and at >= 0").drop("model").withColumnRenamed("at", "band"), "_b")
    own_all = named(stats.where("model <> '' and at = -1"), "_l")
    own_band = named(stats.where("model <> '' and at >= 0").withColumnRenamed("at", "band"), "_x")
    # a language's middle is known from few documents, its outer quantiles are not
    shift = F.coalesce(F.col("m_l") / (F.col("m_l") + 1) * (F.col("mid_l") - F.col("mid_p")), F.lit(0.0))

    def leaning(own: str, m: str, prior: Column) -> Column:
        return F.coalesce((F.col(m) * F.col(own) + ENOUGH * prior) / (F.col(m) + ENOUGH), prior)

    def limit(c: str) -> Column:
        whole_language = leaning(c + "_l", "m_l", F.col(c + "_p") + shift)
        return F.exp(leaning(c + "_x", "m_x", whole_language + leaning(c + "_b", "m_b", F.col(c + "_p")) - F.col(c + "_p")))

    # the fewer documents stand behind all quantiles, the less they say about the next one
    wider = 1 + SLACK + 1 / F.sqrt("m_p")
    return (
        scores.withColumn("model", model)
        .withColumn("band", band())
        .join(own_band, ["model", "band"], "left")
        .join(own_all, "model", "left")
        .join(pool_band, "band", "left")
        .join(F.broadcast(pool), F.lit(True), "left")
        .withColumn("floor", limit("low") / wider)
        .withColumn("ceiling", limit("high") * wider)
        .select(
            "doc_id",
            F.nullif("lang", F.lit("")).alias("lang"),
            "n",
            "perplexity",
            "floor",
            "ceiling",
            (
                (F.col("n") > 0)
                & F.coalesce(F.col("perplexity").between(F.col("floor"), F.col("ceiling")), F.lit(True))
            ).alias("kept"),
        )
    )


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps. Rows that share a doc_id stay together
    if one of them is kept; rows with a null doc_id stay, since no decision can be tied to them."""
    judged = quality_scores(docs, labels).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return picked_rows(docs, written(judged.where("not kept").select("doc_id"), "quality-rejected"), "left_anti")
