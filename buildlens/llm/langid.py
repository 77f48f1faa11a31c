"""Language identification by character models.

An interpolated modified Kneser-Ney model of whole letters per language; a text goes to the
language with the lowest cross-entropy per character. What the models say of the n-grams that
the documents have is stored in sorted arrays of n-gram hashes, with the log-probability under
each language; calibration uses training texts that no model has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.kn_table import GRAM, Model, count_grams, distinct_grams, grams, keys, perplexities
from buildlens.llm.shared import map_arrow, written

#: Share of the calibrating texts of a language whose cross-entropy is let pass, and the standard
#: deviations above their mean that are let pass at least. Of few texts the latter are taken wider
#: (``WIDER`` / (texts - 1) times more, about as a prediction interval is); of one, nothing follows.
ACCEPT, DEVIATIONS, WIDER = 0.999, 3.09, 4
#: One in this number of the training texts of a language calibrates instead, at any number of texts.
CALIBRATES = 8
#: Characters that count towards the certainty of a prediction.
CERTAIN = 40
#: Numbers (4 bytes each) in the arrays that are broadcast; beyond, n-grams are joined to the texts.
BROADCAST_NUMBERS = 16_000_000


def letters(text: Column) -> Column:
    """Lower-case letters and marks of a text, all else as single spaces; null as empty."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " ")))


def train_models(train: DataFrame) -> Model:
    """``train(lang, text)`` of letters to the tables of all languages."""
    return Model(written(count_grams(train), "langid-counts"))


def _log_probabilities(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """(ctx, w) of every n-gram in ``docs`` with its log-probabilities under ``names``, in order."""
    wanted = written(distinct_grams(docs), "langid-wanted")
    asked = wanted.withColumn("lang", F.explode(F.array(*map(F.lit, names)))).select(GRAM)
    rows = model.log_probabilities(asked).groupBy("ctx", "w")
    return written(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "logp"))), lambda x: x["logp"].cast("float")).alias("logp")), "langid-known")


def _by_broadcast(docs: DataFrame, known: DataFrame, many: int) -> DataFrame:
    """``docs(text, ...)`` with n and the cross-entropies under ``many`` languages."""
    table = known.toArrow()
    key = keys(table.column("ctx").to_numpy(), table.column("w").to_numpy())
    order = np.argsort(key)
    logp = table.column("logp").combine_chunks().values.to_numpy().reshape(-1, many)[order]
    shared = docs.sparkSession.sparkContext.broadcast((key[order], logp))
    rest = [c for c in docs.columns if c != "text"]

    def run(batch):
        key, logp = shared.value
        texts = batch.column("text").to_pylist()
        n = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), many))
        at = np.flatnonzero(n)
        if len(at):
            for first, ctx, w, inverse, starts in grams([texts[i] for i in at]):
                place = np.searchsorted(key, keys(ctx, w))
                for k in range(many):
                    total[at[first : first + len(starts)], k] = np.add.reduceat(logp[place, k][inverse], starts, dtype=np.float64)
        per_letter = -total / np.maximum(n, 1)[:, None]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(n), pa.array(list(per_letter), pa.list_(pa.float64()))], names=[*rest, "n", "entropies"])

    return map_arrow(docs.select(*rest, "text"), run, docs.select(rest).schema.simpleString()[7:-1] + ",n:bigint,entropies:array<double>")


def _by_join(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The same for models of any size: every text once for each language."""
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "langid-rows")
    each = rows.select(F.col("row").alias("doc_id"), F.explode(F.array(*map(F.lit, names))).alias("lang"), "text").withColumn("model", F.col("lang"))
    found = perplexities(each, model).groupBy(F.col("doc_id").alias("row"), "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lang", "perplexity"))), lambda x: F.log(x["perplexity"])).alias("entropies")
    )
    return rows.drop("text").join(found, "row").drop("row")


def score_languages(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``docs`` (text: letters) to its other columns with n, lang_pred, entropy and score."""
    if not names:
        empty = F.array().cast("array<double>")
        judged = docs.withColumns({"n": F.length("text").cast("bigint") * 0, "entropies": empty}).drop("text")
    else:
        known = _log_probabilities(docs, model, names)
        few = known.count() * len(names) <= BROADCAST_NUMBERS
        judged = _by_broadcast(docs, known, len(names)) if few else _by_join(docs, model, names)
    judged = judged.withColumn("entropy", F.when(F.col("n") > 0, F.array_min("entropies")))
    best = F.array_position("entropies", F.col("entropy")).cast("int")
    weight = F.aggregate("entropies", F.lit(0.0), lambda a, h: a + F.exp((F.col("entropy") - h) * F.least(F.col("n"), F.lit(CERTAIN))))
    pred = F.when(F.col("n") > 0, F.get(F.array(*map(F.lit, [*names, "und"])), best - 1)).otherwise("und")
    return judged.withColumns({"lang_pred": pred, "score": F.when(F.col("n") > 0, 1 / weight).otherwise(0.0)}).drop("entropies")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs(doc_id, text, lang, ...)``.

    Rows whose crc32 of the doc_id as text leaves 2 on division by 4 are held out; the others
    with a language and a letter train the models (a null doc_id has the remainder of the empty
    string, 0), but for an eighth of them by hash of id and text, which calibrates. A language
    whose texts would all calibrate trains on them. ``rejected`` is true where the cross-entropy
    exceeds both what all but a thousandth of the calibrating texts of the predicted language
    have and their mean by a number of standard deviations that falls smoothly with the number of
    texts; the prediction itself stays, and with fewer than two such texts there is no limit. A text that is null or has no letter is
    ``und`` with score 0. Without any training text every row is ``und``. Equal
    cross-entropies go to the first language in order of name. Repeated rows each give a row;
    an empty table gives an empty result; other columns are ignored.
    """
    crc = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    text = letters(F.col("text").cast("string"))
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (crc == 2).alias("held_out"),
        F.col("lang").cast("string").alias("known"),
        F.when(text.rlike(r"\p{L}"), text).otherwise("").alias("text"),
    )
    learned = base.where("not held_out and known is not null and text <> ''")
    aside = F.pmod(F.xxhash64("doc_id", "text"), F.lit(CALIBRATES)) == 0
    # a language is learned even if the hash sets all its texts aside
    sizes = learned.groupBy("known").agg(F.count_if(~aside).alias("others")).collect()
    names = sorted(r["known"] for r in sizes)
    bare = [r["known"] for r in sizes if not r["others"]]
    calibrates = ~F.col("held_out") & aside & F.col("known").isNotNull() & ~F.col("known").isin(*bare)
    base = base.withColumn("calibrates", F.coalesce(calibrates, F.lit(False)))
    train = base.where("not held_out and not calibrates and known is not null and text <> ''").select(F.col("known").alias("lang"), "text")
    scored = written(score_languages(base, train_models(train) if names else None, names), "langid-scores")
    limits = (
        scored.where("calibrates and n > 0 and known = lang_pred")
        .groupBy("lang_pred")
        .agg(
            F.percentile_approx("entropy", F.lit(ACCEPT), F.lit(10_000)).alias("most"),
            (F.avg("entropy") + DEVIATIONS * (1 + F.try_divide(F.lit(WIDER), F.count("*") - 1)) * F.stddev_samp("entropy")).alias("wide"),
        )
        .select("lang_pred", F.when(F.col("wide").isNotNull(), F.greatest("most", "wide")).alias("ceiling"))
    )
    return scored.join(F.broadcast(limits) if len(names) < 1000 else limits, "lang_pred", "left").select(
        "doc_id",
        "held_out",
        "lang_pred",
        "score",
        F.coalesce(F.col("entropy") > F.col("ceiling"), F.lit(False)).alias("rejected"),
    )
