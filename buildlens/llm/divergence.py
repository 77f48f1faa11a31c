"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Terms are counted by a translate table: one ``bytes.translate`` lowers letters and blanks all
that separates, ``bytes.split`` gives the terms and a ``Counter`` per document their
frequencies; its keys count the documents. A task adds the counters up by (lang, source) and
hands them on whenever they hold many entries, so that its memory has a bound and a frequent
term leaves it in few rows. All that follows is integer or decimal arithmetic on those rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.llm.shared import in_parts, join_facts, small_batches, written

#: A-Z become a-z; every other ASCII character but a-z becomes a blank; other bytes stay.
TABLE = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: A kept term stands in so many documents of its language.
LEAST_DOCUMENTS = 30
#: What is added to each count, and what the frequencies are scaled to.
ADDED, SCALE = 5, 1_000_000_000
#: Ranks of the terms that are reported per group.
MOST_TERMS = 50
#: Entries of a task's counters that make it hand them on.
ENTRIES = 250_000
#: Cells of the matrices, sources by sources and terms by sources, that a task holds at a time.
CELLS = 2_000_000

COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def document_terms(text: bytes) -> Counter:
    """Frequency of each term of a text in UTF-8."""
    return Counter(text.translate(TABLE).split())


class _Tally:
    """Frequencies and documents of each term, by group."""

    def __init__(self):
        self.n: dict = defaultdict(dict)
        self.docs: dict = defaultdict(Counter)

    def add(self, group, terms: Counter) -> int:
        """Add a document; number of entries that are new."""
        own, docs = self.n[group], self.docs[group]
        before = len(own)
        docs.update(terms.keys())
        for term, n in terms.items():
            own[term] = own.get(term, 0) + n
        return len(own) - before

    def batch(self) -> pa.RecordBatch:
        langs, sources, terms, counts, docs = [], [], [], [], []
        for (lang, source), own in self.n.items():
            langs += [lang] * len(own)
            sources += [source] * len(own)
            terms += own.keys()
            counts += own.values()
            docs += map(self.docs[lang, source].__getitem__, own)
        # the parts between ASCII characters of a text in UTF-8 are themselves UTF-8
        return pa.record_batch(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )


def _counted(batches):
    tally, entries = _Tally(), 0
    for b in in_parts(batches):
        texts = b.column("text").cast(pa.binary())
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
            entries += tally.add((lang, source), document_terms(text.as_py()))
            if entries >= ENTRIES:
                yield tally.batch()
                tally, entries = _Tally(), 0
    if entries:
        yield tally.batch()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it. Null text,
    lang and source are ''; groups without a term have no row."""
    read = small_batches(docs.select(*_filled("lang", "source", "text")))
    return read.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(*names: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in names]


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = (wide(n) + ADDED) * F.lit(SCALE).cast("decimal(10,0)")
    under = wide(total) + wide(terms * ADDED)
    return F.call_function("div", over, under) + 1


def _pair_sums(batches):
    """Sum over terms of abs(p - q) for each two sources of a language, of the terms in these
    rows. Terms are laid out as rows of a matrix with a column per source, in which a source
    without the term has its own least share."""
    sums: dict = {}
    held = 0

    def out():
        for lang, m in sums.items():
            i, j = np.triu_indices(len(m), 1)
            yield pa.record_batch([pa.array([lang] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(m[i, j])], names=["lang", "i", "j", "value"])

    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            rows = b.filter(pa.array(langs == lang))
            least = np.array(rows.column("least")[0].as_py(), np.int64)
            s = len(least)
            if lang not in sums:
                if held and held + s * s > CELLS:
                    yield from out()
                    sums, held = {}, 0
                sums[lang] = np.zeros((s, s), np.int64)
                held += s * s
            step = max(1, CELLS // s)
            for lo in range(0, rows.num_rows, step):
                part = rows.slice(lo, step)
                shares = np.tile(least, (part.num_rows, 1))
                lists = part.column("shares")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                shares[row, flat.field("i").to_numpy(zero_copy_only=False)] = flat.field("p").to_numpy(zero_copy_only=False)
                for i in range(s - 1):
                    sums[lang][i, i + 1 :] += np.abs(shares[:, i + 1 :] - shares[:, i : i + 1]).sum(0)
    yield from out()


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value bigint, rank int) for every (lang, source) of ``docs``.

    Part ``pair``: each other source of the language, with the sum of the absolute differences of
    the two sources' term shares. Part ``term``: the terms that a source has more often than its
    language, with the difference, up to ``most_terms``. Ranks go by value descending, then by
    item in UTF-8 order.

    Null text, lang and source count as ''. Repeated rows are documents of their own. A group
    without terms is compared like any other; in a language without kept terms every value of
    its pairs is 0. An empty table gives no rows; other columns play no part. Memory of a task
    is bounded but for a square of the sources of one language, which the result has anyway.
    """
    groups = written(docs.select(*_filled("lang", "source")).distinct(), "groups")
    counts = written(term_counts(docs), "term-counts")
    enough = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_documents)
    kept = written(counts.join(enough.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    # one row per group, its place among the sources of its language and the share of a term that it lacks
    facts = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")
    )
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    facts = written(facts.withColumn("i", place), "source-facts")

    shared = written(
        join_facts(kept, facts, ["lang", "source"]).select(
            "lang", "source", "term", "i", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
        ),
        "term-shares",
    )
    by_rank = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shared.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= most_terms)
    )
    least = facts.where("terms > 0").groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", _share(F.lit(0), F.col("total"), F.col("terms")).alias("p")))), lambda s: s["p"]).alias("least")
    )
    by_term = written(shared.groupBy("lang", "term").agg(F.collect_list(F.struct("i", "p")).alias("shares")), "shares-by-term")
    laid = small_batches(join_facts(by_term, written(least, "least-shares"), ["lang"]).select("lang", "shares", "least"))
    sums = laid.mapInArrow(_pair_sums, "lang string, i bigint, j bigint, value bigint").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    one, two = facts.select("lang", "source", "i"), facts.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = (
        one.join(two, "lang")
        .where("i <> j")
        .withColumns({"a": F.least("i", "j").cast("bigint"), "b": F.greatest("i", "j").cast("bigint")})
        .join(sums.select("lang", F.col("i").alias("a"), F.col("j").alias("b"), "value"), ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        .withColumn("rank", F.row_number().over(by_rank))
    )
    return pairs.unionByName(terms)
