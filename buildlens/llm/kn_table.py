"""Interpolated modified Kneser-Ney models over whole characters, as Spark tables.

No character is folded: a 4-gram is the three code points before a character, packed into one
number of 63 bits, and the character. Counts, probabilities and back-offs are tables that grow
with the training text; nothing of them is broadcast or collected.

Scoring asks for each n-gram once: the distinct n-grams of the documents, counted out per task
before any shuffle, are joined to the tables in shards of (language, n-gram). While what comes
of that has at most BROADCAST_GRAMS rows it goes to every task; beyond, it is joined to chunks
of documents, each of which meets the n-grams that it has. Both give the same sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import give_back, in_parts, kept, map_arrow, small_batches, written
from buildlens.llm.shingles import mix

ORDER = 4
BITS = 21
#: Code points; what no training text has shares the uniform rest of the probability.
SYMBOLS = 0x110000
#: Characters that are handled at once; a longer text is handled alone.
PIECE = 500_000
#: Characters of a chunk of documents, and n-grams that a task holds before it passes them on.
CHUNK, HELD = 4_000_000, 250_000
#: Scored n-grams (12 bytes each) up to this number are broadcast.
BROADCAST_GRAMS = 4_000_000
#: Entries of a look-up table in place of a sort.
TABLE = 1 << 22
GRAM = ["lang", "ctx", "w"]


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, all below ``size``, in order, and the place of each code among them."""
    if size > TABLE:
        return np.unique(codes, return_inverse=True)
    present = np.zeros(size, bool)
    present[codes] = True
    kinds = np.flatnonzero(present)
    rank = np.zeros(size, np.int32)
    rank[kinds] = np.arange(len(kinds), dtype=np.int32)
    return kinds, rank[codes]


def grams(texts: list[str]):
    """Yield (first text, contexts, characters, inverse, starts) for pieces of ``texts``, none of
    them empty: the distinct n-grams, and for each place of the texts joined the n-gram that ends
    there. Symbols are code points plus 1; 0 is the boundary before a text."""
    at = 0
    while at < len(texts):
        upto, n = at, 0
        while upto < len(texts) and (upto == at or n + len(texts[upto]) <= PIECE):
            n += len(texts[upto])
            upto += 1
        some = texts[at:upto]
        lengths = np.array([len(t) for t in some])
        starts = np.cumsum(lengths + ORDER - 1) - lengths
        s = np.frombuffer("".join(["\0" * (ORDER - 1) + t for t in some]).encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
        real = np.ones(len(s), bool)
        for k in range(1, ORDER):
            s[starts - k] = 0
            real[starts - k] = False
        known, symbol = ranked(s, SYMBOLS + 1)
        size = len(known)
        # the n-gram that ends at a place, one symbol longer each time, numbered among its kinds
        last, history = symbol, known
        for _ in range(1, ORDER):
            code = np.zeros(len(s), np.int64)
            code[1:] = last[:-1].astype(np.int64) * size + symbol[1:]
            kinds, last = ranked(code, len(history) * size)
            before, w = history[kinds // size], known[kinds % size]
            history = (before << BITS) | w
        del history
        picked, inverse = ranked(last[real], len(kinds))
        yield at, before[picked], w[picked], inverse, np.cumsum(lengths) - lengths
        at = upto


def keys(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram, for look-ups within a chunk."""
    with np.errstate(over="ignore"):
        return mix(mix(ctx.astype(np.uint64)) + w.astype(np.uint64))


class Tally:
    """Counts of n-grams by group, merged now and then."""

    def __init__(self):
        self.parts: dict[tuple, list] = {}
        self.rows = 0

    def add(self, group: tuple, texts: list[str]) -> None:
        for _, ctx, w, inverse, _ in grams(texts):
            self.parts.setdefault(group, []).append((ctx, w, np.bincount(inverse, minlength=len(w))))
            self.rows += len(w)

    def merge(self) -> None:
        for group, parts in self.parts.items():
            if len(parts) > 1:
                ctx, w, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                _, first, inverse = np.unique(keys(ctx, w), return_index=True, return_inverse=True)
                self.parts[group] = [(ctx[first], w[first], np.bincount(inverse, n).astype(np.int64))]
        self.rows = sum(len(p[0][1]) for p in self.parts.values())

    def full(self) -> bool:
        """Whether it is time to pass on what is held: merging no longer makes it small."""
        if self.rows > 2 * HELD:
            self.merge()
        return self.rows > HELD

    def take(self):
        self.merge()
        for group, ((ctx, w, n),) in self.parts.items():
            yield group, ctx, w, n
        self.parts, self.rows = {}, 0


def _by_group(batch, names: list[str]) -> dict[tuple, list[str]]:
    by: dict[tuple, list[str]] = {}
    columns = [batch.column(c).to_pylist() for c in names]
    for *group, text in zip(*columns, batch.column("text").to_pylist(), strict=True):
        if text:
            by.setdefault(tuple(group), []).append(text)
    return by


def _tallied(df: DataFrame, group: list[str], counted: bool) -> DataFrame:
    """The distinct n-grams of the texts of each group, with their counts if ``counted``. An
    n-gram may come more than once."""
    kinds = dict(df.select(group).dtypes)
    types = {"int": pa.int32(), "string": pa.string()}

    def out(tally: Tally):
        for g, ctx, w, n in tally.take():
            arrays = [pa.array([v] * len(w), types[kinds[c]]) for c, v in zip(group, g, strict=True)]
            arrays += [pa.array(ctx, pa.int64()), pa.array(w, pa.int32())] + ([pa.array(n, pa.int64())] if counted else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*group, "ctx", "w", *(["n"] if counted else [])])

    def run(batches):
        kept()
        tally = Tally()
        try:
            for b in in_parts(batches):
                for g, texts in _by_group(b, group).items():
                    tally.add(g, texts)
                    if tally.full():
                        yield from out(tally)
            yield from out(tally)
        finally:
            del tally
            give_back()

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", ctx bigint, w int" + (", n bigint" if counted else "")
    return small_batches(df.select(*group, "text")).mapInArrow(run, schema)


def count_grams(train: DataFrame) -> DataFrame:
    """``train(lang, text)`` to (lang, ctx, w, n)."""
    return _tallied(train, ["lang"], True).groupBy(GRAM).agg(F.sum("n").alias("n"))


def distinct_grams(docs: DataFrame) -> DataFrame:
    """(ctx, w) of every n-gram in ``docs(text)``."""
    return _tallied(docs.select(F.lit("").alias("all"), "text"), ["all"], False).select("ctx", "w").distinct()


def _suffix(k: int) -> Column:
    """The last k - 1 symbols of a context: what an n-gram of order k looks back on."""
    return F.col("ctx").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1).cast("bigint"))


def _discounts(level: DataFrame) -> DataFrame:
    """lang to d1, d2, d3: the discounts of counts of 1, 2 and 3 or more."""
    c = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    some = F.least("n1", "n2", "n3", "n4") > 0
    d = [
        F.when(some, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05))).otherwise(rough)
        for k, rough in ((1, 0.5), (2, 0.75), (3, 0.9))
    ]
    return c.select("lang", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])


class Model:
    """Written tables by order k: probabilities (lang, ctx, w, p) of what training has, and
    back-offs (lang, ctx, backoff) of its contexts."""

    def __init__(self, counts: DataFrame):
        """``counts(lang, ctx, w, n)``, each n-gram once."""
        levels = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):
            shorter = levels[k + 1].select("lang", _suffix(k).alias("ctx"), "w").groupBy(GRAM).agg(F.count("*").alias("n"))
            levels[k] = written(shorter, f"kn-counts-{k}")
        self.p: dict[int, DataFrame] = {}
        self.backoff: dict[int, DataFrame] = {}
        for k in range(1, ORDER + 1):
            d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
            cut = levels[k].join(F.broadcast(_discounts(levels[k])), "lang").select(*GRAM, "n", d.alias("d"))
            sums = cut.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("backoff"))
            sums = written(sums, f"kn-contexts-{k}")
            self.backoff[k] = sums.select("lang", "ctx", "backoff")
            whole = cut.join(sums, ["lang", "ctx"]).withColumn("short", _suffix(k - 1) if k > 1 else F.lit(0).cast("bigint"))
            if k > 1:
                lower = self.p[k - 1].select("lang", F.col("ctx").alias("short"), "w", F.col("p").alias("q"))
                whole = whole.join(lower, ["lang", "short", "w"])
            else:
                whole = whole.withColumn("q", F.lit(1.0 / SYMBOLS))
            self.p[k] = written(whole.select(*GRAM, ((F.col("n") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("q")).alias("p")), f"kn-{k}")

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """(lang, ctx, w), each once, to the same with ``logp``; backed off where unseen."""
        tried = written(wanted.join(self.p[ORDER], GRAM, "left"), "kn-tried")
        rest = tried.where("p is null").select(*GRAM, F.lit(1.0 / SYMBOLS).alias("q"))
        for k in range(1, ORDER + 1):
            rest = rest.withColumn("at", _suffix(k))
            rest = rest.join(self.backoff[k].withColumnRenamed("ctx", "at"), ["lang", "at"], "left")
            if k < ORDER:
                rest = rest.join(self.p[k].withColumnRenamed("ctx", "at"), ["lang", "at", "w"], "left")
            else:
                rest = rest.withColumn("p", F.lit(None).cast("double"))
            rest = rest.select(*GRAM, F.coalesce("p", F.col("backoff") * F.col("q"), "q").alias("q"))
        return tried.where("p is not null").unionByName(rest.withColumnRenamed("q", "p")).select(*GRAM, F.log("p").alias("logp"))


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, model, text) to (doc_id, lang, n, perplexity) under the language ``model``
    of the tables. An empty text has n = 0 and no perplexity."""
    rows = docs.select("doc_id", F.col("lang").alias("own"), F.col("model").alias("lang"), "text")
    wanted = written(_tallied(rows, ["lang"], False).distinct(), "kn-wanted")
    known = written(model.log_probabilities(wanted), "kn-known")
    return _scored_by_broadcast(rows, known) if known.count() <= BROADCAST_GRAMS else _scored_by_chunk(rows, known)


RESULT = "doc_id bigint, lang string, n bigint, perplexity double"


def _sums(langs: list[str], texts: list[str], known) -> tuple[np.ndarray, np.ndarray]:
    """Length and sum of log-probabilities of each text; ``known(lang)`` gives sorted n-gram
    keys of a language and their log-probabilities."""
    n = np.array([len(t) for t in texts], np.int64)
    total = np.zeros(len(texts))
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        if n[i]:
            by.setdefault(lang, []).append(i)
    for lang, at in by.items():
        key, logp = known(lang)
        for first, ctx, w, inverse, starts in grams([texts[i] for i in at]):
            values = logp[np.searchsorted(key, keys(ctx, w))]
            total[at[first : first + len(starts)]] = np.add.reduceat(values[inverse], starts, dtype=np.float64)
    return n, total


def _result(doc_id, own, n: np.ndarray, total: np.ndarray) -> list:
    with np.errstate(divide="ignore", invalid="ignore"):
        ppl = np.exp(-total / n)
    return [doc_id, own, pa.array(n), pa.array(ppl, pa.float64(), mask=n == 0)]


def _arrays(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = keys(known.column("ctx").to_numpy(), known.column("w").to_numpy())
    order = np.argsort(key)
    return key[order], known.column("logp").to_numpy()[order].astype(np.float32)


def _scored_by_broadcast(rows: DataFrame, known: DataFrame) -> DataFrame:
    table = known.toArrow()
    langs = table.column("lang").unique().to_pylist()
    shared = rows.sparkSession.sparkContext.broadcast(
        {lang: _arrays(table.filter(pa.compute.equal(table.column("lang"), lang))) for lang in langs}
    )

    def run(batch):
        n, total = _sums(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), shared.value.__getitem__)
        return pa.RecordBatch.from_arrays(_result(batch.column("doc_id"), batch.column("own"), n, total), names=["doc_id", "lang", "n", "perplexity"])

    return map_arrow(rows, run, RESULT)


def _scored_by_chunk(rows: DataFrame, known: DataFrame) -> DataFrame:
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(rows.sparkSession.sparkContext.defaultParallelism * 2, size // CHUNK + 1)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    given = written(_tallied(rows.repartition("chunk"), ["chunk", "lang"], False), "kn-wanted-by-chunk").join(known, GRAM)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        of = {lang: _arrays(right.filter(pa.compute.equal(right.column("lang"), lang))) for lang in right.column("lang").unique().to_pylist()}
        n, total = _sums(left.column("lang").to_pylist(), left.column("text").to_pylist(), of.__getitem__)
        return pa.table(_result(left.column("doc_id"), left.column("own"), n, total), names=["doc_id", "lang", "n", "perplexity"])

    return rows.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(score, RESULT)
