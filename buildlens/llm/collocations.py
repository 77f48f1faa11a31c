"""Phrase collocations: frequent phrases of two to four words, scored by their weakest cut.

Two passes over the texts. The first one hands every n-gram's hash to the partition of the
hash range that it falls into, as sorted runs with counts. Each partition keeps a mergeable
Misra-Gries summary of more counters than its mass divided by the threshold, so that what
occurs often enough survives in it, whatever the order and number of the runs that are merged.
The survivors set bits in a bitmap of fixed size. The second pass counts exactly, as strings,
the n-grams whose bit is set. Hashes that fall together can only let more n-grams into that
count. Scores, drops and ranks are joins on the table of frequent phrases.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.llm.shared import give_back, in_parts, join_facts, small_batches, whole, written
from buildlens.llm.shingles import mix

#: Words of a phrase at most, and occurrences that it needs.
WORDS, LEAST = 4, 30
#: Ranks per language; numbers of ways in which a language's candidates are first ranked apart.
MOST, WAYS = 2000, 64
#: N-grams that a task gathers before it hands on a sorted run, and bytes of text that it cuts up at a time.
GATHERED, CHUNK = 3_000_000, 1 << 20
#: Counters that the summary of a partition has at most, as far as there are enough partitions.
COUNTERS = 2_000_000
#: Bits of the bitmap, as a power of two: 32 MB whatever the size of the input.
BITMAP = 28
#: Partitions of the hashes at most, as a power of two.
MOST_PARTS = 16
#: Phrases of a task's counter that make it hand them on.
ENTRIES = 150_000

#: A-Z become a-z, a tab a blank, and what ends a piece a line feed.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_blanks = re.compile(rb"  +")
_rng = np.random.Generator(np.random.PCG64(20250131))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**63, WORDS, dtype=np.uint64)]


def _chunks(text: bytes):
    """A lowered text in parts of about CHUNK bytes, cut between pieces; a longer piece stays whole."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + CHUNK < end:
            end = text.rfind(b"\n", at, at + CHUNK) + 1 or text.find(b"\n", at + CHUNK) + 1 or end
        yield text[at:end]
        at = end


class Words:
    """The words of some text: where they start and end, the piece of each, and their hashes."""

    def __init__(self, text: bytes, seed: np.uint64):
        self.text = _blanks.sub(b" ", text)
        buf = np.frombuffer(self.text + b"\n", np.uint8)
        line = buf == 10
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[1:] = ~(line | (buf == 32))
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(line, dtype=np.int32)[self.start]
        forth = np.full(len(buf) + 1, _BASE, np.uint64)
        back = np.full(len(buf) + 1, _INVERSE, np.uint64)
        forth[0] = back[0] = 1
        forth, back = np.multiply.accumulate(forth), np.multiply.accumulate(back)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * forth[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64) + seed)

    def grams(self):
        """(first word, hash) of the n-grams of 1 to WORDS words within pieces, for each n."""
        sums = np.zeros(len(self.hash), np.uint64)
        for n in range(1, WORDS + 1):
            m = len(self.hash) - n + 1
            if m <= 0:
                return
            sums = sums[:m] + self.hash[n - 1 :] * _STEPS[n - 1]
            first = np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])
            yield n, first, mix(sums[first] + np.uint64(n))


def _lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _texts(b: pa.RecordBatch):
    """(lang, joined texts) for the languages of a batch, in parts of about CHUNK bytes."""
    own = defaultdict(list)
    size: Counter = Counter()
    for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
        for part in _chunks(text.as_py().translate(TABLE)):
            own[lang].append(part)
            size[lang] += len(part)
            if size[lang] >= CHUNK:
                yield lang, b"\n".join(own.pop(lang))
                del size[lang]
    for lang, parts in own.items():
        yield lang, b"\n".join(parts)


def _runs(hashes: list[np.ndarray], parts: int):
    """Sorted hashes with counts as rows (part, sure, mass, run): a header of each partition's
    mass, and its run. N-grams of LEAST occurrences are sure already; they need no counter and
    add no mass. Hashes are differences of their neighbours, byte by byte."""
    every = np.sort(np.concatenate(hashes))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    own, n = every[first], np.diff(np.append(first, len(every)))
    shift = np.uint64(64 - parts)
    for sure in (True, False):
        of = (n >= LEAST) == sure
        h, k = own[of], n[of]
        if not len(h):
            continue
        part = (h >> shift).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(h)], strict=True):
            yield int(part[lo]), sure, 0 if sure else int(k[lo:hi].sum()), pack(h[lo:hi], k[lo:hi])


_codec = pa.Codec("zstd", compression_level=1)


def squeeze(data) -> bytes:
    return _codec.compress(data, asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    return _codec.decompress(data, size, asbytes=True)


def pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes and their counts in few bytes."""
    steps = np.diff(h, prepend=np.uint64(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), np.minimum(n, 255).astype(np.uint8)])
    return len(h).to_bytes(4, "little") + squeeze(planes)


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(run[:4], "little")
    planes = np.frombuffer(unsqueeze(run[4:], size * 9), np.uint8)
    steps = np.ascontiguousarray(planes[: size * 8].reshape(8, size).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), planes[size * 8 :].astype(np.int64)


class Summary:
    """A mergeable Misra-Gries summary of ``capacity`` counters. ``lost`` is what any count may
    have lost: never more than the mass divided by ``capacity + 1``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list = []
        self.waiting = 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.pending.append((h, n))
        self.waiting += len(h)
        if self.waiting >= max(self.capacity, 100_000):
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        h = np.concatenate([self.h, *(x for x, _ in self.pending)])
        n = np.concatenate([self.n, *(x for _, x in self.pending)])
        self.pending, self.waiting = [], 0
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[first], np.add.reduceat(n, first)
        if len(h) > self.capacity:
            take = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
            self.lost += take
            more = n > take
            h, n = h[more], n[more] - take
        self.h, self.n = h, n

    def candidates(self, least: int) -> np.ndarray:
        self.settle()
        return self.h[self.n + self.lost >= least]


def _hand_out(parts: int, bits: int):
    """Texts to runs, whose hashes keep their ``bits`` leading bits."""
    keep = ~np.uint64((1 << (64 - bits)) - 1)
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("run", pa.binary())])

    def rows(hashes):
        out = [[], [], [], []]
        for part, sure, mass, run in _runs(hashes, parts):
            if not sure:
                for column, value in zip(out, (part, 0, mass, None), strict=True):
                    column.append(value)
            for column, value in zip(out, (part, 1 if sure else 2, 0, run), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches):
        hashes, size = [], 0
        with np.errstate(over="ignore"):
            for b in in_parts(batches):
                for lang, text in _texts(b):
                    for _, _, h in Words(text, _lang_seed(lang)).grams():
                        hashes.append(h & keep)
                        size += len(h)
                    if size >= GATHERED:
                        yield rows(hashes)
                        hashes, size = [], 0
            if size:
                yield rows(hashes)
        give_back()

    return run


def _summarise(parts: int, least: int):
    """Rows of whole partitions, in order of part and kind, to (part, candidates, bits): how many bits of the bitmap's part are set, and that part."""
    width = 1 << (BITMAP - parts)

    def bits_of(part, sure, summary):
        found = [*sure, *([summary.candidates(least)] if summary else [])]
        out = np.zeros(width, bool)
        for h in found:
            out[(h >> np.uint64(64 - BITMAP)).astype(np.int64) - part * width] = True
        return pa.record_batch(
            [pa.array([part], pa.int32()), pa.array([int(out.sum())], pa.int64()), pa.array([squeeze(np.packbits(out, bitorder="little"))], pa.binary())], names=["part", "candidates", "bits"]
        )

    def run(batches):
        at, mass, sure, summary = None, 0, [], None
        for b in batches:
            for part, kind, own, packed in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "mass", "run")), strict=True):
                if part != at:
                    if at is not None:
                        yield bits_of(at, sure, summary)
                    at, mass, sure, summary = part, 0, [], None
                if kind == 0:
                    mass += own
                elif kind == 1:
                    sure.append(unpack(packed)[0])
                else:
                    # the masses have come first: more counters than mass / least
                    summary = summary or Summary(mass // least + 1)
                    summary.add(*unpack(packed))
        if at is not None:
            yield bits_of(at, sure, summary)
        give_back()

    return run


def _count(bitmap, parts: int):
    """Texts to runs of the n-grams whose bit is set, as rows (part, lang, words, run): phrases
    with their counts by hash range, and once per language the words that have been read."""
    shift = np.uint64(64 - BITMAP)
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.int64()), ("run", pa.binary())])

    def batch(own, words):
        rows = []
        for lang, counter in own.items():
            runs = defaultdict(list)
            for item in counter.items():
                runs[xxhash.xxh64_intdigest(item[0]) >> (64 - parts)].append(item)
            for part, items in runs.items():
                phrases, counts = zip(*items, strict=True)
                rows.append((part, lang, 0, np.array([len(counts), *counts], np.int64).tobytes() + b"\n".join(phrases)))
            rows.append((xxhash.xxh64_intdigest(lang) >> (64 - parts), lang, words[lang], b""))
        columns = zip(*((part, lang, n, len(run).to_bytes(4, "little") + squeeze(run)) for part, lang, n, run in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        table = np.frombuffer(bitmap.value, np.uint8)
        own: dict = defaultdict(Counter)
        words: Counter = Counter()
        entries = 0
        with np.errstate(over="ignore"):
            for b in in_parts(batches):
                for lang, text in _texts(b):
                    w = Words(text, _lang_seed(lang))
                    words[lang] += len(w.start)
                    counter = own[lang]
                    before = len(counter)
                    for n, first, h in w.grams():
                        slot = (h >> shift).astype(np.int64)
                        hit = first[(table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                        cut = w.text
                        counter.update([cut[x:y] for x, y in zip(w.start[hit].tolist(), w.end[hit + n - 1].tolist(), strict=True)])
                    entries += len(counter) - before
                    if entries >= ENTRIES:
                        yield batch(own, words)
                        own, words, entries = defaultdict(Counter), Counter(), 0
            if own:
                yield batch(own, words)
        give_back()

    return run


def _total(least: int):
    """Rows of whole (part, lang), together, to (lang, phrase, n) of the phrases that are frequent, and a part of the words without a phrase."""

    def batch(lang, words, own):
        often = [(p, n) for p, n in own.items() if n >= least]
        phrases = pa.array([None, *(p for p, _ in often)], pa.binary()).cast(pa.string())
        return pa.record_batch([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array([words, *(n for _, n in often)], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches):
        at, words, own = None, 0, defaultdict(int)
        for b in batches:
            for part, lang, n, packed in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "words", "run")), strict=True):
                if (part, lang) != at:
                    if at is not None:
                        yield batch(at[1], words, own)
                    at, words, own = (part, lang), 0, defaultdict(int)
                words += n
                size = int.from_bytes(packed[:4], "little")
                if size:
                    # a number, so many counts, then phrases, in which there is no line feed
                    data = unsqueeze(packed[4:], size)
                    upto = 8 + 8 * int.from_bytes(data[:8], "little")
                    for phrase, count in zip(data[upto:].split(b"\n"), np.frombuffer(data[8:upto], np.int64).tolist(), strict=True):
                        own[phrase] += count
        if at is not None:
            yield batch(at[1], words, own)
        give_back()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``docs(lang, text)`` without nulls: (lang, phrase, f) of all n-grams of 1 to WORDS words
    that occur at least ``least`` times in a language, exactly; and (lang, n), its words."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a text of so many bytes has no more n-grams than that times WORDS / 2
    mass = size * WORDS // 2 + 1
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), mass // (least * COUNTERS))
    parts = min(MOST_PARTS, math.ceil(math.log2(wanted + 1)))
    bits = min(60, max(BITMAP, math.ceil(math.log2(mass)) + 8))
    read = small_batches(docs.select("lang", "text"))
    runs = read.mapInArrow(_hand_out(parts, bits), "part int, kind int, mass bigint, run binary")
    sorted_runs = runs.repartition(1 << parts, "part").sortWithinPartitions("part", "kind")
    found = written(sorted_runs.mapInArrow(_summarise(parts, least), "part int, candidates bigint, bits binary"), "phrase-bits")
    # of fixed size in all: the driver gets the bits of each partition
    bitmap = bytearray(1 << (BITMAP - 3))
    width = 1 << (BITMAP - parts - 3)
    for part, packed in found.select("part", "bits").toLocalIterator():
        bitmap[part * width : (part + 1) * width] = unsqueeze(packed, width)
    # of the phrases that pass, at most so many by chance; parts of a few hundred thousand each
    passing = found.agg(F.coalesce(F.sum("candidates"), F.lit(0))).first()[0]
    passing += mass * passing >> BITMAP
    ways = min(MOST_PARTS, math.ceil(math.log2(max(wanted, passing // ENTRIES) + 1)))
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    counted = read.mapInArrow(_count(shared, ways), "part int, lang string, words bigint, run binary").repartition(1 << ways, "part").sortWithinPartitions("part", "lang")
    table = written(counted.mapInArrow(_total(least), "lang string, phrase string, n bigint"), "phrases")
    sizes = table.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return table.where("phrase is not null").withColumnRenamed("n", "f"), sizes


def _part(words: str, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``most`` phrases, by score
    descending, a descending and phrase in UTF-8 order.

    Null text is empty and null lang ``und``, as one with the language of that name. Repeated
    rows count each. Languages without a candidate and empty tables give no rows; other columns
    play no part. Of two cuts with the same score the one after fewer words counts.
    """
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole().alias("text"))
    known, sizes = phrase_counts(own, least)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    longer = known.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).where("k >= 2")
    longer = written(longer.withColumnRenamed("f", "a"), "phrase-candidates")
    cuts = longer.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _part("words", F.lit(1), F.col("cut")).alias("head"), _part("words", F.col("cut") + 1, F.col("k")).alias("tail")
    )
    left = join_facts(written(cuts, "phrase-cuts"), known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = join_facts(written(left, "phrase-heads"), known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"), wide("l") + wide("r"))
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "c.score"
    )
    starts = F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)
    inner = (
        longer.where("k >= 3")
        .select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
        .select("lang", "a", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("size")), " "))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longest"))
    )
    left_over = weakest.join(inner, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.lit(100).cast("decimal(10,0)") * F.col("longest").cast("decimal(20,0)") < F.lit(80).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first apart, so that the last ranking has so many rows per language at most
    apart = left_over.withColumn("way", F.pmod(F.xxhash64("phrase"), F.lit(WAYS)))
    best = apart.withColumn("rank", F.row_number().over(W.partitionBy("lang", "way").orderBy(*order))).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
