"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a SimHash of its weighted five-word shingles. Windows of an item's
length slide over a document; a multi-index over blocks of the fingerprint finds every item
within the Hamming radius of a window, and the weighted Jaccard similarity of the shingle
multisets decides.

A pair of similarity 0.8 has a cosine of 0.889 and so differs in 0.152 of the bits, 38.8 of 256
with a deviation of 5.7; the radius lies 4.2 deviations above. Two fingerprints within the
radius of 63 agree but for 3 bits in one of 16 blocks at least, which few others do: about one
in six of unrelated pairs meets in the index, and none of those is within the radius.

Windows without a single shingle of the benchmark cannot reach the similarity, so only those
around such shingles are fingerprinted; this drops no pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import kept, map_arrow, picked_rows, whole, written
from buildlens.llm.shingles import SPACE_OR_MARK, mix, shingle_hashes, whole_hash, words

K = 5
SIMILARITY = 0.8
#: Bits that differ at most, blocks of 16 bits, and bits that differ at most in one block at least.
RADIUS, BLOCKS = 63, 16
NEAR = RADIUS // BLOCKS
#: What differs from a block's value in at most NEAR bits.
MASKS = np.array([sum(1 << i for i in c) for k in range(NEAR + 1) for c in itertools.combinations(range(16), k)], np.uint16)
_SEEDS = [np.uint64(int(x) | 1) for x in np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, BLOCKS // 4, dtype=np.uint64)]
#: Shingles whose windows are fingerprinted at a time.
STRETCH = 4096
#: Bytes of benchmark text that one pass over the documents holds; more items take more passes.
PASS_BYTES = 32_000_000


def simhash_signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    wide = np.stack([mix(h * seed) for seed in _SEEDS], 1)
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of blocks."""
    # weights that cancel out leave rounding errors, which hang on where a running sum began
    return np.packbits(sums > 1e-6, axis=1, bitorder="little").view(np.uint16).reshape(-1, BLOCKS)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def shingles_of(h: np.ndarray) -> np.ndarray:
    return shingle_hashes(h, K) if len(h) >= K else (whole_hash(h) if len(h) else np.zeros(0, np.uint64))


class Items:
    """The benchmark: shingles, weights, fingerprints, and the block index of each item length."""

    def __init__(self, ids: list, texts: list[str | None], whole_benchmark: tuple | None = None):
        """``whole_benchmark``: where this is only a pass, the number of items in all, and the
        shingles of this pass's items with the number of items in all that have them."""
        with np.errstate(over="ignore"):
            hashes = [np.zeros(0, np.uint64)] * len(ids)
            for first, h, bounds in words([(t or "").encode() for t in texts], SPACE_OR_MARK):
                for i in range(len(bounds) - 1):
                    hashes[first + i] = h[bounds[i] : bounds[i + 1]]
            kept = [i for i, h in enumerate(hashes) if len(h)]
            self.ids = [ids[i] for i in kept]
            self.size = np.array([len(hashes[i]) for i in kept], np.int64)
            self.shingles = [shingles_of(hashes[i]) for i in kept]
        # weight: the rarer among items, the heavier; what no item has weighs most
        every, df = np.unique(np.concatenate([np.unique(s) for s in self.shingles]) if kept else np.zeros(0, np.uint64), return_counts=True)
        self.every = every
        self.count = len(kept)
        if whole_benchmark is not None:
            self.count, s, n = whole_benchmark
            df = n[np.searchsorted(s, every)]
        self.weight = np.log1p(self.count / df)
        self.heaviest = float(np.log1p(self.count)) if kept else 1.0
        self.elsewhere = (np.zeros(0, np.uint64), np.zeros(0))
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(every >> np.uint64(44)).astype(np.int64)] = True
        self.mark = np.concatenate(
            [packed((simhash_signs(s) * self.weights(s)[:, None]).sum(0, keepdims=True)) for s in self.shingles] or [np.zeros((0, BLOCKS), np.uint16)]
        )
        self.by_size: dict[int, np.ndarray] = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size)}
        # for each length and block: the values of its items in order, and the items
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, members in self.by_size.items():
            order = np.argsort(self.mark[members], axis=0, kind="stable")
            self.index[n] = (np.take_along_axis(self.mark[members], order, 0), members[order])

    def known(self, s: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of the benchmark."""
        hit = self.gate[(s >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            pos = np.minimum(np.searchsorted(self.every, s[at]), len(self.every) - 1)
            hit[at] = self.every[pos] == s[at]
        return hit

    def read(self, known: tuple[np.ndarray, np.ndarray]) -> None:
        """Take the next document's shingles that any pass has, sorted, and in how many items."""
        self.elsewhere = (known[0], np.log1p(self.count / known[1]))

    def weights(self, s: np.ndarray) -> np.ndarray:
        w = np.full(len(s), self.heaviest)
        for every, weight in ((self.every, self.weight), self.elsewhere):
            if len(every):
                pos = np.minimum(np.searchsorted(every, s), len(every) - 1)
                hit = every[pos] == s
                w[hit] = weight[pos[hit]]
        return w

    def met(self, n: int, marks: np.ndarray) -> np.ndarray:
        """(window, item) pairs of item length n that the index brings together, each once."""
        values, items = self.index[n]
        few = len(values)
        if few <= len(MASKS):
            members = self.by_size[n]
            near = (np.bitwise_count(marks[:, None, :] ^ self.mark[members][None, :, :]) <= NEAR).any(2)
            w, i = np.nonzero(near)
            return np.stack([w, members[i]], 1)
        pairs = []
        for b in range(BLOCKS):
            asked = (marks[:, b, None] ^ MASKS[None, :]).ravel()
            lo, hi = np.searchsorted(values[:, b], asked, "left"), np.searchsorted(values[:, b], asked, "right")
            count = hi - lo
            w = np.repeat(np.arange(len(asked)) // len(MASKS), count)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(w * len(self.size) + items[np.repeat(lo, count) + inside, b])
        code = np.unique(np.concatenate(pairs))
        return np.stack([code // len(self.size), code % len(self.size)], 1)

    def candidates(self, n: int, marks: np.ndarray) -> np.ndarray:
        """(window, item) pairs of item length n within RADIUS, each once."""
        if not len(marks):
            return np.zeros((0, 2), np.int64)
        pairs = [self.met(n, marks[k : k + 500]) + np.array([k, 0]) for k in range(0, len(marks), 500)]
        pairs = np.concatenate(pairs)
        return pairs[distance(marks[pairs[:, 0]], self.mark[pairs[:, 1]]) <= RADIUS]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        both = np.concatenate([window, self.shingles[item]])
        side = np.concatenate([np.ones(len(window)), np.zeros(len(self.shingles[item]))])
        kinds, inverse = np.unique(both, return_inverse=True)
        a = np.bincount(inverse, side, len(kinds))
        b = np.bincount(inverse, 1 - side, len(kinds))
        w = self.weights(kinds)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def matches(self, h: np.ndarray, s: np.ndarray, hits: np.ndarray) -> dict[int, tuple[int, int, float]]:
        """Item to (start word, words, similarity) of its best window in a document with word
        hashes h and shingles s, of which those at ``hits`` are in the benchmark."""
        found: dict[int, tuple[int, int, float]] = {}
        weights = self.weights(s)
        heavy, known = np.zeros(len(s) + 1), np.zeros(len(s) + 1)
        np.cumsum(weights, out=heavy[1:])
        known[1:][hits] = weights[hits]
        known = np.cumsum(known)
        # around clusters of hits, so that long documents cost by their hits
        reach = int(self.size.max())
        cuts = np.flatnonzero(np.diff(hits) > reach) + 1
        for group in np.split(hits, cuts):
            lo, hi = max(0, int(group[0]) - reach), min(len(s), int(group[-1]) + reach)
            windows = {}
            for n in self.by_size:
                wide = max(1, min(n, len(h)) - K + 1)
                starts = np.arange(lo, max(lo + 1, hi - wide + 1))
                ends = np.minimum(starts + wide, hi)
                # similarity is at most the part of a window's weight that the benchmark knows
                full = known[ends] - known[starts] >= (SIMILARITY - 1e-9) * (heavy[ends] - heavy[starts])
                if full.any():
                    windows[n] = (starts[full], ends[full])
            if not windows:
                continue
            # in stretches, so that a long document holds no more than one at a time
            for first in range(lo, hi, STRETCH):
                some = {n: (a[k], b[k]) for n, (a, b) in windows.items() if (k := (a >= first) & (a < first + STRETCH)).any()}
                if some:
                    self.compare(s, weights, some, len(h), found)
        return found

    def compare(self, s: np.ndarray, weights: np.ndarray, windows: dict, size: int, found: dict) -> None:
        """Put the matches of ``windows`` (item length to starts and ends among the shingles s of
        a document of ``size`` words) into ``found``."""
        lo, hi = min(int(a[0]) for a, _ in windows.values()), max(int(b[-1]) for _, b in windows.values())
        total = np.zeros((hi - lo + 1, 16 * BLOCKS))
        np.cumsum(simhash_signs(s[lo:hi]) * weights[lo:hi, None], axis=0, out=total[1:])
        for n, (starts, ends) in windows.items():
            marks = packed(total[ends - lo] - total[starts - lo])
            pairs = self.candidates(n, marks)
            nearest = np.argsort(distance(marks[pairs[:, 0]], self.mark[pairs[:, 1]]), kind="stable")
            for w, item in pairs[nearest].tolist():
                at, _, best = found.get(item, (0, 0, 0.0))
                if best >= 1 - 1e-12 and starts[w] >= at:
                    continue
                sim = self.similarity(s[starts[w] : ends[w]], item)
                # of equal windows the first, whatever else the benchmark holds
                if sim >= SIMILARITY and (sim > best or (sim == best and starts[w] < at)):
                    found[item] = (int(starts[w]), min(n, size), sim)


def slices(benchmark: DataFrame):
    """The benchmark in lists of rows (item_id, text, ...) of at most PASS_BYTES of text each."""
    now: list[tuple] = []
    size = 0
    for r in benchmark.toLocalIterator():
        if now and size + len(r["text"]) * 4 > PASS_BYTES:
            yield now
            now, size = [], 0
        now.append((r["item_id"], r["text"], *(pairs(r["known"]) if "known" in r else ())))
        size += len(r["text"]) * 4
    if now:
        yield now


def pairs(known: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and the number of items that have each."""
    s = np.array([k["s"] for k in known], np.int64).view(np.uint64)
    n = np.array([k["n"] for k in known], np.int64)
    order = np.argsort(s)
    return s[order], n[order]


#: A text's identity where its shingles are joined and come back.
TEXT_KEY = ["h", "crc", "chars"]


def keyed(texts: DataFrame) -> DataFrame:
    return texts.select("*", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.length("text").alias("chars"))


def text_shingles(texts: DataFrame) -> DataFrame:
    """The key of each text with each of its distinct shingles."""

    def run(batch):
        kept = {c: batch.column(c).to_numpy() for c in TEXT_KEY}
        with np.errstate(over="ignore"):
            for first, h, bounds in words([t.encode() for t in batch.column("text").to_pylist()], SPACE_OR_MARK):
                own = [np.unique(shingles_of(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                at = np.repeat(np.arange(first, first + len(own)), [len(s) for s in own])
                arrays = [pa.array(kept[c][at]) for c in TEXT_KEY] + [pa.array(np.concatenate(own).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*TEXT_KEY, "s"])

    return map_arrow(keyed(texts).select(*TEXT_KEY, "text"), run, "h bigint, crc bigint, chars int, s bigint")


def with_known(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``texts`` with a shingle in ``counts(s, n)``, and what it has of it in ``known``."""
    hits = text_shingles(texts).join(counts, "s").groupBy(TEXT_KEY).agg(F.collect_set(F.struct("s", "n")).alias("known"))
    return keyed(texts).join(hits, TEXT_KEY).drop(*TEXT_KEY)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document for
    each benchmark item that it holds with a similarity of 0.8 or more.

    Words are runs of letters and digits in either case; white space and ASCII punctuation
    part them. An item or text of fewer than five words is one shingle, so that such an item
    matches only a text of the same words. Null or empty texts
    and items match nothing. Repeated rows each give their pairs; null ids are carried along;
    an empty table on either side gives an empty result; other columns are ignored. The
    benchmark is held in passes of at most PASS_BYTES. Shingles are then counted over all
    passes and joined to the texts, so that passes change no weight, fingerprint or similarity.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")).where("text <> ''")
    items = benchmark.select("item_id", whole().alias("text"))
    count = None
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) * 4 > PASS_BYTES:
        items = items.where("text <> ''")
        rows = items.groupBy("text").agg(F.count("*").alias("rows"))
        counts = text_shingles(items.select("text").distinct()).join(keyed(rows).select(*TEXT_KEY, "rows"), TEXT_KEY)
        counts = written(counts.groupBy("s").agg(F.sum("rows").alias("n")), "leak-shingles")
        items = written(with_known(items, counts), "leak-items")
        count = items.count()
        texts = written(with_known(texts, counts), "leak-candidates")
    out = None
    for some in slices(items):
        shared = spark.sparkContext.broadcast((count, some))

        def run(batch, shared=shared):
            items = _items(shared)
            ids = batch.column("doc_id").to_pylist()
            known = batch.column("known") if "known" in batch.schema.names else None
            rows: list[tuple] = []
            if not len(items.size):
                return
            with np.errstate(over="ignore"):
                for first, h, bounds in words([t.encode() for t in batch.column("text").to_pylist()], SPACE_OR_MARK):
                    s_all = shingle_hashes(h, K)
                    hit = np.flatnonzero(items.known(s_all))
                    a, b = bounds[:-1], bounds[1:]
                    some_hit = (np.searchsorted(hit, np.maximum(b - K + 1, a)) > np.searchsorted(hit, a)) | ((b - a < K) & (b > a))
                    for i in np.flatnonzero(some_hit).tolist():
                        own = h[a[i] : b[i]]
                        s = shingles_of(own)
                        hits = np.flatnonzero(items.known(s))
                        if len(hits):
                            if known is not None:
                                items.read(pairs(known[first + i].as_py()))
                            for item, got in items.matches(own, s, hits).items():
                                rows.append((ids[first + i], items.ids[item], *got))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)],
                    names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

        got = map_arrow(texts, run, schema, keeps=True)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def _items(shared) -> Items:
    """The benchmark of a broadcast, built once in each Python worker."""
    count, rows = shared.value

    def made() -> tuple:
        whole_benchmark = None
        if count is not None:
            s, at = np.unique(np.concatenate([r[2] for r in rows]), return_index=True)
            whole_benchmark = (count, s, np.concatenate([r[3] for r in rows])[at])
        # with the rows, whose identity is the key and must not be given to others
        return rows, Items([r[0] for r in rows], [r[1] for r in rows], whole_benchmark)

    return kept(("items", id(rows)), made)[1]


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay. Rows that share a
    doc_id go together if one of them holds an item; a row with a null doc_id stays."""
    leaked = written(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return picked_rows(docs, leaked, "left_anti")
