"""Exact Jaccard metric-space join of documents on five-word shingles, and its components.

Two documents link when their shingle sets have a Jaccard similarity of 0.8 or more, that is
a Jaccard distance, which is a metric, of 0.2 or less.

1. Equal sets form one class; a class is named by 128 bits of its set. Sets too small to link
   with any other than an equal one (fewer than four shingles) are done with that.
2. Certificate of isolation. With tokens in one global order, sets that share at least
   ceil(0.8 n) of n tokens share l of them among their first n - ceil(0.8 n) + l. Classes
   with fewer tokens in such a prefix that any other document has there too link with
   nothing. The same is then done exactly, on the whole sets of the remaining classes: fewer
   than ceil(0.8 n) shared tokens, and the class links with nothing.
3. Pivots. A min-hash of its set deals a class to the region of a pivot, the region's most
   central class; the nearest of a class's pivots is its Voronoi region. Distances to pivots give the
   first links and, later, the triangle-inequality windows.
4. Boundaries. Rarest tokens first, linked classes share a token in a prefix of
   n - ceil(0.8 n) + 1. Classes that meet in such a token but lie in different components so
   far are replicated to that token's region and joined there, unless their sizes, the
   tokens left after that one, or their distances to a common pivot (the window of 0.2 on
   either side) rule the link out. Regions recurse: each round compares the next 1, 8, 64, ...
   most central classes of a region, its new pivots, with all other members, until it lies
   in one component or all its classes have been pivots.

Every link between different components is found, so the components are exact; links inside
a component are left uncounted once it is connected. No step lists all pairs of a group of
copies: they are joined to their pivot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from buildlens.llm.components import connected_components
from buildlens.llm.shared import join_facts, map_arrow, picked_rows, whole, written
from buildlens.llm.shingles import mix, shingle_sets

#: Links have 100 * intersection >= 80 * union.
PERCENT = 80
#: Of n tokens, n // EXTRA more than the shortest prefix, and as many that must be shared.
EXTRA = 10
#: Pairs up to this number (16 bytes each) are broadcast to pick the sets they need.
BROADCAST_PAIRS = 500_000
#: Each round has so many times the pivots of the one before.
GROWTH = 8
#: Regions of pivots per class.
SKETCHES = 2


def least_shared(n: Column | int):
    """ceil(0.8 n) in integers."""
    if isinstance(n, int):
        return -(-PERCENT * n // 100)
    return F.floor((n * PERCENT + 99) / 100).cast("bigint")


#: Two values that set the halves of a class's name apart.
_HALVES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def class_name(text: bytes, s: np.ndarray) -> bytes:
    """The name of a set, 16 bytes: two sums over its tokens. The only token of a set is itself
    a hash of 64 bits, so the words behind it give the second half there."""
    if len(s) == 1:
        only = b" ".join(text.lower().split(None, 5)[:5])
        return int(s[0]).to_bytes(8, "big") + hashlib.blake2b(only, digest_size=8).digest()
    size = mix(np.array([len(s)], np.uint64))
    return b"".join(int((mix(s ^ k).sum(dtype=np.uint64) + size)[0]).to_bytes(8, "big") for k in _HALVES)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of longs."""
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.uint64).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (name of the set), prefix (its least tokens)."""

    def run(batch):
        # in parts, so that a batch of long texts doesn't hold all its shingles at once
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            texts = [t.encode() for t in part.column("text").to_pylist()]
            sets = shingle_sets(texts)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(map(class_name, texts, sets), pa.binary()),
                    _lists([s[: k - least_shared(k) + max(1, k // EXTRA)] for s, k in zip(sets, n, strict=True)]),
                ],
                names=["doc_id", "n_shingles", "node", "prefix"],
            )

    return map_arrow(_texts(docs), run, "doc_id bigint, n_shingles bigint, node binary, prefix array<bigint>")


def shingle_table(docs: DataFrame) -> DataFrame:
    """node, n, tokens (the whole set), sketch (min-hashes) of every document."""

    def run(batch):
        with np.errstate(over="ignore"):
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                texts, sets = zip(*[p for p in zip(texts, shingle_sets(texts), strict=True) if len(p[1])] or [((), ())])
                sketch = [
                    np.array([mix(s * np.uint64(2 * k + 3)).min() for k in range(SKETCHES)], np.uint64) for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(map(class_name, texts, sets), pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _lists(sets),
                        _lists(sketch),
                    ],
                    names=["node", "n", "tokens", "sketch"],
                )

    return map_arrow(_texts(docs), run, "node binary, n bigint, tokens array<bigint>, sketch array<bigint>")


def not_isolated(prints: DataFrame) -> DataFrame:
    """Nodes that the prefix certificate doesn't clear: node, doc_id (its least)."""
    # a set of n tokens has a similarity of at most n / (n + 1) with another one
    can_link = F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * PERCENT
    some = prints.where(can_link & F.col("doc_id").isNotNull())
    # ids of documents are small numbers and shrink in a shuffle, hashes of sets don't
    entries = some.select("doc_id", F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    found = entries.join(shared, "token").groupBy("doc_id").agg(F.count("*").alias("found"))
    # copies of a set, and rows of one doc_id, only add to a count, which clears fewer
    classes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    need = F.greatest(F.lit(1), F.floor(least_shared(F.col("n")) / EXTRA))
    return classes.join(found, "doc_id").where(F.col("found") >= need).select("node", "doc_id")


def boundary_tokens(sets: DataFrame) -> DataFrame:
    """token, node, n, pos, central: the prefixes, rarest tokens first, of nodes with enough
    shared tokens. ``pos`` is a token's place among all tokens of its node, ``central`` how
    many nodes have a token of it on average: an original is more central than its copies."""
    entries = sets.select("node", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    w = W.partitionBy("node")
    placed = (
        entries.join(shared, "token")
        .withColumn("place", F.row_number().over(w.orderBy("df", "token")))
        .withColumn("common", F.count("*").over(w))
        .withColumn("held", F.sum("df").over(w))
    )
    return (
        placed.join(sets.select("node", "n"), "node")
        # tokens that no other node has come first in the order: n - common of them
        .where(F.col("place") <= F.col("common") - least_shared(F.col("n")) + 1)
        .select(
            "token",
            "node",
            "n",
            (F.col("place") + F.col("n") - F.col("common")).alias("pos"),
            ((F.col("held") + F.col("n") - F.col("common")) / F.col("n")).alias("central"),
        )
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) to x, y, common, total: sizes of the intersection and of the union.

    Only the sets of nodes in a pair are moved: few pairs pick them by broadcast.
    """
    pairs = written(pairs.select("x", "y").distinct(), "jaccard-pairs")
    if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        sets = sets.join(F.broadcast(asked), "node", "left_semi")
    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty"))

    def run(batch):
        tx, ty = batch.column("tx"), batch.column("ty")
        common, total = [], []
        vx, vy = tx.values.to_numpy(), ty.values.to_numpy()
        ox, oy = tx.offsets.to_numpy(), ty.offsets.to_numpy()
        for i in range(batch.num_rows):
            a, b = vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]
            c = len(np.intersect1d(a, b, assume_unique=True))
            common.append(c)
            total.append(len(a) + len(b) - c)
        return pa.RecordBatch.from_arrays(
            [batch.column("x"), batch.column("y"), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
            names=["x", "y", "common", "total"],
        )

    joined = pairs.join(left, "x").join(right, "y")
    node = sets.schema["node"].dataType.simpleString()
    return map_arrow(joined.select("x", "y", "tx", "ty"), run, f"x {node}, y {node}, common bigint, total bigint")


def is_link() -> Column:
    return F.col("common") * 100 >= F.col("total") * PERCENT


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component over the links so far."""
    found = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def class_components(sets: DataFrame) -> DataFrame:
    """``sets(node, n, tokens, sketch)`` to (node, component) of every node with a link."""
    regions = written(boundary_tokens(sets), "jaccard-regions")
    nodes = written(regions.groupBy("node", "n").agg(F.max("central").alias("central")), "jaccard-nodes")
    sets = written(sets.join(nodes.select("node", "central"), "node"), "jaccard-sets")

    # pivots of min-hash regions
    dealt = written(sets.select("node", "n", "central", F.posexplode("sketch").alias("which", "region")), "jaccard-dealt")
    pivots = dealt.groupBy("which", "region").agg(F.max(F.struct("central", "node", "n")).alias("p"))
    size_ok = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT
    to_pivot = (
        join_facts(dealt, pivots, ["which", "region"])
        .where((F.col("node") != F.col("p.node")) & size_ok(F.col("n"), F.col("p.n")))
        .select(F.col("node").alias("x"), F.col("p.node").alias("y"))
    )
    measured = written(verified(to_pivot, sets), "jaccard-pivots")
    far = 1 - F.col("common") / F.col("total")
    # the nearest pivot of each class and its distance; a pivot lies at 0 from itself
    home = (
        measured.select(F.col("x").alias("node"), F.struct(far.alias("d"), F.col("y").alias("pivot")).alias("h"))
        .unionByName(measured.select(F.col("y").alias("node"), F.struct(F.lit(0.0).alias("d"), F.col("y").alias("pivot")).alias("h")))
        .groupBy("node")
        .agg(F.min("h").alias("h"))
        .select("node", "h.d", "h.pivot")
    )
    home = written(nodes.select("node").join(home, "node", "left"), "jaccard-home")
    links = measured.where(is_link()).select("x", "y")
    labels = written(_labelled(nodes.select("node"), links), "jaccard-labels")

    ranked = None
    first, many = 0, 1
    while True:
        # regions that lie in more than one component
        placed = regions.join(labels, "node")
        open_ = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
        ranked = placed.join(open_, "token").join(home, "node")
        ranked = written(
            ranked.withColumn("place", F.row_number().over(W.partitionBy("token").orderBy(F.desc("central"), "node")) - 1), "jaccard-open"
        )
        p = ranked.where(F.col("place").between(first, first + many - 1))
        if p.isEmpty():
            return labels
        p = p.select(
            "token",
            F.col("node").alias("y"),
            F.col("n").alias("ny"),
            F.col("component").alias("cy"),
            F.col("place").alias("py"),
            F.col("d").alias("dy"),
            F.col("pivot").alias("qy"),
            F.col("pos").alias("sy"),
        )
        # where a token is the first that two sets share, all other shared ones come after it
        # in both, and links share 4/9 of their sizes' sum
        after = F.least(F.col("n") - F.col("pos"), F.col("ny") - F.col("sy")) + 1
        reachable = after * 9 >= (F.col("n") + F.col("ny")) * 4
        window = ~F.coalesce((F.col("pivot") == F.col("qy")) & (F.abs(F.col("d") - F.col("dy")) > 0.2 + 1e-9), F.lit(False))
        pairs = (
            ranked.join(p, "token")
            .where((F.col("place") > F.col("py")) & (F.col("component") != F.col("cy")) & size_ok(F.col("n"), F.col("ny")) & reachable & window)
            .select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y"))
        )
        more = written(verified(pairs, sets).where(is_link()).select("x", "y"), "jaccard-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(_labelled(nodes.select("node"), links), "jaccard-labels")
        first, many = first + many, many * GROWTH


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text, ...)``.

    A document with fewer than five words has one shingle, all its words; one without words,
    or without text, has none and is its own component. Repeated rows have equal sets and so
    one component. A row with a null doc_id joins the component of rows with an equal set but
    never names one, and a set that only such rows have links with nothing else. An empty
    table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs), "jaccard-prints")
    picked = written(not_isolated(prints), "jaccard-picked")
    ids = picked.where("doc_id is not null").select("doc_id").distinct()
    found = shingle_table(picked_rows(docs, ids)).join(picked, "node")
    # a doc_id that stands in several rows may bring a class several times, and stand for several
    repeated = not prints.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()
    named = found.dropDuplicates(["node"]).drop("doc_id") if repeated else found.drop("node").withColumnRenamed("doc_id", "node")
    sets = written(named, "jaccard-candidates")
    labels = class_components(sets).where("component <> node")
    if not repeated:
        of = picked.select(F.col("node").alias("name"), F.col("doc_id").alias("id"))
        labels = (
            labels.join(of, labels["node"] == of["id"])
            .select(F.col("name").alias("node"), "component")
            .join(of, F.col("component") == of["id"])
            .select("node", F.col("name").alias("component"))
        )
    labels = written(labels.select("node", "component"), "jaccard-classes")
    own = join_facts(prints.select("doc_id", "n_shingles", "node"), labels, ["node"], "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    own = written(own, "jaccard-labelled")
    some = own.where("n_shingles > 0")
    least = written(some.groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-least")
    return (
        join_facts(some, least, ["component"])
        .select("doc_id", "n_shingles", F.col("least").alias("component_id"))
        .unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another one stands for: of each group the one that names it
    stays. Rows that share a doc_id are one document; rows with a null doc_id stay, since they
    name no group and none can stand for them."""
    named = jaccard_components(docs).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("other"))
    others = written(named.where("other").select("doc_id"), "jaccard-others")
    return picked_rows(docs, others, "left_anti")
