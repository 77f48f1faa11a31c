"""Reference graphs: joins repeated until nothing is left to do.

Only counts reach the driver. Rounds write what they find to the cluster's shared folder; now
and then the fronts so far become one table. Chains, nodes with one reference and one referrer
each, are not walked node by node: pointer jumping contracts a chain in the logarithm of its
length, so that the number of rounds does not follow the depth of long thin graphs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.operators.staging import dealt, extras_seed
from buildlens.sources import shared

#: Fronts that are kept apart before they become one table.
FRONTS = 8
#: Levels that are taken away one by one; beyond them, rounds before chains are contracted again, and
#: the share of nodes in chains that makes it worth it.
PEELS, RAKES, WORTH = 16, 4, 8
#: Steps of a closure that are taken one by one.
STEPS = 8


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder, to be joined by shuffles: over many rounds, sides that are just small enough to
    be broadcast would send the driver more than the whole graph."""
    return shared.written(df, name).hint("merge")


class Seen:
    """The fronts of all rounds so far, as one table."""

    def __init__(self, front: DataFrame):
        self.fronts = [front]

    def add(self, front: DataFrame) -> None:
        self.fronts.append(front)
        if len(self.fronts) > FRONTS:
            self.fronts = [written(self.all(), "fronts")]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.fronts)


def first_phase(needs: DataFrame) -> DataFrame:
    """AGG-11: ``needs(phase, path_id)``: the first phase in which a path is staged."""
    return needs.groupBy("path_id").agg(F.min("phase").alias("phase"))


def _jump(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chain(node, to, step, base)`` where a node's value is the greater of ``base`` and ``step`` more
    than the value of ``to``: the same with ``to`` outside of the chain, reached by doubling, and
    (node, least) of those that only lead round in a circle, with the least node of each."""
    n = open_ = chain.count()
    at = chain.withColumn("least", F.col("node"))
    for _ in range(math.ceil(math.log2(max(n, 2))) + 1):
        further = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("step").alias("step2"), F.col("base").alias("base2"), F.col("least").alias("least2"))
        joined = at.join(further, "to", "left")
        at = written(
            joined.select(
                "node", F.coalesce("to2", "to").alias("to"), (F.col("step") + F.coalesce("step2", F.lit(0))).alias("step"),
                F.greatest("base", F.col("base2") + F.col("step")).alias("base"), F.least("least", "least2").alias("least"),
                F.col("to2").isNotNull().alias("moved"), (F.col("least2") < F.col("least")).alias("lower"),
            ),
            "jumps",
        )
        # distances to an end have no gaps: if no node has come to one, only circles are left, and they are
        # through when their least node stays
        before, (open_, lower) = open_, at.agg(F.count_if("moved"), F.count_if("lower")).first()
        if open_ == 0 or open_ == before and lower == 0:
            break
    inside = at.select(F.col("node").alias("to"))
    return at.join(inside, "to", "left_anti").select("node", "to", "step", "base"), at.join(inside, "to", "left_semi").select("node", "least")


def _chains(links: DataFrame, own: str, other: str) -> DataFrame:
    """(node, to, step) of the nodes with one link on either side, ``to`` being the ``other`` end of their ``own`` link."""
    one = links.groupBy(F.col(own).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias("to"), F.min("weight").alias("step")).where("n = 1 AND node <> to")
    back = links.groupBy(F.col(other).alias("node")).agg(F.count("*").alias("n")).where("n = 1")
    return one.join(back.select("node"), "node", "left_semi").select("node", "to", "step")


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(n) for n, c in names.items()))


def _peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PEELS rounds of taking away nodes without a remaining reference: (node, level) of those, and
    the nodes and edges that are left. Only fronts are written; after the first round only
    referrers of the last front can become free."""
    front = written(nodes.join(_named(edges, node="referrer").distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("bigint")), "front")
    seen, n = Seen(front), 0
    while n < PEELS and not front.isEmpty():
        n += 1
        near = edges.join(_named(front, reference="node"), "reference", "left_semi").select(F.col("referrer").alias("node")).distinct()
        held = edges.join(_named(near, referrer="node"), "referrer", "left_semi").join(_named(seen.all(), reference="node"), "reference", "left_anti")
        front = written(near.join(_named(held, node="referrer"), "node", "left_anti").withColumn("level", F.lit(n).cast("bigint")), "front")
        seen.add(front)
    done = written(seen.all(), "peeled")
    left = written(nodes.join(done.select("node"), "node", "left_anti"), "left")
    return done, left, edges.join(_named(done, reference="node"), "reference", "left_anti")


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of the nodes from which no cycle is reached: the longest way to a node without
    references. Some rounds take nodes away one level at a time. Of a graph that is deeper,
    chains are contracted to one link and get their levels at the end, in turn with rounds that take
    away nodes without an open reference and keep what these give with their referrers."""
    done, left, links = _peeled(nodes, edges)
    # all that is left lies above all that is done
    above = done.agg(F.coalesce(F.max("level") + 1, F.lit(0)).cast("bigint")).first()[0]
    if left.isEmpty() or above <= PEELS:
        return done
    live = written(left.select("node", F.lit(above).cast("bigint").alias("base")), "live")
    links = written(links.select("referrer", "reference", F.lit(1).cast("bigint").alias("weight")), "links")
    more = Seen(done)
    hung: list[DataFrame] = []
    moved = True
    while moved:
        moved = False
        n = live.count()
        chain = written(_chains(links, "referrer", "reference").join(live, "node"), "chains")
        if n and chain.count() * WORTH >= n and not (tied := written(_jump(chain)[0], "tied")).isEmpty():
            moved = True
            hung.append(tied)
            # links into a chain lead to its end; what the chain has of its own is kept with the referrer
            stay = links.join(_named(tied, referrer="node"), "referrer", "left_anti")
            into = written(stay.join(_named(tied, reference="node", to="to", step="step", own="base"), "reference"), "into")
            up = into.groupBy(F.col("referrer").alias("node")).agg(F.max(F.col("own") + F.col("weight")).alias("up"))
            live = written(live.join(tied.select("node"), "node", "left_anti").join(up, "node", "left").select("node", F.greatest("base", "up").alias("base")), "live")
            ahead = into.select("referrer", F.col("to").alias("reference"), (F.col("weight") + F.col("step")).alias("weight"))
            kept = stay.join(_named(tied, reference="node"), "reference", "left_anti").select("referrer", "reference", "weight")
            links = written(kept.unionByName(ahead).groupBy("referrer", "reference").agg(F.max("weight").alias("weight")), "links")
        for _ in range(RAKES):
            free = written(live.join(_named(links, node="referrer").distinct(), "node", "left_anti").select("node", F.col("base").alias("level")), "front")
            if free.isEmpty():
                break
            moved = True
            more.add(free)
            up = links.join(_named(free, reference="node", level="level"), "reference").groupBy(F.col("referrer").alias("node")).agg(F.max(F.col("level") + F.col("weight")).alias("up"))
            live = written(live.join(free.select("node"), "node", "left_anti").join(up, "node", "left").select("node", F.greatest("base", "up").alias("base")), "live")
            links = written(links.join(_named(free, reference="node"), "reference", "left_anti"), "links")
    found = more.all()
    for tied in reversed(hung):
        found = written(found.unionByName(tied.join(_named(found, to="node", level="level"), "to").select("node", F.greatest("base", F.col("level") + F.col("step")).alias("level"))), "levels")
    return written(found, "levels")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between ``nodes``, once each and without those from a node to itself."""
    own = edges.where("referrer <> reference").select("referrer", "reference").distinct()
    return own.join(_named(nodes, referrer="node"), "referrer", "left_semi").join(_named(nodes, reference="node"), "reference", "left_semi")


def _core(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Levels of what reaches no cycle, levels counted from above of what no cycle reaches, and
    the nodes on or between cycles with their edges."""
    low = _levels(nodes, edges)
    left = written(nodes.join(low.select("node"), "node", "left_anti"), "left")
    if left.isEmpty():
        return low, low.limit(0), left, edges.limit(0)
    links = written(_within(edges, left), "left-edges")
    high = _levels(left, _named(links, referrer="reference", reference="referrer"))
    knot = written(left.join(high.select("node"), "node", "left_anti"), "knot")
    return low, high, knot, written(_within(links, knot), "knot-edges")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-1: ``nodes(node)`` with ``level``, references before referrers.

    Edges from or to other nodes and from a node to itself don't count. Levels rise from the
    nodes without references; nodes on or between cycles share one level above those; what
    depends on them comes last, again one level per step.
    """
    nodes = written(nodes.select("node").distinct(), "nodes")
    low, high, knot, _ = _core(nodes, written(_within(edges, nodes), "edges"))
    base = low.agg(F.coalesce(F.max("level") + 1, F.lit(0))).first()[0]
    rounds = high.agg(F.coalesce(F.max("level") + 1, F.lit(0))).first()[0]
    levels = low.unionByName(knot.select("node", F.lit(base).alias("level"))).unionByName(high.select("node", (F.lit(base + rounds) - F.col("level")).alias("level")))
    return levels.select("node", F.col("level").cast("int").alias("level"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-5: (node, component, size) for ``nodes(node)``: the least node from which and to which ways
    lead, and the number of those. Components of more than one node are the cycles of the graph.

    What no cycle reaches, or reaches none, is alone. Of the rest, chains are contracted; then
    every node takes the least node before it, and the nodes of one such colour that lead back
    to it are a component. These are taken away and the rest is coloured anew.
    """
    nodes = written(nodes.select("node").distinct(), "nodes")
    _, _, live, links = _core(nodes, written(_within(edges, nodes), "edges"))
    found: list[DataFrame] = []
    hung: list[DataFrame] = []
    while not live.isEmpty():
        weighted = links.withColumn("weight", F.lit(1).cast("bigint"))
        ends = {}
        for side, own, other in (("head", "reference", "referrer"), ("tail", "referrer", "reference")):
            ends[side], circles = _jump(written(_chains(weighted, own, other).withColumn("base", F.lit(0).cast("bigint")), "chains"))
        circles = written(circles.select("node", F.col("least").alias("component")), "circles")
        found.append(circles)
        tied = written(_named(ends["head"], node="node", head="to").join(_named(ends["tail"], node="node", tail="to"), "node"), "tied")
        hung.append(tied)
        gone = tied.select("node").unionByName(circles.select("node"))
        live = written(live.join(gone, "node", "left_anti"), "live")
        across = links.join(_named(gone, referrer="node"), "referrer", "left_anti").join(_named(gone, reference="node"), "reference", "left_anti")
        links = written(across.unionByName(_named(tied, referrer="head", reference="tail")).where("referrer <> reference").distinct(), "links")
        # the least node before each, itself included
        colour = written(live.select("node", F.col("node").alias("colour")), "colours")
        changed = colour
        while not changed.isEmpty():
            told = links.join(_named(changed, referrer="node", told="colour"), "referrer").groupBy(F.col("reference").alias("node")).agg(F.min("told").alias("told"))
            changed = written(told.join(colour, "node").where("told < colour").select("node", F.col("told").alias("colour")), "changed")
            colour = written(colour.join(_named(changed, node="node", told="colour"), "node", "left").select("node", F.least("colour", "told").alias("colour")), "colours")
        # and who of a colour leads back to it
        front = written(colour.where("node = colour"), "front")
        back = Seen(front)
        inside = written(links.join(_named(colour, referrer="node", colour="colour"), "referrer").join(_named(colour, reference="node", colour2="colour"), "reference").where("colour = colour2").select("referrer", "reference", "colour"), "coloured")
        while not front.isEmpty():
            near = inside.join(_named(front, reference="node"), "reference", "left_semi").select(F.col("referrer").alias("node"), "colour").distinct()
            front = written(near.join(back.all().select("node"), "node", "left_anti"), "front")
            back.add(front)
        whole = written(back.all().select("node", F.col("colour").alias("component")), "whole")
        found.append(whole)
        live = written(live.join(whole.select("node"), "node", "left_anti"), "live")
        links = written(_within(links, live), "links")
    if not found:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("bigint").alias("size"))
    parts = written(reduce(DataFrame.unionByName, found), "parts")
    for tied in reversed(hung):
        # a chain belongs to the component of its ends if that is one
        ends = tied.join(_named(parts, head="node", a="component"), "head").join(_named(parts, tail="node", b="component"), "tail").where("a = b")
        parts = written(parts.unionByName(ends.select("node", F.col("a").alias("component"))), "parts")
    # names that contraction has given may not be the least
    named = parts.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("size"))
    known = parts.join(named, "component").select("node", F.col("least").alias("component"), "size")
    alone = nodes.join(parts.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("bigint").alias("size"))
    return known.unionByName(alone)


def _deep(front: DataFrame, links: DataFrame) -> DataFrame:
    """(path_id, depth) of all that ``links`` reach from ``front(path_id, depth)``, by the shortest way:
    chains are contracted to one link of their length, and links are followed while depths fall."""
    weighted = links.withColumn("weight", F.lit(1).cast("bigint"))
    chain = _chains(weighted, "reference", "referrer").join(_named(front, node="path_id"), "node", "left_anti").withColumn("base", F.lit(0).cast("bigint"))
    tied = written(_jump(written(chain, "chains"))[0].select("node", "to", "step"), "tied")
    ends = weighted.join(_named(tied, reference="node"), "reference", "left_anti").join(_named(tied, referrer="node", to="to", step="step"), "referrer", "left")
    short = written(ends.select(F.coalesce("to", "referrer").alias("referrer"), "reference", (F.col("weight") + F.coalesce("step", F.lit(0))).alias("weight")), "short-links")
    best = changed = written(_named(front, node="path_id", depth="depth").select("node", F.col("depth").cast("bigint").alias("depth")), "depths")
    while not changed.isEmpty():
        told = short.join(_named(changed, referrer="node", depth="depth"), "referrer").groupBy(F.col("reference").alias("node")).agg(F.min(F.col("depth") + F.col("weight")).alias("told"))
        changed = written(told.join(best, "node", "left").where("depth is null or told < depth").select("node", F.col("told").alias("depth")), "changed")
        best = written(best.unionByName(changed).groupBy("node").agg(F.min("depth").alias("depth")), "depths")
    inside = tied.join(_named(best, to="node", depth="depth"), "to").select("node", (F.col("depth") + F.col("step")).alias("depth"))
    every = best.unionByName(inside).select(F.col("node").alias("path_id"), F.col("depth").cast("int").alias("depth"))
    return written(every.join(front.select("path_id"), "path_id", "left_anti"), "deep")


def closure(seeds: DataFrame, edges: DataFrame, known: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """GRF-2: ``seeds(path_id)`` and all they reference, never entering ``known(path_id)``.

    Columns path_id, depth (steps from a seed) and, if ``metadata(path_id)`` is given,
    ``error`` for a path without any; such a path is not followed.
    """
    outside = lambda df: df.distinct().join(known.select("path_id"), "path_id", "left_anti")
    front = written(outside(seeds.select("path_id")).withColumn("depth", F.lit(0)), "front")
    found, depth = Seen(front), 0
    links = edges.select("referrer", "reference").distinct()
    while depth < STEPS and not front.isEmpty():
        depth += 1
        follow = front if metadata is None else front.join(metadata.select("path_id"), "path_id", "left_semi")
        step = links.join(follow.select(F.col("path_id").alias("referrer")), "referrer", "left_semi").select(F.col("reference").alias("path_id"))
        fresh = outside(step).join(found.all().select("path_id"), "path_id", "left_anti")
        front = written(fresh.withColumn("depth", F.lit(depth)), "front")
        found.add(front)
    if not front.isEmpty():
        # what can still be entered, and from where
        ahead = links.where("referrer <> reference").join(_named(known, reference="path_id"), "reference", "left_anti").join(_named(found.all(), reference="path_id"), "reference", "left_anti")
        ahead = ahead.join(_named(found.all().where(F.col("depth") < depth), referrer="path_id"), "referrer", "left_anti")
        if metadata is not None:
            ahead = ahead.join(_named(metadata, referrer="path_id"), "referrer", "left_semi")
        found.add(_deep(front, written(ahead, "ahead")))
    seen = found.all()
    if metadata is None:
        return seen
    have = metadata.select("path_id", F.lit(False).alias("error")).distinct()
    return seen.join(have, "path_id", "left").withColumn("error", F.coalesce("error", F.lit(True)))


def pin_plan(offer: DataFrame, valid_paths: DataFrame, refs: DataFrame) -> DataFrame:
    """GRF-3: ``offer(path)`` with ``pinned``: unknown paths, and valid ones that no other
    valid path of the offer references."""
    known = offer.select("path").distinct().join(valid_paths.select("path", "id"), "path")
    covered = (
        refs.where("referrer <> reference")
        .join(known.select(F.col("id").alias("referrer")), "referrer", "left_semi")
        .join(known.select(F.col("id").alias("reference"), "path"), "reference")
        .select("path")
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    return offer.select("path").distinct().join(covered, "path", "left").select("path", F.col("covered").isNull().alias("pinned"))


def extras(references: DataFrame, inputs: DataFrame, outputs: DataFrame, edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """GRF-4: what outputs reference beyond inputs and outputs, closed and in order of levels."""
    known = inputs.select("path_id").unionByName(outputs.select("path_id"))
    found = closure(extras_seed(references, inputs, outputs), edges, known, metadata)
    levels = topo_levels(found.select(F.col("path_id").alias("node")), edges)
    return found.join(levels, found["path_id"] == levels["node"]).select("path_id", "depth", "error", "level")


def audit_staging(needs: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-5: edges whose reference is first staged after its referrer, or never."""
    phases = first_phase(needs)
    a = phases.select(F.col("path_id").alias("referrer"), F.col("phase").alias("referrer_phase"))
    b = phases.select(F.col("path_id").alias("reference"), F.col("phase").alias("reference_phase"))
    return edges.where("referrer <> reference").join(a, "referrer").join(b, "reference", "left").where(
        F.col("reference_phase").isNull() | (F.col("reference_phase") > F.col("referrer_phase"))
    ).select("referrer", "reference", "referrer_phase", "reference_phase")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-5: nodes on cycles; none if the graph has no cycle."""
    return strong_components(nodes, edges).where("size > 1").select("node")


def open_needs(needs: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """GRF-5: ``needs(build, path_id)``: references of needed paths that the build doesn't need. Needs,
    and what they lead to, are in ``parts`` partitions if given."""
    want = dealt(needs.select("build", F.col("path_id").alias("referrer")), parts, "referrer").join(edges.where("referrer <> reference"), "referrer")
    have = dealt(needs.select("build", F.col("path_id").alias("reference")), parts, "build", "reference")
    return dealt(want.select("build", "reference"), parts, "build", "reference").distinct().join(have, ["build", "reference"], "left_anti")
