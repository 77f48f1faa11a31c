"""Levels, closures and strong components against plain Python; long chains in few rounds."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import graph


def reach(edges, start):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    seen, todo = {start}, [start]
    while todo:
        for b in out[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def brute_components(n, edges):
    far = {i: reach(edges, i) for i in range(n)}
    return {i: sorted(j for j in far[i] if i in far[j]) for i in range(n)}


def tables(spark, n, edges):
    return spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(edges), "referrer bigint, reference bigint")


GRAPHS = {
    "rings joined by ways": (30, [(i, (i + 1) % 10) for i in range(10)] + [(4, 12)] + [(12 + i, 12 + (i + 1) % 6) for i in range(6)] + [(15, 20), (20, 21), (21, 22), (22, 15), (22, 25), (25, 26)]),
    "pure circle of falling numbers": (12, [(i, (i - 1) % 12) for i in range(12)]),
    "no cycle": (9, [(i, i + 1) for i in range(8)] + [(0, 5), (3, 3)]),
    "a caterpillar": (40, [(i + 1, i) for i in range(19)] + [(i, 20 + i) for i in range(20)] + [(5, 3), (9, 2)]),
    "a chord in a ring": (16, [(i, (i + 1) % 16) for i in range(16)] + [(3, 11), (9, 2)]),
}


def longest(n, edges):
    """Levels by hand: from below what reaches no cycle, then the knot, then from above."""
    edges = {(a, b) for a, b in edges if a != b}
    low, left, k = {}, set(range(n)), 0
    while free := {x for x in left if not any(a == x and b in left for a, b in edges)}:
        low |= dict.fromkeys(free, k)
        left, k = left - free, k + 1
    high, r = {}, 0
    while free := {x for x in left if not any(b == x and a in left for a, b in edges)}:
        high |= dict.fromkeys(free, r)
        left, r = left - free, r + 1
    return low | dict.fromkeys(left, k) | {x: k + r - v for x, v in high.items()}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_levels(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "PEELS", 2)
    n, edges = GRAPHS[name]
    want = {i: (own[0], len(own)) for i, own in brute_components(n, edges).items()}
    assert {r.node: (r.component, r.size) for r in graph.strong_components(*tables(spark, n, edges)).collect()} == want
    assert {r.node: r.level for r in graph.topo_levels(*tables(spark, n, edges)).collect()} == longest(n, edges)


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "PEELS", 1)
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(62)}
    want = {i: (own[0], len(own)) for i, own in brute_components(n, edges).items()}
    assert {r.node: (r.component, r.size) for r in graph.strong_components(*tables(spark, n, edges)).collect()} == want
    assert {r.node: r.level for r in graph.topo_levels(*tables(spark, n, edges)).collect()} == longest(n, edges)


def counted(monkeypatch):
    names = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (names.append(name), real(df, name))[1])
    return names


def test_a_long_chain_has_few_rounds(spark, monkeypatch):
    names = counted(monkeypatch)
    n = 100_000
    chain = spark.range(n - 1).select((F.col("id") + 1).alias("referrer"), F.col("id").alias("reference"))
    nodes = spark.range(n).withColumnRenamed("id", "node")
    levels = graph.topo_levels(nodes, chain)
    assert levels.where("level <> node").isEmpty() and levels.count() == n
    # every round writes its front, or its jumps
    assert sum(k in ("front", "jumps") for k in names) < 40
    names.clear()
    found = graph.closure(spark.createDataFrame([(n - 1,)], "path_id bigint"), chain, spark.createDataFrame([(9,)], "path_id bigint"))
    assert found.count() == n - 10 and found.where(F.col("depth") + F.col("path_id") != n - 1).isEmpty()
    assert sum(k in ("front", "jumps", "changed") for k in names) < 40


@pytest.mark.parametrize("seed", [3])
def test_deep_closures(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "STEPS", 2)
    rng = random.Random(seed)
    n = 80
    edges = {(i, i + 1) for i in range(0, n - 1) if i % 20 != 19} | {(rng.randrange(n), rng.randrange(n)) for _ in range(12)}
    known, without = {33, 57}, {13, 44}
    ids = lambda s: spark.createDataFrame([(i,) for i in sorted(s)], "path_id bigint")
    got = graph.closure(ids({0, 41}), tables(spark, n, edges)[1], ids(known), ids(set(range(n)) - without))
    depth, front, k = {0: 0, 41: 0}, {0, 41}, 0
    while front:
        k += 1
        front = {b for a, b in edges if a in front - without and b not in known and b not in depth}
        depth |= dict.fromkeys(front, k)
    assert {r.path_id: (r.depth, r.error) for r in got.collect()} == {i: (v, i in without) for i, v in depth.items()}


def test_rounds_send_the_driver_no_sides(spark, capsys):
    some = graph.written(spark.range(5).withColumnRenamed("id", "node"), "some")
    for how in ("inner", "left", "left_semi", "left_anti"):
        some.join(graph._named(graph.written(some, "other"), node="node").distinct(), "node", how).explain()
    assert "Broadcast" not in capsys.readouterr().out
