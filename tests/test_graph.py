import random

import pytest
from pyspark.sql import functions as F

from tierflow import shared
from tierflow.operators import graph


def components_of(edges):
    """Cyclic components by closure: node to smallest node."""
    nodes = {v for e in edges for v in e}
    reach = {v: {t for s, t in edges if s == v} for v in nodes}
    for k in nodes:
        for v in nodes:
            if k in reach[v]:
                reach[v] |= reach[k]
    return {v: min(u for u in reach[v] if v in reach[u]) for v in nodes if v in reach[v]}


def depths_of(edges):
    """Longest chains, a cyclic component counting as many edges as it has nodes."""
    own = components_of(edges)
    nodes = {v for e in edges for v in e}
    name = {v: own.get(v, v) for v in nodes}
    weight = {c: sum(1 for v in own if own[v] == c) for c in name.values()}
    known = {}

    def depth(c):
        if c not in known:
            known[c] = weight[c] + max((1 + depth(name[t]) for s, t in edges if name[s] == c != name[t]), default=0)
        return known[c]

    return {v: depth(name[v]) for v in nodes}


def made(kind):
    pick = random.Random(kind)
    if kind == "sparse":
        return {(pick.randint(0, 60), pick.randint(0, 60)) for _ in range(70)}
    if kind == "dense":
        return {(pick.randint(0, 20), pick.randint(0, 20)) for _ in range(60)}
    if kind == "tree":
        return {(k, (k - 1) // 2) for k in range(1, 64)}
    if kind == "rings":
        return {(10 * r + k, 10 * r + (k + 1) % 5) for r in range(4) for k in range(5)} | {(3, 100), (100, 101), (101, 12), (14, 200), (200, 14), (30, 30)}
    if kind == "grid":
        return {(10 * x + y, 10 * x + y + d) for x in range(6) for y in range(6) for d in (1, 10) if (y < 5 or d == 10) and (x < 5 or d == 1)}
    return {(k, k + 1) for k in range(30)} | {(k, k + 3) for k in range(0, 27, 5)} | {(12, 9)}


@pytest.mark.parametrize("kind", ["sparse", "dense", "tree", "rings", "grid", "ladder"])
def test_components_and_depth(spark, kind):
    edges = made(kind)
    rows = spark.createDataFrame(sorted(edges), "s int, t int")
    components = shared.stored(graph.strong_components(rows), "test")
    assert {r.node: r.component for r in components.collect()} == components_of(edges)
    assert {r.node: r.depth for r in graph.chain_lengths(rows, components).collect()} == depths_of(edges)


@pytest.mark.parametrize(
    "edges",
    [
        {(1, 2), (2, 3), (3, 1), (2, 2), (1, 4), (4, 1)},  # a loop inside a chain of a component
        {(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 5), (6, 7), (7, 6), (4, 4)},  # chains that become loops of others
        {(1, 2), (2, 1), (1, 3), (3, 4), (4, 2)},  # one chain of all nodes with one way in and out
    ],
)
def test_loops_and_single_chains_inside_components(spark, edges):
    rows = spark.createDataFrame(sorted(edges), "s int, t int")
    found = [(r.node, r.component) for r in graph.strong_components(rows).collect()]
    assert sorted(found) == sorted(components_of(edges).items())
    assert {r.node: r.depth for r in graph.chain_lengths(rows).collect()} == depths_of(edges)


def test_long_chain_and_ring_in_few_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, tag: written.append(tag) or shared.stored(df, tag))
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    ring = spark.range(n).select((F.col("id") + 10_000).alias("s"), ((F.col("id") + 1) % n + 10_000).alias("t"))
    both = shared.stored(chain.union(ring).union(spark.createDataFrame([(n, 10_500)], "s long, t long")), "test")
    components = shared.stored(graph.strong_components(both), "test")
    assert tuple(components.agg(F.min("node"), F.max("node"), F.count("*"), F.max("component")).first()) == (10_000, 12_999, n, 10_000)
    depth = graph.chain_lengths(both, components)
    assert depth.where("node <= 3000").select(F.min(F.expr("depth + node")), F.max(F.expr("depth + node"))).first() == (2 * n + 1, 2 * n + 1)
    path = graph.cycle_paths(both, components).collect()
    assert [r.path for r in path] == [[*range(10_000, 13_000), 10_000]]
    assert len(written) < 110, len(written)


def test_cycle_paths_are_shortest(spark):
    edges = made("dense") | {(100, 101), (101, 102), (102, 100)}
    own = components_of(edges)
    rows = spark.createDataFrame(sorted(edges), "s int, t int")
    found = {r.component: r.path for r in graph.cycle_paths(rows, spark.createDataFrame(sorted(own.items()), "node int, component int")).collect()}
    assert set(found) == set(own.values())
    for component, path in found.items():
        assert path[0] == path[-1] == component and all(step in edges for step in zip(path, path[1:]))
        level, hops = {component}, 0
        while True:
            level, hops = {t for s, t in edges if s in level}, hops + 1
            if component in level:
                break
        assert len(path) - 1 == hops


def test_rounds_send_no_tables_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "stored", lambda df, tag: plans.append(df._jdf.queryExecution().toString()) or shared.stored(df, tag))
    ends = shared.stored(spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 3)], "s int, t int"), "test")
    found = [graph.successor_depth(ends), graph.reachable(ends, spark.createDataFrame([(4,)], "node int"))]
    assert {tuple(r) for r in found[0].collect()} == {(1, 2), (2, 2), (3, 3), (4, 4)}
    assert {tuple(r) for r in found[1].collect()} == {(4, 0), (3, 1), (2, 2), (1, 3)}
    plans += [df._jdf.queryExecution().toString() for df in found]
    assert not [plan for plan in plans if "BroadcastExchange" in plan]


def test_empty_graphs(spark):
    rows = spark.createDataFrame([], "s string, t string")
    assert graph.strong_components(rows).collect() == graph.chain_lengths(rows).collect() == []
    one = spark.createDataFrame([("a", "a"), (None, "b"), ("a", None)], "s string, t string")
    assert [tuple(r) for r in graph.strong_components(one).collect()] == [("a", "a")]
