"""Longest depths and cycles against a plain loop; chains in few rounds."""

import random

import pytest

from lotwise.operators import genealogy


def plain_depths(edges: set[tuple[int, int]]) -> dict[int, int | None]:
    parents: dict[int, set[int]] = {node: set() for edge in edges for node in edge}
    for parent, child in edges:
        parents[child].add(parent)
    depth: dict[int, int | None] = {}
    while free := [n for n in parents if n not in depth and parents[n] <= depth.keys()]:
        depth |= {n: max((depth[p] + 1 for p in parents[n]), default=0) for n in free}
    return {n: depth.get(n) for n in parents}


def found(spark, edges):
    rows = genealogy.longest_depth(spark.createDataFrame(list(edges), "parent long, child long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.depth for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_depths_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range((25, 40, 50, 60)[seed])) if seed == 3 or a < b or rng.random() < 0.03}
    assert found(spark, [*edges, *list(edges)[:3]]) == plain_depths(edges)  # repeated edges too


def test_depths_of_cycles(spark):
    ring = {(1, 2), (2, 3), (3, 1)}  # each has one parent, so pointers go round
    shapes = ring | {(3, 4), (4, 5), (9, 5), (9, 10), (10, 11), (5, 6), (20, 20), (30, 31), (20, 31)}
    depths = found(spark, shapes)
    assert depths == plain_depths(shapes)
    assert {n for n, d in depths.items() if d is None} == {1, 2, 3, 4, 5, 6, 20, 31} and depths[11] == 2
    nodes = spark.createDataFrame([(n,) for n in [*depths, 99]], "node long")
    assert {r.node for r in genealogy.cyclic_nodes(nodes, spark.createDataFrame(list(shapes), "parent long, child long")).collect()} == {1, 2, 3, 4, 5, 6, 20, 31}
    without = nodes.filter("node <> 2")  # edges of unknown nodes don't count
    assert {r.node for r in genealogy.cyclic_nodes(without, spark.createDataFrame(list(shapes), "parent long, child long")).collect()} == {20, 31}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(genealogy, "cut", lambda df, own=genealogy.cut: cuts.append(1) or own(df))
    chain = spark.range(1, 3_000).selectExpr("id - 1 as parent", "id as child").unionByName(spark.createDataFrame([(7_000, 2_000)], "parent long, child long"))
    rows = genealogy.longest_depth(chain)
    assert rows.filter("node < 7000 and depth = node").count() == 3_000 and rows.filter("node = 7000 and depth = 0").count() == 1
    assert len(cuts) < 30  # by the logarithm of the length


def test_no_edges(spark):
    assert found(spark, []) == {}
