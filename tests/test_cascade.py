"""Severity propagation against a brute-force walk over random graphs."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from scorecraft.operators.cascade import propagate_level


def brute(levels, edges):
    """Worst level over all proper predecessors, and the fewest hops to one with it."""
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    out = {}
    for node, level in levels.items():
        seen, frontier, hops, found = set(), {node}, 0, {}
        while frontier:
            hops += 1
            frontier = {p for n in frontier for p in before.get(n, ())} - seen
            seen |= frontier
            for p in frontier:
                if levels.get(p, 0) > 0:
                    found.setdefault(levels[p], hops)
        worst = max(found, default=0)
        out[node] = (level, worst, found.get(worst))
    return out


def run(spark, levels, edges):
    got = propagate_level(
        spark.createDataFrame(list(levels.items()), "node int, level int"),
        spark.createDataFrame(edges, "predecessor int, successor int"),
    )
    return {r.node: (r.level, r.inherited_level, r.hops) for r in got.collect()}


def test_chain(spark):
    levels = {1: 2, 2: 0, 3: 3, 4: 0, 5: 1}
    edges = [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert run(spark, levels, edges) == {
        1: (2, 0, None), 2: (0, 2, 1), 3: (3, 2, 2), 4: (0, 3, 1), 5: (1, 3, 2)}


def test_cycle_ends_and_returns_a_node_its_own_level(spark):
    assert run(spark, {1: 3, 2: 0}, [(1, 2), (2, 1)]) == {1: (3, 3, 2), 2: (0, 3, 1)}


def test_no_edges_and_no_delays(spark):
    assert run(spark, {1: 3, 2: 0}, []) == {1: (3, 0, None), 2: (0, 0, None)}
    assert run(spark, {1: 0, 2: 0}, [(1, 2)]) == {1: (0, 0, None), 2: (0, 0, None)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graph_with_a_hub(spark, seed):
    chance = random.Random(seed)
    levels = {n: chance.choice([0, 0, 0, 1, 2, 3]) for n in range(40)}
    edges = [(chance.randrange(40), chance.randrange(40)) for _ in range(45)]
    edges += [(0, n) for n in range(1, 20)] + [(n, 39) for n in range(20, 39)]
    assert run(spark, levels, edges) == brute(levels, edges)


@pytest.mark.parametrize("seed", [4, 5])
def test_chains_between_joints_and_cycles(spark, seed):
    chance = random.Random(seed)
    nodes = list(range(160))
    levels = {n: chance.choice([0] * 6 + [1, 2, 3]) for n in nodes}
    edges = [(n - 1, n) for n in nodes[1:] if n % 31]  # five chains
    edges += [(chance.choice(nodes), chance.choice(nodes)) for _ in range(seed * 3 - 9)]
    edges += [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(203, 210), (210, 211), (211, 5)]
    edges += [(300, 300), (300, 301)]  # cycles that no other edge enters, with a tail
    levels |= {203: 1, 206: 2, 300: 2} | {n: 0 for n in (200, 201, 202, 204, 205, 210, 211, 301)}
    assert run(spark, levels, edges) == brute(levels, edges)


def test_a_chain_takes_few_jobs(spark):
    """Rounds grow with the logarithm of the length, with two jobs each."""
    levels = {n: 3 if n == 0 else n % 7 == 5 for n in range(64)}
    edges = [(n, n + 1) for n in range(63)]
    want = brute(levels, edges)
    spark.sparkContext.setJobGroup("chain", "a chain of 64")
    got = run(spark, {n: int(x) for n, x in levels.items()}, edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
    assert jobs < 30


def test_the_states_are_dropped(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(Path(base).glob("scratch-*"))
    assert run(spark, {1: 3, 2: 0}, [(1, 2)])[2] == (0, 3, 1)
    assert set(Path(base).glob("scratch-*")) == before
