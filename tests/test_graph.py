"""Depths of long chains and of cycles."""

import random

import pytest

from tidewright.operators.graph import depths


def frames(spark, pairs):
    nodes = sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(pairs, "src long, dst long")


def test_depths_of_a_long_chain(spark):
    got = depths(*frames(spark, [(i, i + 1) for i in range(60)] + [(0, 60)]))
    assert {r.node: r.depth for r in got.collect()} == {i: i for i in range(61)}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        depths(*frames(spark, [(0, 1), (1, 2), (2, 1)]))


def test_random_graphs_equal_plain_search(spark):
    rng = random.Random(6)
    for size, share in ((40, 0.08), (60, 0.03), (30, 0.3)):
        names = list(range(size))
        rng.shuffle(names)
        pairs = [(names[i], names[j]) for i in range(size) for j in range(i + 1, size) if rng.random() < share]
        want = {}
        for n in names:
            want[n] = max((want[a] + 1 for a, b in pairs if b == n), default=0)
        nodes = spark.createDataFrame([(n,) for n in names], "node long")
        edges = spark.createDataFrame(pairs + pairs[:5], "src long, dst long")
        assert {r.node: r.depth for r in depths(nodes, edges).collect()} == want


def test_cycles_raise(spark):
    nodes = spark.createDataFrame([(n,) for n in range(6)], "node long")
    for pairs in ([(0, 1), (1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 3), (3, 1), (0, 3)]):
        with pytest.raises(ValueError, match="cycle"):
            depths(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()
