import random

from civicflow.llm.components import connected_components


def test_chains_stars_and_pairs(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 300)]  # a chain
    edges += [(1000, 1000 + i) for i in range(1, 150)] + [(5, 1040)]  # a star with a lesser tail
    edges += [(2000 + 2 * i, 2001 + 2 * i) for i in range(20)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {i: 100 for i in range(100, 301)} | {i: 5 for i in range(1000, 1150)} | {5: 5}
    want |= {2000 + i: 2000 + i - i % 2 for i in range(40)}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
