import random

from lexgraph.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def check(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_random_edges_loops_nulls_and_repeats(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    check(spark, edges + edges[:50] + [(5, 5), (None, 3), (7, None), (-4, 9)])


def test_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(1000, 1300)]
    random.Random(1).shuffle(chain)
    check(spark, chain + [(50, 2000 + k) for k in range(800)])


def test_no_edges(spark):
    check(spark, [])
