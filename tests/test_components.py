import random

from vellumgrid.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_graph_and_long_path(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(80), 100 + rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(300, 340)] + [(500, 501), (501, 500)]
    rows = [*edges, (7, 7), (None, 3), (4, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
