import random

from annalist.llm.graph import connected_components


def test_components_of_paths_stars_and_random_edges(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(i, 900) for i in range(800, 850)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (3, 2), (2, 3), (3, 2)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "u int, v int")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in linked)
    assert connected_components(spark.createDataFrame([], "u int, v int")).collect() == []
