import random

from arbora.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in edges:
        if x is None or y is None or x == y:
            continue
        for v in (x, y):
            parent.setdefault(v, v)
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def run(spark, edges, **kw):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x string, y string"), **kw).collect()}


def test_random_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        edges = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(220)]
        assert run(spark, edges, seed=seed) == brute(edges)


def test_chain_star_and_dirt(spark):
    edges = [(f"c{i:04}", f"c{i + 1:04}") for i in range(400)] + [("hub", f"leaf{i}") for i in range(200)]
    edges += [("a", "a"), (None, "b"), ("b", None), ("q", "p"), ("p", "q"), ("q", "p")]
    random.Random(0).shuffle(edges)
    assert run(spark, edges) == brute(edges)


def test_byte_order_of_names(spark):
    assert run(spark, [("9-z", "10-a"), ("10-a", "Z")]) == {"9-z": "10-a", "10-a": "10-a", "Z": "10-a"}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a")]) == {}
    df = spark.createDataFrame([("a", "b", "x", 1, "c")], "x string, y string, node string, id int, component string")
    assert {r.node for r in connected_components(df).collect()} == {"a", "b"}
    numbers = spark.createDataFrame([(2, 10), (10, 3)], "x int, y int")
    assert {r.component for r in connected_components(numbers).collect()} == {"10"}
