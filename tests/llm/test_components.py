import random

from auditlake.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_against_union_find(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 501 + i) for i in range(40)]
    some = [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    edges = [e for e in path + star + some if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:9] + [(b, a) for a, b in edges[:9]] + [(7, 7), (None, 3)], "a long, b long")
    assert sorted(tuple(r) for r in components(df).collect()) == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
