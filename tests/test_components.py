"""Strongly connected parts against brute-force versions."""

import random

from tessera.operators import graph


def frame(spark, edges):
    return spark.createDataFrame([("m", f"t{a:05d}", f"t{b:05d}") for a, b in edges], "model_id string, a string, b string")


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    ends = {x for a, b in edges if a != b for x in (a, b)}
    to = {a: reached(a) for a in ends}
    return {a: min([a, *(b for b in to[a] if a in to[b])]) for a in ends}


def found(spark, edges):
    return {int(r.a[1:]): int(r.component[1:]) for r in graph.strong_components(frame(spark, edges)).collect()}


def test_strong_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(48)] + [(100, 101), (101, 102), (102, 100), (110, 111), (111, 110), (120, 121), (130, 130), (121, 100)]
    edges += [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(5, 205), (300, 301), (301, 302)]
    assert found(spark, edges) == brute(edges)


def test_chains_and_rings(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n + order[i], n + order[(i + 1) % n]) for i in range(n)]
    got = found(spark, edges)
    assert all(got[i] == i for i in range(n)) and {got[n + i] for i in range(n)} == {n} and len(got) == 2 * n


def test_no_edges(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1)]) == {}
