"""Ways of many pairs against a breadth-first search of each, and what the library leaves behind."""

import os
import random

from tessera import session
from tessera.catalog import Catalog
from tessera.operators import graph


def catalog(spark, n, edges):
    tables = spark.createDataFrame([(i, f"t{i:03d}") for i in range(n)], "table_ord long, table_id string")
    rows = [(o, f"r{o}", f"t{a:03d}", f"t{b:03d}") for o, (a, b) in enumerate(edges)]
    refs = spark.createDataFrame(rows, "ref_ord long, ref_id string, parent_table string, child_table string")
    return Catalog(tables, None, refs, None, None)


def first_way(edges, start, end):
    """Breadth-first, neighbours in the order of their references."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    before, todo = {start: None}, [start]
    for at in todo:
        for b in near.get(at, ()):
            if b not in before:
                before[b] = at
                todo.append(b)
    if end not in before:
        return None
    way = [end]
    while before[way[-1]] is not None:
        way.append(before[way[-1]])
    return way[::-1]


def ways(spark, c, pairs):
    rows = spark.createDataFrame([tuple(None if x is None else f"t{x:03d}" for x in p) for p in pairs], "start string, end string")
    got = graph.shortest_paths(c, rows).collect()
    assert all(r.length == len(r.path) - 1 for r in got) and len({(r.start, r.end) for r in got}) == len(got)
    return {(int(r.start[1:]), int(r.end[1:])): [int(t[1:]) for t in r.path] for r in got}


def test_all_pairs_of_a_graph_with_parts_and_loops(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(30)] + [(3, 3), (30, 31), (31, 30), (31, 32), (33, 33)]
    edges += [(i, 40) for i in range(0, 25, 2)]  # a table that many refer to
    pairs = [(a, b) for a in range(36) for b in range(36)] + [(1, 2), (1, 2)]
    want = {(a, b): w for a, b in pairs if (w := first_way(edges, a, b))}
    assert ways(spark, catalog(spark, 41, edges), [*pairs, (None, 1), (1, None), (None, None)]) == want


def test_a_long_chain_from_both_ends(spark):
    edges = [(i + 1, i) if i % 3 else (i, i + 1) for i in range(14)]
    c = catalog(spark, 20, edges)
    assert ways(spark, c, [(0, 14), (14, 0), (5, 5), (0, 19), (19, 19)]) == {(0, 14): list(range(15)), (14, 0): list(range(14, -1, -1)), (5, 5): [5], (19, 19): [19]}
    single = [r.table_id for r in graph.shortest_path(c, "t000", "t014").orderBy("step").collect()]
    assert single == [f"t{i:03d}" for i in range(15)]


def test_no_pairs_and_no_references(spark):
    assert ways(spark, catalog(spark, 3, []), [(0, 1), (2, 2)]) == {(2, 2): [2]}
    assert ways(spark, catalog(spark, 3, [(0, 1)]), []) == {}


def test_clean_up_leaves_nothing(spark):
    kept = session.cut_lineage(spark.range(10)), session.materialise(spark.range(5))
    assert [f.count() for f in kept] == [10, 5]
    folder = session.checkpoint_folder(spark).removeprefix("file://")
    before = {name for name in os.listdir(folder)}
    assert os.path.basename(session.shared_folder(spark)) in before
    session.clean_up(spark)
    left = [os.path.join(at, f) for at, _, files in os.walk(folder) for f in files]
    assert left == []
