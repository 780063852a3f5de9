"""Cycles are numbered by counts and listed in pieces, whatever the pieces' size."""

import random

from tessera.operators import graph
from tests.test_metadata import chain, walk


def test_cycles_in_pieces(spark):
    rng = random.Random(5)
    edges = [(2 * rng.randrange(9) + k, 2 * rng.randrange(9) + k) for k in range(2) for _ in range(24)]
    rng.shuffle(edges)
    c = chain(spark, [(f"t{a}", f"t{b}") for a, b in edges], 18)
    found = graph.fk_cycles(c.tables, c.refs, piece=3).collect()
    assert [r.tables for r in sorted(found, key=lambda r: r.cycle)] == walk(18, edges)
    assert sorted(r.cycle for r in found) == list(range(len(found)))


def test_pieces_of_a_walk_are_listed_alone(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(graph, "WHOLE_TRAIL", 1)
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)]
    rows = [("model", "t0", 0, i, f"t{i}", None) for i in range(30)] + [("model", "t0", 1, i, f"t{a}", f"t{b}") for i, (a, b) in enumerate(edges) if a != b]
    found = graph._walk(pd.DataFrame(rows, columns=["model_id", "part", "kind", "rank", "a", "b"]), 20)
    assert found.piece.nunique() > 3 and found.added.map(len).sum() < sum(map(len, walk(30, edges)))
    listed = pd.concat(x for _, p in found.groupby("piece") for x in graph._listed(iter([p[["model_id", "at", "keep", "first", "added"]]])))
    assert listed.tables.tolist() == walk(30, edges)
