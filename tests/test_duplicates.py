"""Duplicate tables against a version that scores every pair."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

from tessera.catalog import Catalog
from tessera.operators import duplicates

WORDS = "order line customer stock".split()


def grams(t):
    return {f"#{t}#"[i : i + 3] for i in range(len(t))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def every_pair(tables):
    """tables: (id, name, code, comment, [(column code, type)]); words of the pool are their own canonical form."""
    out = {}
    terms = lambda s: {w for w in re.split("[^a-z0-9]+", s.lower()) if len(w) > 1}
    for i, (a, *x) in enumerate(tables):
        for b, *y in tables[i + 1 :]:
            names = [terms(f"{n} {c} {m or ''}") for n, c, m, _ in (x, y)]
            keys = [{"+".join(sorted(terms(c))): t.lower() for c, t in cols} for *_, cols in (x, y)]
            words = [n.union(*(terms(c) for c, _ in cols)) for n, (*_, cols) in zip(names, (x, y))]
            plain = [re.sub("[^a-z0-9]", "", c.lower()) for _, c, _, _ in (x, y)]
            g = [grams(p) for p in plain]
            dice = 1.0 if plain[0] == plain[1] else 0.0 if not all(plain) else 2 * len(g[0] & g[1]) / (len(g[0]) + len(g[1]))
            j = jaccard(*names)
            shared = keys[0].keys() & keys[1].keys()
            columns = 0.5 * len(shared) / max(len(keys[0]), len(keys[1]), 1) + 0.5 * jaccard(*words)
            types = sum(keys[0][k] == keys[1][k] for k in shared) / len(shared) if shared else 0.0
            score = 0.45 * max(j, 0.6 * dice + 0.4 * j) + 0.45 * columns + 0.1 * types
            if score >= 0.55:
                out[(a, b)] = (float(Decimal(repr(score)).quantize(Decimal("0.001"), ROUND_HALF_UP)), "high" if score >= 0.72 else "medium")
    return out


def catalog(spark, tables):
    t = spark.createDataFrame([(i, a, c, n, m) for i, (a, n, c, m, _) in enumerate(tables)], "table_ord long, table_id string, code string, name string, comment string")
    cols = [(a, k, f"{a}-{k}", c, c, kind) for a, *_, columns in tables for k, (c, kind) in enumerate(columns)]
    columns = spark.createDataFrame(cols, "table_id string, col_ord long, column_id string, code string, name string, data_type string")
    none = spark.createDataFrame([], "table_id string")
    return Catalog(t, columns, none, none, none)


def found(spark, tables):
    return {(r.table_a, r.table_b): (r.score, r.verdict) for r in duplicates.duplicate_tables(catalog(spark, tables)).collect()}


def test_all_pairs_are_judged(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PART", 3)  # most terms are cut into blocks
    rng = random.Random(11)
    tables = []
    for i in range(70):
        pick = lambda n: "_".join(rng.choice(WORDS) for _ in range(n))
        cols = [(pick(rng.choice([1, 1, 2])), rng.choice(["INT", "int", "DATE"])) for _ in range(rng.randrange(0, 5))]
        tables.append((f"t{i}", pick(1), rng.choice([pick(2), pick(1).upper(), "__", pick(1) + str(i % 3)]), rng.choice([None, "", pick(2)]), cols))
    want = every_pair(tables)
    assert len(want) > 60 and found(spark, tables) == want


def test_names_and_comments_belong_to_the_vocabulary(spark):
    cols = [("id", "INT"), ("email", "TEXT")]
    assert found(spark, [("a", "Alpha", "Alpha", None, cols), ("b", "Beta", "Beta", None, cols)]) == {}
    same = [("a", "Alpha", "Alpha", "customer master data", cols), ("b", "Beta", "Beta", "customer master data", cols)]
    assert found(spark, same) == every_pair(same) != {}
    assert found(spark, []) == {} and found(spark, same[:1]) == {}
