"""tables that many others meet are compared in blocks; no pair is written down before it is known to be one."""

import random

from tessera.operators import duplicates
from tests.test_duplicates import WORDS, catalog, every_pair


def test_tables_compared_in_blocks(spark, monkeypatch, capsys):
    monkeypatch.setattr(duplicates, "PART", 12)  # some elements are posted by more tables, some by fewer
    monkeypatch.setattr(duplicates, "BLOCK", 32)
    rng = random.Random(12)
    words = [*WORDS, *(f"w{chr(97 + i)}" for i in range(12))]
    tables = []
    for i in range(90):
        pool = words if i % 3 else WORDS
        pick = lambda n: "_".join(rng.choice(pool) for _ in range(n))  # noqa: E731, B023
        cols = [(pick(rng.choice([1, 1, 2])), rng.choice(["INT", "int", "DATE"])) for _ in range(rng.randrange(0, 5))]
        tables.append((f"t{i}", pick(1), rng.choice([pick(2), pick(1).upper(), "__", pick(1) + str(i % 3)]), rng.choice([None, "", pick(2)]), cols))
    want = every_pair(tables)
    got = duplicates.duplicate_tables(catalog(spark, tables), ordered=False)
    rows = got.collect()
    assert len(want) > 40 and len(rows) == len(want) and {(r.table_a, r.table_b): (r.score, r.verdict) for r in rows} == want
    capsys.readouterr()
    got.explain()
    assert "rangepartitioning" not in capsys.readouterr().out


def test_tiles_of_blocks(spark, monkeypatch):
    """Whatever the sizes of tiles and of matrices."""
    monkeypatch.setattr(duplicates, "TILE", 7)
    monkeypatch.setattr(duplicates, "WIDE", 3)
    import pyarrow as pa

    rng = random.Random(13)
    sets = {k: [rng.sample("abcdefghijkl", rng.randrange(5, 11)) for _ in range(40)] for k in duplicates.COUNTED}
    packed = [duplicates._pack(pa.table({"x": [0] * 20, "table_ord": list(range(lo, 40, 2)), "table_id": [f"t{i}" for i in range(lo, 40, 2)], **{k: v[lo::2] for k, v in sets.items()}})) for lo in (0, 1)]
    row = pa.table({"lo": [0], "hi": [1], **{f"{n}_{s}": t.column(n) for s, t in zip("ab", packed) for n in t.column_names if n != "x"}})
    found = [r for b in duplicates._compared(iter(row.to_batches())) for r in b.to_pylist()]
    assert len({(r["ord_a"], r["ord_b"]) for r in found}) == len(found) > 10
    for r in found:
        a, b = r["ord_a"], r["ord_b"]
        common = lambda k: len({*sets[k][a]} & {*sets[k][b]})  # noqa: E731, B023
        assert a < b and (a - b) % 2 and (r["table_a"], r["table_b"]) == (f"t{a}", f"t{b}")
        assert [r["grams"], r["names"], r["words"], r["exact"], r["alike"]] == [common(k) for k in duplicates.COUNTED]
        assert r["largest"] == max(len(sets["keys"][a]), len(sets["keys"][b]), 1) and r["words_both"] == len(sets["vocabulary"][a]) + len(sets["vocabulary"][b])
