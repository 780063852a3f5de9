"""Saved state: merges, versions, writers that fail or come second."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import annotations
from tessera.sources import snapshots as S

SCHEMA = "k string, part int, v long"
CHANGES = "k string, part int, v long, at long, gone boolean"


def rows(spark, path, version=None):
    return sorted(map(tuple, S.read(spark, path, SCHEMA, version).collect()))


def put(spark, path, changes, **kw):
    return S.merge(spark.createDataFrame(changes, CHANGES), path, SCHEMA, ["k", "part"], "at", "gone", buckets=4, **kw)


def test_merges_equal_a_dict(spark, tmp_path):
    path, rng, want, history = f"file://{tmp_path}/t", random.Random(3), {}, {}
    assert rows(spark, path) == [] and S.versions(spark, path) == []
    for version in range(1, 5):
        changes = [(f"k{rng.randrange(30)}", rng.randrange(2), rng.randrange(100), rng.choice([None, 1, 2, 3]), rng.choice([None, False, False, True])) for _ in range(25)]
        assert put(spark, path, changes) == version
        for k, part, v, at, gone in sorted(changes, key=lambda r: (-1 if r[3] is None else r[3], bool(r[4]), f'{{"k":"{r[0]}","part":{r[1]},"v":{r[2]}}}')):
            want[k, part] = None if gone else v
        history[version] = sorted((*k, v) for k, v in want.items() if v is not None)
        assert rows(spark, path) == history[version]
    for version, expected in history.items():
        assert rows(spark, path, version) == expected
    with pytest.raises(ValueError):
        S.read(spark, path, SCHEMA, 9)


def test_writers_that_fail_or_come_second(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    put(spark, path, [("a", 1, 1, 0, False), ("b", 1, 2, 0, False), (None, 1, 7, 0, False)])
    before = rows(spark, path)
    assert before == [("a", 1, 1), ("b", 1, 2)]
    broken = spark.createDataFrame([("a", 1, 5, 1, False)], CHANGES).withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        S.merge(broken, path, SCHEMA, ["k", "part"], "at", "gone")
    assert rows(spark, path) == before and S.versions(spark, path) == [1]
    assert put(spark, path, [("a", 1, 3, 0, False)], based_on=1) == 2
    with pytest.raises(S.Conflict):
        put(spark, path, [("b", 1, 9, 0, False)], based_on=1)
    with pytest.raises(S.Conflict):  # a version that another writer has published meanwhile
        S._Files(spark, path).publish(f"_versions/{2:020d}", "{}")
    assert rows(spark, path) == [("a", 1, 3), ("b", 1, 2)]
    assert put(spark, path, []) == 3 and rows(spark, path) == [("a", 1, 3), ("b", 1, 2)]
    # read, change and write under one path
    again = S.read(spark, path, SCHEMA).withColumns({"v": F.col("v") + 10, "at": F.lit(0), "extra": F.lit("x")})
    assert S.merge(again, path, SCHEMA, ["k", "part"], "at") == 4
    assert rows(spark, path) == [("a", 1, 13), ("b", 1, 12)] and rows(spark, path, 3) == [("a", 1, 3), ("b", 1, 2)]
    assert put(spark, path, [("a", 1, 0, 0, True), ("b", 1, 0, 0, True)]) == 5 and rows(spark, path) == []
    assert put(spark, path, [("c", 0, 1, 0, None)]) == 6
    assert S.prune(spark, path, keep=1) == []  # all are young
    assert S.versions(spark, path) == [6] and len(S.prune(spark, path, keep=1, hours=-1)) == 5 and rows(spark, path) == [("c", 0, 1)]


def test_notes_in_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/notes"
    new = spark.createDataFrame([("a", "t1", "", " hi "), ("b", "t1", "c1", "col")], "id string, table_id string, column_id string, text string")
    notes = annotations.add(annotations.load_saved(spark, path), new, 5)
    annotations.save_changes(notes, path)
    changed = annotations.update(annotations.load_saved(spark, path), spark.createDataFrame([("b", " new ")], "id string, text string"), 9)
    annotations.save_changes(changed, path, gone=new.filter("id = 'a'").select("id"))
    assert [tuple(r) for r in annotations.load_saved(spark, path).collect()] == [("b", "t1", "c1", "new", 5, 9)]
    annotations.save_changes(changed.limit(0), path, gone=new.select("id"))
    assert annotations.load_saved(spark, path).count() == 0
