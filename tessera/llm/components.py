"""Connected components by alternating large-star and small-star steps over an edge table in the shared folder.

Edge cases: edges from a vertex to itself are left out, and so are vertices without another edge; repeated edges count once; an
empty table gives an empty result; extra columns are ignored. Ends that are null are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spread import materialise


def _forest(batches):
    """Replaces the edges of each batch by a star per component of the batch: fewer edges, the same components."""
    import pyarrow as pa

    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = root.get(p, p)
                x = root[x]
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        at = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([find(x) for x in at], pa.int64())], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (u, v: not null longs), where component is the smallest id reachable.

    Each round writes its edges, so a lost executor costs no more than a round, and ends when a round changes nothing. A hub's
    edges are never in one group: smallest neighbours are found by partial aggregation and joined back.
    """
    e = materialise(edges.select("u", "v").filter("u <> v").mapInArrow(_forest, "u long, v long").distinct())
    for _ in range(most_rounds):
        # large star: every larger neighbour of u moves to u's smallest neighbour (or u)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = materialise(small.filter("u <> v").distinct())
        # done when every vertex has one edge, to a vertex that has none of its own
        if after.groupBy("u").count().filter("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        e = after
    raise RuntimeError("components did not settle")
