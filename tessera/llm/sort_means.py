"""Centroid clustering by sort-means over integer vectors.

In each round the other centroids are ordered by their distance from each centroid. A vector starts at the centroid that it was
assigned to before, goes through the others in that one's order, and stops at the first that lies strictly beyond twice the
vector's distance from its start: by the triangle inequality that one and all after it are farther away than the start. One at just
twice the distance may tie, and ties go to the smaller number, so it is looked at. All distances are squared integers, so every comparison and
every mean is exact and doesn't depend on how the table is split.

A round is one pass over the vectors: tasks sum their vectors by centroid and Spark adds up these sums, so only k sums reach the driver.
Between rounds no table of vectors is written: where a vector was before is worked out in the same pass from the earlier rounds' centroids,
a scan that mostly ends after a centroid or two. Every `replay` rounds assignments are written instead, so that passes stay short.

Edge cases: vectors that are null, of another length, or hold a null or non-finite component are left out; components are
bounded so that squared distances fit a long (2**25 for 64 components); repeated rows count each; a null id stays null and is hashed as the
empty text; with fewer than k vectors there are as many centroids; of equal centroids the first takes all and the others stay; an
inertia beyond a long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spread import materialise

ASSIGNED = "vec_id long, cluster int, distance long"


def integer_vectors(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors of `size` finite components, each times scale and rounded down."""
    e, most = F.col("embedding"), float((1 << 28) // max(1, math.isqrt(size)))
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(e, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("int"))
    return rows.filter(F.coalesce((F.size(e) == size) & ~odd, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, before: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, scanned from the one it was assigned to before."""
    at, best = before.copy(), np.empty(len(x), np.int64)
    for own in np.unique(before).tolist():
        between = squared(c, c[own])
        order = np.argsort(between, kind="stable")
        rows = np.flatnonzero(before == own)
        start = squared(x[rows], c[own])
        # farthest first, so that those still scanning are the first ones
        far = np.argsort(-start, kind="stable")
        rows, start = rows[far], start[far]
        found, number = start.copy(), np.full(len(rows), own)
        for j in order[order != own].tolist():
            scanning = int(np.searchsorted(-4 * start, -between[j], side="right"))
            if not scanning:
                break
            d = squared(x[rows[:scanning]], c[j])
            nearer = (d < found[:scanning]) | (d == found[:scanning]) & (j < number[:scanning])
            found[:scanning][nearer], number[:scanning][nearer] = d[nearer], j
        at[rows], best[rows] = number, found
    return at, best


def replayed(x: np.ndarray, start: np.ndarray, rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Assignment after the given rounds' centroids, one after the other."""
    at, best = start, np.empty(0, np.int64)
    for c in rounds:
        at, best = nearest(x, at, c)
    return at, best


def cluster_sums(state: DataFrame, rounds: list[np.ndarray], size: int) -> list:
    """A row for each centroid with vectors: its number, their count, and the exact sums of their components."""

    def add_up(batches):
        k = len(rounds[0])
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"))
            at, _ = replayed(x, batch.column("start").to_numpy().astype(np.int64), rounds)
            for j in np.unique(at).tolist():
                mine = x[at == j]
                n[j] += len(mine)
                total[j] += mine.sum(0)
        some = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), sums], ["cluster", "n", "sums"])

    partial = state.mapInArrow(add_up, "cluster int, n long, sums array<long>")
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums")).collect()


def assign(state: DataFrame, rounds: list[np.ndarray], keep_vectors: bool = False) -> DataFrame:
    """(vec_id, cluster, distance), or with keep_vectors (vec_id, x, start) as the next rounds take it."""

    def run(batches):
        for batch in batches:
            at, best = replayed(matrix(batch.column("x")), batch.column("start").to_numpy().astype(np.int64), rounds)
            at = pa.array(at.astype(np.int32))
            if keep_vectors:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), at], ["vec_id", "x", "start"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), at, pa.array(best)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, x array<int>, start int" if keep_vectors else ASSIGNED)


def sort_means(rows: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, replay: int = 8) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector of rows (vec_id, embedding), written to the shared folder, and the centroids, which
    are k times size numbers. Centroids start as the k vectors with the least sha256 of `seed:vec_id`."""
    kept = integer_vectors(rows, size, scale)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(by.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    c = np.array([r.x for r in first], np.int64).reshape(len(first), size)
    state, done = kept.withColumn("start", F.lit(0)), []
    for _ in range(rounds if len(c) else 0):
        done.append(c)
        c = c.copy()
        for r in cluster_sums(state, done, size):
            c[r.cluster] = [s // r.n for s in r.sums]
        if len(done) == replay:
            state, done = materialise(assign(state, done, keep_vectors=True)), []
    assigned = assign(state, [*done, c]) if len(c) else kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return materialise(assigned), c


def cluster_report(rows: DataFrame, **settings) -> DataFrame:
    """The assignment of `sort_means` with cluster_inertia and inertia (sums of distance over the cluster and over all) and
    centroid_sha256, the digest of the centroid's numbers. What is broadcast has one row a centroid."""
    assigned, c = sort_means(rows, **settings)
    spark = rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(c.tolist())]
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    each = {r.cluster: r.cluster_inertia for r in sums}
    total = None if None in each.values() else sum(each.values())
    total = total if total is not None and total < 2**63 else None
    about = spark.createDataFrame([(j, each.get(j), total, d) for j, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
