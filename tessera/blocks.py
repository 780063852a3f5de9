"""Vectors in blocks: rows packed into matrices of bounded size, blocks met in pairs, and sums of large arrays over tasks.

Edge cases: an empty table has no blocks and no sums; rows whose vectors differ in length go to different blocks and never meet; ids are not null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .session import materialise

BLOCKS = "block long, dims int, ids binary, x binary"


def _runs(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most `components` numbers, rows of one length in each."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        size = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(size).tolist():
            part = batch.take(pa.array(np.flatnonzero(size == n)))
            have, most = waiting.setdefault(n, []), max(1, components // max(1, n))
            have.append((part.column("id").to_numpy(), part.column("x").flatten().to_numpy().reshape(-1, n)))
            while sum(len(ids) for ids, _ in have) >= most:
                ids, x = (np.concatenate(c) for c in zip(*have))
                yield ids[:most], x[:most]
                have[:] = [(ids[most:], x[most:])] if len(ids) > most else []
    for have in waiting.values():
        if have:
            yield tuple(np.concatenate(c) for c in zip(*have))


def packed(rows: DataFrame, components: int) -> DataFrame:
    """(block, dims, ids, x) from rows (id long, x array<double>), written to the shared folder."""
    size = rows.agg(F.sum(F.size("x"))).first()[0] or 0
    tasks = max(1, min(-(-size // components), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def pack(batches):
        task = TaskContext.get().partitionId()
        for i, (ids, x) in enumerate(_runs(batches, components)):
            values = [(i * tasks + task, pa.int64()), (x.shape[1], pa.int32()), (ids.astype(np.int64).tobytes(), pa.binary()), (x.astype(np.float64).tobytes(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["block", "dims", "ids", "x"])

    return materialise(rows.repartition(tasks).mapInArrow(pack, BLOCKS))


def met(left: DataFrame, right: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """What compare(left ids, left matrix, right ids, right matrix) returns, as columns of the schema, for every pair of a block of left
    and one of right that have vectors of one length. A pair is one row of a shuffle, so tasks and their memory stay of one size."""
    ends = [df.agg(F.max("block")).first()[0] for df in (left, right)]
    if None in ends:
        return left.sparkSession.createDataFrame([], schema)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    a = left.toDF("a", "dims", "a_ids", "a_x").withColumn("b", to(ends[1]))
    b = right.toDF("b", "dims", "b_ids", "b_x").withColumn("a", to(ends[0]))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                side = [(np.frombuffer(row[f"{s}_ids"], np.int64), np.frombuffer(row[f"{s}_x"]).reshape(-1, row["dims"])) for s in "ab"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in compare(*side[0], *side[1])], names)

    return a.join(b, ["a", "b", "dims"]).mapInArrow(run, schema)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, components: int = 1 << 20, few: int = 64) -> DataFrame:
    """(q_id, vec_id, score): for every query (vec_id, embedding) the k nearest of all rows, itself left out; ties by vec_id. Scores are
    rounded to six digits; a zero vector has 0 with all; vectors of other lengths or without a number don't meet.

    Both sides are packed into blocks; a pair of blocks is a matrix product in a task, which keeps each query's k best of the
    block, ties by vec_id; the k best of all are taken from these. A task scores `few` queries at a time, so that scores take no more memory than
    the vectors do. Nothing is collected to the driver."""
    fine = "embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))"
    sides = [df.filter(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")) for df in (queries, vectors)]

    def best(q_ids, q, ids, x):
        x = _unit(x).T
        found = [of_few(q_ids[i : i + few], q[i : i + few], ids, x) for i in range(0, len(q_ids), few)]
        return tuple(np.concatenate(c) for c in zip(*found))

    def of_few(q_ids, q, ids, x):
        s = np.round(_unit(q) @ x, 6) + 0.0
        s[q_ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:  # ties with the k-th best stay until ids settle them
            s[s < np.partition(s, len(ids) - k, axis=1)[:, [len(ids) - k]]] = -np.inf
        r, c = np.nonzero(np.isfinite(s))
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[rank < k], c[rank < k]
        return q_ids[r], ids[c], s[r, c]

    near = met(packed(sides[0], block * 64), packed(sides[1], components), best, "q_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def summed(partial: DataFrame) -> dict[int, np.ndarray]:
    """Sums by block of partial (block int, data binary of doubles), a row a block and task: first within lanes of tasks, then over lanes,
    so that no task reads more than the square root of all rows of a block. What reaches the driver is one row a block."""
    lanes = max(1, math.isqrt(partial.rdd.getNumPartitions()))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                x = np.frombuffer(data)
                total[b] = total[b] + x if b in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    once = partial.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).repartition("block", "lane").select("block", "data").mapInArrow(add, schema)
    return {r.block: np.frombuffer(r.data) for r in once.repartition("block").mapInArrow(add, schema).collect()}
