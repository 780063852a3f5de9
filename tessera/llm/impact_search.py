"""Exact top-k search by inner product over an impact-ordered index, a score at a time.

Index: rows are cut into shards of bounded size. A shard keeps, for every dimension, its rows in segments by quantised
component, highest first. The table of shards is written to the shared folder.

Search: a query's segments of a shard are taken in the order of the highest product that they can hold with the query's component, over all
dimensions. Each adds that bound to its rows' scores and counts the dimension as seen. As the products come in falling order,
whatever a row has not been seen in adds at most the next segment's bound, so

    bound of a row = what was added + unseen dimensions * next segment's bound.

The best rows so far are scored exactly; their k-th best is the mark to reach. Rows whose bound is below the mark are proven not to be among
the k best. The search of a shard ends only when half of its rows or more are ruled out, or no segment is left; the other ones, possible
members, are then all scored exactly in integers.

One shard in 64 is searched first, and its k-th best score is where the others begin: so from all other shards together a query gets some 64 * k
rows back, however many shards there are. Queries travel in blocks and meet each shard in a task of bounded size.

Edge cases: vectors that are null or empty, or hold a null or non-finite component, take no part, nor do null ids; components are
bounded so that scores fit a long; vectors of different lengths are compared over the shorter; of several query rows with one id the
least vector counts; several rows with one id are all candidates, but never for a query of that id; ties go to the smaller id; a query with fewer than k
candidates gets them all; extra columns are ignored; an empty table or no query gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .spread import materialise, parts, small_batches

#: Components a shard, queries a block, one shard in HEAD is searched first, about LEVELS segments a dimension.
SHARD, BLOCK, HEAD, LEVELS = 1 << 20, 256, 64, 64
MOST, LEAST = float(1 << 25), -(1 << 62)
INDEX = "shard long, dims int, ids binary, x binary, rows binary, of binary, lows binary, starts binary, width long"
BLOCKS = "block long, q_dims int, q binary, q_ids binary, marks binary"
FOUND = "query_id long, vec_id long, score long"


def one_row(values: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, t in zip(values, kinds)], list(names))


def integer_rows(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): the usable vectors, each component times scale and rounded down."""
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(e, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))).cast("int"))
    fine = F.coalesce((F.size(e) > 0) & ~odd, F.lit(False)) & F.col("vec_id").isNotNull()
    return rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def runs_of_length(batches, most: int, columns: tuple[str, ...]):
    """Gathers rows by the length of x into runs of at most `most` components: (number in the task, x as a matrix, the other columns)."""
    waiting: dict[int, list] = {}
    count = 0
    for batch in batches:
        size = batch.column("x").value_lengths().to_numpy()
        for n in np.unique(size).tolist():
            part = batch.take(pa.array(np.flatnonzero(size == n)))
            x = part.column("x").flatten().to_numpy().reshape(-1, n)
            other = [part.column(c).to_numpy(zero_copy_only=False) for c in columns]
            have = waiting.setdefault(n, [])
            have.append((x, *other))
            limit = max(1, most // n)
            while sum(len(h[0]) for h in have) >= limit:
                whole = [np.concatenate(c) for c in zip(*have)]
                yield count, *(c[:limit] for c in whole)
                count += 1
                have[:] = [tuple(c[limit:] for c in whole)] if len(whole[0]) > limit else []
    for have in waiting.values():
        if have:
            yield count, *(np.concatenate(c) for c in zip(*have))
            count += 1


def shard_row(number: int, x: np.ndarray, ids: np.ndarray) -> dict:
    """A shard as its row of the index."""
    low, high = int(x.min()), int(x.max())
    width = max(1, -(-(high - low + 1) // LEVELS))
    level = (x - low) // width
    order, of, lows, starts = np.empty(x.shape[::-1], np.int32), [], [], []
    for d in range(x.shape[1]):
        order[d] = np.argsort(-level[:, d], kind="stable")
        falling = level[order[d], d]
        at = np.flatnonzero(np.concatenate([[True], falling[1:] != falling[:-1]]))
        of.append(np.full(len(at), d))
        lows.append(low + falling[at].astype(np.int64) * width)
        starts.append(at + d * len(x))
    of, lows, starts = (np.concatenate(a).astype(np.int64).tobytes() for a in (of, lows, [*starts, [x.size]]))
    own = {"ids": ids.astype(np.int64).tobytes(), "x": x.astype(np.int32).tobytes(), "rows": order.tobytes()}
    return {"shard": number, "dims": x.shape[1], **own, "of": of, "lows": lows, "starts": starts, "width": width}


def build_index(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The shards of rows (vec_id, x), written to the shared folder. ids and x are a shard's rows; rows holds the row
    numbers of its segments, one after the other, and for every segment there are its dimension (of), its lowest component and its start in rows."""
    size = rows.agg(F.sum(F.size("x"))).first()[0] or 0
    tasks = max(1, min(-(-size // shard), 8 * parts(rows.sparkSession)))

    def build(batches):
        task = TaskContext.get().partitionId()
        for number, x, ids in runs_of_length(batches, shard, ("vec_id",)):
            yield one_row(list(shard_row(number * tasks + task, x, ids).values()), INDEX)

    return materialise(rows.repartition(tasks).mapInArrow(build, INDEX))


def query_blocks(queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, q_dims, q, q_ids, marks) from queries (vec_id, x, mark), at most about `block` of one length in each."""
    tasks = max(1, min(-(-queries.count() // block), 8 * parts(queries.sparkSession)))

    def gather(batches):
        task = TaskContext.get().partitionId()
        for number, x, ids, marks in runs_of_length(batches, block * 64, ("vec_id", "mark")):
            raw = [x.astype(np.int32).tobytes(), ids.astype(np.int64).tobytes(), marks.astype(np.int64).tobytes()]
            yield one_row([number * tasks + task, x.shape[1], *raw], BLOCKS)

    return materialise(queries.repartition(tasks).mapInArrow(gather, BLOCKS))


class Shard:
    """A shard's rows and segments in memory."""

    def __init__(self, row: dict):
        self.ids, self.x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.int32).reshape(-1, row["dims"])
        self.rows, self.starts = np.frombuffer(row["rows"], np.int32).astype(np.int64), np.frombuffer(row["starts"], np.int64)
        self.dim, self.low = np.frombuffer(row["of"], np.int64), np.frombuffer(row["lows"], np.int64)
        self.width = row["width"] - 1
        self.high = self.low + self.width
        self.highs = np.repeat(self.high, np.diff(self.starts))  # by entry
        self.first = np.searchsorted(self.dim, np.arange(row["dims"] + 1))
        self.doubles, self.most = self.x.astype(float), int(np.abs(self.x).max())
        self.added = 0  # entries of segments that searches have added so far

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(q).max()) * len(q) < 1 << 52:  # products of doubles are exact
            return (self.doubles[at] @ q.astype(float)).astype(np.int64)
        return self.x[at].astype(np.int64) @ q

    def best(self, q_id: int, q: np.ndarray, k: int, mark: int, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for q, of those of at least `mark`; rows with the query's id are left out."""
        n, dims = self.x.shape
        q = np.concatenate([q[:dims], np.zeros(max(0, dims - len(q)), np.int64)])
        up = q[self.dim] >= 0
        bound = q[self.dim] * np.where(up, self.high, self.low)
        order = np.argsort(-bound, kind="stable")
        falling, of = bound[order], self.dim[order]
        sums, seen, taken = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(dims, np.int64)
        exact_doubles = dims < 1 << 16 and max(abs(int(falling[0])), abs(int(falling[-1]))) * dims < 1 << 36
        own, possible, done = self.ids == q_id, None, 0
        # proofs are tried as the next bound falls to these shares of the first, and then at every sixth of what is left
        shares = np.searchsorted(-falling, -falling[0] * np.array([0.25, 0.0]), side="right") if falling[0] > 0 else [0]
        tries = sorted({*map(int, shares), *np.linspace(max(shares), len(order), 7).astype(int).tolist()} - {0})
        for stop in tries:
            # segments of a dimension are taken from its highest component down, or from its lowest up if the query's is negative
            now = taken + np.bincount(of[done:stop], minlength=dims)
            pieces = []
            for d in np.flatnonzero(now > taken).tolist():
                ends = (self.first[d] + taken[d], self.first[d] + now[d]) if q[d] >= 0 else (self.first[d + 1] - now[d], self.first[d + 1] - taken[d])
                a, b = self.starts[ends[0]], self.starts[ends[1]]
                pieces.append((self.rows[a:b], (self.highs[a:b] - (0 if q[d] >= 0 else self.width)) * q[d]))
            rows, value = (np.concatenate(c) for c in zip(*pieces))
            self.added += len(rows)
            if exact_doubles:  # a bound and a count share a number
                both = np.bincount(rows, value * 65536.0 + 1.0, n).astype(np.int64)
                sums += both >> 16
                seen += both & 65535
            else:
                np.add.at(sums, rows, value)
                seen += np.bincount(rows, minlength=n)
            taken, done = now, stop
            most = sums + (dims - seen) * (falling[done] if done < len(falling) else 0)
            most[own] = LEAST
            # the best so far, scored exactly, raise the mark
            lead = np.argpartition(-most, min(4 * k, n) - 1)[: 4 * k]
            lead = lead[~own[lead]]
            if len(lead) >= k:
                mark = max(mark, int(np.partition(self.exact(lead, q), len(lead) - k)[len(lead) - k]))
            possible = np.flatnonzero((most >= mark) & ~own)
            if len(possible) <= max(few, n // 2):  # scoring them takes a fraction of adding the segments that are left
                break
        score = self.exact(possible, q)
        top = np.lexsort((self.ids[possible], -score))[:k]
        top = top[score[top] >= mark]
        return self.ids[possible[top]], score[top]


def search_shards(index: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): from every shard what may be among a query's k best."""
    last_shard, last_block = (df.agg(F.max(name)).first()[0] for df, name in ((index, "shard"), (blocks, "block")))
    if last_shard is None or last_block is None:
        return index.sparkSession.createDataFrame([], FOUND)
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_block).cast("long"))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_shard).cast("long"))))

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                q = np.frombuffer(row["q"], np.int32).reshape(-1, row["q_dims"]).astype(np.int64)
                ids, marks = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["marks"], np.int64)
                found = [shard.best(int(i), x, k, int(m)) for i, x, m in zip(ids, q, marks)]
                whose = np.repeat(ids, [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(whose), *(pa.array(np.concatenate(c)) for c in zip(*found))], ["query_id", "vec_id", "score"])

    return left.join(right, ["shard", "block"]).mapInArrow(compare, FOUND)


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query (vec_id, embedding) the k rows with the highest inner products, exactly."""
    spark = rows.sparkSession
    index = build_index(integer_rows(rows, scale), shard)
    asked = integer_rows(queries, scale).groupBy("vec_id").agg(F.min("x").alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a query's rows to rank: k from each of the first shards, and of the others what reaches the mark
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    with small_batches(spark, 2):
        early = materialise(search_shards(index.filter(F.col("shard") % head == 0), query_blocks(asked.withColumn("mark", F.lit(LEAST)), block), k))
        marks = ranked(early).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("mark"))
        marked = asked.join(marks, "vec_id", "left").withColumn("mark", F.coalesce("mark", F.lit(LEAST)))
        late = materialise(search_shards(index.filter(F.col("shard") % head != 0), query_blocks(marked, block), k))
    return ranked(early.union(late)).select("query_id", "rank", "vec_id", "score")
