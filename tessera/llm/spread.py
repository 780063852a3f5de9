"""Spark helpers that the operators share.

Edge cases: `spread_join` takes keys that are null as a join does (they meet nothing); `vector_sum` of no rows is None;
`materialise` of an empty table gives an empty table of the same columns; columns of any name are carried along, but for hot_
and salt_ in `spread_join`, which only gets tables that the operators have made.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import clean_up, materialise, shared_folder

__all__ = ["as_written", "buckets_for", "clean_up", "let", "materialise", "parts", "salted_join", "shared_folder", "small_batches", "spread_join", "vector_sum"]


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_written(docs: DataFrame) -> DataFrame | None:
    """The rows of Parquet files that Spark has written, in the order of its parts and of the rows in them; None where docs come from no file."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    except AnalysisException:
        return None
    order = [F.coalesce(F.regexp_extract("file_", r"^part-(\d+)", 1).try_cast("long"), F.lit(-1)), F.col("file_"), F.col("row_")]
    return placed.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).drop("file_", "row_")


def buckets_for(docs: DataFrame, bytes_each: int) -> int:
    """Buckets of about bytes_each bytes of text, so that what meets in one has a bounded size; at least one a shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-size // bytes_each))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once, also where `use` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spread_join(rows: DataFrame, groups: DataFrame, by: list[str], spread_by: list[str], ways: int = 64) -> DataFrame:
    """rows joined with groups, which has one row for each value of `by` and n, its number of rows.

    A value with more than one in 1024 of all rows is hot: there are at most 1024 of these, so the list of them is broadcast;
    their rows are salted by a hash of spread_by over several tasks, and their group is sent to each of them."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col("n") * 1024 > total).select(*by, F.lit(True).alias("hot_")))
    salt = F.when(F.col("hot_"), F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, by, "left").withColumn("salt_", salt).drop("hot_")
    right = groups.join(hot, by, "left").withColumn("salt_", F.explode(copies)).drop("hot_")
    return left.join(right, [*by, "salt_"]).drop("salt_")


def salted_join(rows: DataFrame, groups: DataFrame, by: list[str], spread_by: list[str], ways: int = 64) -> DataFrame:
    """What `spread_join` gives, where rows are many times the result: the hot values, 1024 at most, are told by their hashes in an
    expression, so rows meet nothing before the one join. A value whose hash is that of a hot one is salted too, on both sides."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    hashes = [r.h for r in groups.filter(F.col("n") * 1024 > total).select(F.xxhash64(*by).alias("h")).collect()]
    hot = F.xxhash64(*by).isin(hashes) if hashes else F.lit(False)
    salt = F.when(hot, F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int")).otherwise(0)
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    left, right = rows.withColumn("salt_", salt), groups.withColumn("salt_", F.explode(copies))
    return left.join(right, [*by, "salt_"]).drop("salt_")


def _add_up(batches):
    total: list[np.ndarray] | None = None
    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = kinds or list(batch.schema.names)
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            row = [np.frombuffer(x, np.float64) for x in row]
            total = [x.copy() for x in row] if total is None else [a + b for a, b in zip(total, row)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], kinds)


def vector_sum(df: DataFrame, tasks: int | None = None) -> list[np.ndarray] | None:
    """Sums rows of fixed-length float64 vectors (binary columns), about one row a task, in two levels: no task adds more
    than the square root of the number of rows. Only the one summed row reaches the driver."""
    n = tasks or df.rdd.getNumPartitions()
    width = max(1, math.isqrt(n))
    once = df.repartition(width).mapInArrow(_add_up, df.schema) if n > 8 else df
    rows = once.repartition(1).mapInArrow(_add_up, df.schema).collect()
    return [np.frombuffer(x, np.float64) for x in rows[0]] if rows else None
