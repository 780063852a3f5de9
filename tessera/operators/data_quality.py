"""Checks on data tables: rows that repeat a key, and child rows without a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each key found in more than one row, with its count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total")).filter("total > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Child rows whose foreign key (child column -> parent column) is complete and has no parent row."""
    whole = child.dropna(subset=list(columns))
    keys = parent.select(*(F.col(p).alias(f"_{c}") for c, p in columns.items()))
    return whole.join(keys, [F.col(c) == F.col(f"_{c}") for c in columns], "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    return orphan_rows(child, parent, columns).agg(F.count(F.lit(1)).alias("orphans"))
