"""Notes on tables and columns, and the saved severities of lint rules: read, changed as DataFrames, written as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import snapshots
from .lint import PENALTY, RULES

SCHEMA = "id string, tableId string, columnId string, text string, createdAt long, updatedAt long"
NAMES = ["id", "table_id", "column_id", "text", "created_at", "updated_at"]
SAVED = "id string, table_id string, column_id string, text string, created_at long, updated_at long"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, table_id, column_id, text, created_at, updated_at) of JSON files with an object, or a list of them, a line; entries
    that don't fit, or lack an id, a table or a text, are left out."""
    found = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return found.toDF(*NAMES).filter("id IS NOT NULL AND table_id IS NOT NULL AND text IS NOT NULL")


def save(annotations: DataFrame, path: str) -> None:
    """Writes all notes in place of those under path. The notes must not come from path itself."""
    annotations.select(NAMES).toDF(*(f.split()[0] for f in SCHEMA.split(", "))).write.mode("overwrite").json(path)


def load_saved(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The notes of a store that `save_changes` writes, as of a version or the latest; none where there is no store yet."""
    return snapshots.read(spark, path, SAVED, version)


def save_changes(annotations: DataFrame, path: str, gone: DataFrame | None = None, based_on: int | None = None) -> int:
    """Merges notes into the store under path by their id and publishes the next version, whose number it returns; those whose
    ids are in `gone` (id) go. The notes may come from path itself. Of notes with one id the last updated counts."""
    changes = annotations.select(*NAMES, F.lit(False).alias("is_gone"))
    if gone is not None:
        lost = gone.select("id", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SAVED.split(", ")[1:-1]), F.lit(2**63 - 1).alias("updated_at"), F.lit(True).alias("is_gone"))
        changes = changes.unionByName(lost)
    return snapshots.merge(changes, path, SAVED, ["id"], "updated_at", "is_gone", based_on)


def add(annotations: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: (id, table_id, column_id, text). Texts are trimmed; blank ones are not added."""
    rows = new.select("id", "table_id", F.nullif("column_id", F.lit("")).alias("column_id"), F.trim("text").alias("text"))
    times = [F.lit(now).cast("long").alias(c) for c in NAMES[4:]]
    return annotations.unionByName(rows.filter("text <> ''").select("*", *times))


def update(annotations: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: (id, text), each id once. A blank text empties the note and leaves its time as it was."""
    both = annotations.join(new.select("id", F.trim("text").alias("new")), "id", "left")
    at = F.when(F.col("new") != "", F.lit(now).cast("long")).otherwise(F.col("updated_at"))
    return both.select("id", "table_id", "column_id", F.coalesce("new", "text").alias("text"), "created_at", at.alias("updated_at"))


def remove(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("id"), "id", "left_anti")


def for_table(annotations: DataFrame, table_id: str) -> DataFrame:
    """Notes on the table itself, without those on its columns."""
    return annotations.filter((F.col("table_id") == table_id) & (F.coalesce("column_id", F.lit("")) == ""))


def for_column(annotations: DataFrame, table_id: str, column_id: str) -> DataFrame:
    return annotations.filter((F.col("table_id") == table_id) & (F.col("column_id") == column_id))


def counts(annotations: DataFrame) -> DataFrame:
    """(table_id, notes), with those on columns."""
    return annotations.groupBy("table_id").agg(F.count(F.lit(1)).alias("notes"))


def load_rule_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Severity of every rule: the saved one, where it is a known severity or `off`, else the default. One small row at most."""
    saved = spark.read.schema(", ".join(f"`{r[0]}` string" for r in RULES)).json(path).first()
    known = {*PENALTY, "off"}
    return {r[0]: saved[i] if saved is not None and saved[i] in known else r[2] for i, r in enumerate(RULES)}


def save_rule_config(spark: SparkSession, config: dict[str, str], path: str) -> None:
    spark.createDataFrame([tuple(config[r[0]] for r in RULES)], ", ".join(f"`{r[0]}` string" for r in RULES)).coalesce(1).write.mode("overwrite").json(path)


def toggled(config: dict[str, str], rule: str) -> dict[str, str]:
    """The rule off, or a warning where it was off."""
    return config | {rule: "warning" if config[rule] == "off" else "off"}
