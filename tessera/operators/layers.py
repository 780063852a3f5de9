"""What a diagram or a details view shows: columns and tables by layer, badges, edges, and small display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Catalog
from .graph import neighbours_within
from .lint import effective_pk

#: What the code of an audit column contains.
AUDIT_COLUMNS = ["created_at", "updated_at", "created_by", "updated_by", "created_date", "modified_date"]


def is_audit_column(code: Column) -> Column:
    return F.lower(code).rlike("|".join(AUDIT_COLUMNS))


def child_columns(c: Catalog) -> DataFrame:
    """(table_id, column_id) of the columns that references of their own table join."""
    return c.refs.select(F.col("child_table").alias("table_id"), F.explode("joins.child_column").alias("column_id")).distinct()


def visible_columns(c: Catalog, layer: str = "all", hide_non_key: bool = False) -> DataFrame:
    """The columns that a layer shows: all, those with a comment (`comments`) or audit columns (`audit`); with hide_non_key only
    those of the primary key or of a reference."""
    cols = c.complete().columns
    if hide_non_key:
        keys = effective_pk(c).select("table_id", F.explode("pk").alias("column_id")).union(child_columns(c)).distinct()
        cols = cols.join(keys, ["table_id", "column_id"], "left_semi")
    return {"comments": cols.filter("comment <> ''"), "audit": cols.filter(is_audit_column(F.col("code")))}.get(layer, cols)


def visible_tables(c: Catalog, layer: str = "all") -> DataFrame:
    """The tables that a layer shows: all, or (`domains`) those with a column whose type's name holds "domain"."""
    if layer != "domains":
        return c.tables
    return c.tables.join(c.columns.filter(F.contains(F.lower("data_type"), F.lit("domain"))).select("table_id"), "table_id", "left_semi")


def by_severity(issues: DataFrame, severity: str = "all") -> DataFrame:
    return issues if severity == "all" else issues.filter(F.col("severity") == severity)


def score_tone(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 65, "fair").otherwise("poor")


def column_badges(c: Catalog) -> DataFrame:
    """(table_id, column_id, badge): PK by the table's own primary key, else FK by a reference of the table, else C."""
    pk = c.tables.select("table_id", F.explode("primary_key").alias("column_id")).distinct().withColumn("in_pk", F.lit(True))
    marked = c.columns.select("table_id", "column_id").join(pk, ["table_id", "column_id"], "left").join(child_columns(c).withColumn("in_fk", F.lit(True)), ["table_id", "column_id"], "left")
    return marked.select("table_id", "column_id", F.when(F.col("in_pk"), "PK").when(F.col("in_fk"), "FK").otherwise("C").alias("badge"))


def references_of(c: Catalog, table_id: str, side: str) -> DataFrame:
    """References whose child (`incoming`) or parent (`outgoing`) is the table; a reference to itself is both."""
    return c.refs.filter(F.col({"incoming": "child_table", "outgoing": "parent_table"}[side]) == table_id)


def display_lines(sql: DataFrame, text: str) -> DataFrame:
    """(at, line): the lines of a column's texts without space at their end, and without those that are empty then; other columns
    are kept."""
    lines = sql.select(*(c for c in sql.columns if c != text), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.withColumn("line", F.regexp_replace("line", r"\s+$", "")).filter("line <> ''")


def focus_set(c: Catalog, start: str, hops: int) -> DataFrame:
    """(table_id): a table and all that are at most `hops` references away."""
    own = c.tables.sparkSession.createDataFrame([(start,)], "table_id string")
    return own.union(neighbours_within(c, start, hops).select("table_id"))


def edges(c: Catalog, layer: str = "all", focus: DataFrame | None = None, path: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """(ref_ord, ref_id, visible, class) of every reference. focus and cycles: (table_id); path: (ref_id). An edge is visible if
    both ends are in focus; on the path it is `path`, between two tables of cycles `cycle`, in the layer `fk` `emphasis`."""
    yes, r = F.lit(True), c.refs.select("ref_ord", "ref_id", "parent_table", "child_table")

    def ends(rows: DataFrame, of: DataFrame | None, name: str) -> DataFrame:
        if of is None:
            return rows.withColumn(name, F.lit(None).cast("boolean"))
        of = of.select("table_id").distinct()
        for side in ("parent_table", "child_table"):
            rows = rows.join(of.select(F.col("table_id").alias(side), yes.alias(f"{name}_{side}")), side, "left")
        return rows.withColumn(name, F.col(f"{name}_parent_table").isNotNull() & F.col(f"{name}_child_table").isNotNull())

    r = ends(ends(r, focus, "focused"), cycles, "cycle")
    on_path = r.join(path.select("ref_id").distinct().withColumn("on_path", yes), "ref_id", "left") if path is not None else r.withColumn("on_path", F.lit(None).cast("boolean"))
    kind = F.when(F.col("on_path"), "path").when(F.col("cycle"), "cycle").when(F.lit(layer == "fk"), "emphasis").otherwise("")
    return on_path.select("ref_ord", "ref_id", F.coalesce("focused", yes).alias("visible"), kind.alias("class"))
