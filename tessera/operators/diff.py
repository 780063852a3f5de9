"""Comparison of two versions of a collection: pairing by prioritised keys, changed fields, and a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..session import cut_lineage


def pair_versions(base: DataFrame, target: DataFrame, ident: str, order: str, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """(base_id, target_id): each base row takes the target row of its first key that is found, in the order of `keys`; of target
    rows with equal keys the last counts; of base rows with one match the first is paired, the others are base-only, and so are
    unmatched rows on either side. With `scope`, only rows that agree in these columns are paired."""
    scope = scope or []
    matched = base.select(F.col(ident).alias("base_id"), F.col(order).alias("base_ord"), *scope, *(F.lower(F.trim(k)).alias(f"k{i}") for i, k in enumerate(keys)))
    for i, k in enumerate(keys):
        last = target.filter(F.trim(k) != "").groupBy(*scope, F.lower(F.trim(k)).alias(f"k{i}")).agg(F.max_by(ident, order).alias(f"m{i}"))
        matched = matched.join(last, [*scope, f"k{i}"], "left")
    matched = matched.withColumn("target_id", F.coalesce(*(f"m{i}" for i in range(len(keys)))))
    alone = F.when(F.col("target_id").isNull(), F.col("base_id"))
    first = F.row_number().over(Window.partitionBy("target_id", alone).orderBy("base_ord")) == 1
    paired = matched.select("base_id", F.when(first, F.col("target_id")).alias("match"))
    return paired.join(target.select(F.col(ident).alias("target_id")), F.col("match") == F.col("target_id"), "full").select("base_id", "target_id")


def text_of(c: Column) -> Column:
    """A value as it is shown: a dash for null and empty."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))


def diff_rows(base: DataFrame, target: DataFrame, ident: str, order: str, keys: list[str], fields: list[str]) -> DataFrame:
    """(kind, id, changes): added, removed and modified rows; changes is an array of (field, before, after)."""
    pairs = pair_versions(base, target, ident, order, keys)
    b = base.select(F.col(ident).alias("base_id"), *(F.col(f).alias(f"b_{f}") for f in fields))
    t = target.select(F.col(ident).alias("target_id"), *(F.col(f).alias(f"t_{f}") for f in fields))
    both = pairs.join(b, "base_id", "left").join(t, "target_id", "left")
    change = F.filter(F.array(*(
        F.when(text_of(F.col(f"b_{f}")) != text_of(F.col(f"t_{f}")), F.struct(F.lit(f).alias("field"), text_of(F.col(f"b_{f}")).alias("before"), text_of(F.col(f"t_{f}")).alias("after")))
        for f in fields
    )), lambda x: x.isNotNull())
    kind = F.when(F.col("base_id").isNull(), "added").when(F.col("target_id").isNull(), "removed").otherwise("modified")
    out = both.select(kind.alias("kind"), F.coalesce("base_id", "target_id").alias("id"), change.alias("changes"))
    whole = F.when(F.col("kind") == "modified", F.col("changes"))
    return out.withColumn("changes", whole).filter("kind <> 'modified' OR size(changes) > 0")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: added, removed, modified and total."""
    n = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("added", "removed", "modified")]
    return diff.agg(*n, F.count(F.lit(1)).alias("total"))


KEYS = {"table": "table_id", "column": "column_id", "reference": "ref_id", "index": "index_id", "key": "key_id"}
ORDERS = {"table": "table_ord", "column": "col_ord", "reference": "ref_ord", "index": "index_ord", "key": "key_ord"}
FRAMES = {"table": "tables", "column": "columns", "reference": "refs", "index": "indexes", "key": "keys"}


def _sorted(c: Column, by: str) -> Column:
    return F.array_join(F.array_sort(c), by)


def _compared(kind: str) -> list[tuple[str, Column]]:
    """Labels of the compared fields, in order, and what is compared."""
    col, ids = F.col, lambda: _sorted(F.col("columns"), ",")
    number = lambda n: F.nullif(F.col(n), F.lit(0)).cast("string")
    code, name, comment = ("Código", col("code")), ("Nombre", col("name")), ("Comentario", col("comment"))
    return {
        "table": [code, name, comment],
        "column": [
            code, name, ("Tipo", col("data_type")), ("Longitud", number("length")), ("Precisión", number("precision")),
            ("Nullable", F.when(col("mandatory"), "NOT NULL").otherwise("NULL")), ("Identity", col("identity").cast("string")), ("Default", col("default_value")), comment,
        ],
        "reference": [
            ("Padre", col("parent_table")), ("Hijo", col("child_table")), ("Cardinalidad", col("cardinality")), ("ON DELETE", col("on_delete")), ("ON UPDATE", col("on_update")),
            ("Joins", _sorted(F.transform("joins", lambda j: F.concat(j["parent_column"], F.lit("→"), j["child_column"])), ";")),
        ],
        "index": [name, ("Unique", col("is_unique").cast("string")), ("Columnas", ids())],
        "key": [name, ("Primary", col("is_primary").cast("string")), ("Columnas", ids())],
    }[kind]


def pair_objects(base: Catalog, target: Catalog, kind: str, pairs: DataFrame | None = None) -> DataFrame:
    """(base_id, target_id) of two complete catalogs by file id, code, name and id; with the tables' pairs, the children of
    paired tables only. Later plans use the pairs many times, so they are computed once."""
    ident, order = KEYS[kind], ORDERS[kind]
    sides = [getattr(x, FRAMES[kind]) for x in (base, target)]
    if pairs is not None:
        both = pairs.filter("base_id IS NOT NULL AND target_id IS NOT NULL")
        sides = [f.join(both.select(F.col(own).alias("table_id"), F.col("target_id").alias("scope")), "table_id") for f, own in zip(sides, ("base_id", "target_id"))]
    keys = ["pd_id", *(["code"] if "code" in sides[0].columns else []), "name", ident]
    return cut_lineage(pair_versions(*sides, ident, order, keys, ["scope"] if pairs is not None else None))


def diff_models(base: Catalog, target: Catalog) -> DataFrame:
    """(object_type, kind, id, name, parent, changes) of everything added, removed or modified; children are compared inside
    paired tables only, and their parent is the name of the target's table. changes is an array of (field, before, after)."""
    base, target = base.complete(), target.complete()
    tables = pair_objects(base, target, "table")
    parent = target.tables.select("table_id", F.col("name").alias("parent"))
    owner = tables.filter("base_id IS NOT NULL AND target_id IS NOT NULL").join(parent, F.col("table_id") == F.col("target_id")).select("base_id", "target_id", "parent")
    out = []
    for kind in KEYS:
        inner = kind in ("column", "index", "key")
        pairs = pair_objects(base, target, kind, tables) if inner else tables if kind == "table" else pair_objects(base, target, kind)
        sides = []
        for side, frame, own in (("b", getattr(base, FRAMES[kind]), "base_id"), ("t", getattr(target, FRAMES[kind]), "target_id")):
            label = F.coalesce(F.nullif("name", F.lit("")), KEYS[kind]) if kind == "reference" else F.col("name")
            if inner:
                frame = frame.join(owner.select(F.col(own).alias("table_id"), "parent"), "table_id")
            fields = [F.coalesce(v, F.lit("")).alias(f"f{i}") for i, (_, v) in enumerate(_compared(kind))]
            sides.append(frame.select(F.col(KEYS[kind]).alias(own), F.struct(label.alias("name"), (F.col("parent") if inner else F.lit(None).cast("string")).alias("parent"), *fields).alias(side)))
        both = pairs.join(sides[0], "base_id", "left").join(sides[1], "target_id", "left")
        changes = F.array_compact(F.array(*(
            F.when(F.col(f"b.f{i}") != F.col(f"t.f{i}"), F.struct(F.lit(label).alias("field"), text_of(F.col(f"b.f{i}")).alias("before"), text_of(F.col(f"t.f{i}")).alias("after")))
            for i, (label, _) in enumerate(_compared(kind))
        )))
        what = F.when(F.col("base_id").isNull(), "added").when(F.col("target_id").isNull(), "removed").otherwise("modified")
        shown = F.coalesce("t", "b")
        row = both.select(F.lit(kind).alias("object_type"), what.alias("kind"), F.coalesce("target_id", "base_id").alias("id"), shown["name"].alias("name"), shown["parent"].alias("parent"), F.coalesce(changes, F.array().cast("array<struct<field:string,before:string,after:string>>")).alias("changes"))
        out.append(row.filter("kind <> 'modified' OR size(changes) > 0"))
    return reduce(DataFrame.unionByName, out)


def alter_statements(diff: DataFrame, target: Catalog) -> DataFrame:
    """(part, name, item, line): new tables, changed columns, new columns, dropped columns, dropped tables. A column's table is
    found by its parent's name as a code."""
    c, diff = target.complete(), cut_lineage(diff)
    sized = F.concat(F.coalesce("code", F.lit("")), F.lit(" "), F.col("data_type"), F.when(F.col("length") > 0, F.concat(F.lit("("), F.col("length"), F.lit(")"))).otherwise(""), F.when(F.col("mandatory"), " NOT NULL").otherwise(""))
    cols = c.columns.select("table_id", "col_ord", F.col("column_id").alias("id"), sized.alias("sized"))
    lists = cols.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "sized"))), lambda x: F.concat(F.lit("  "), x["sized"])), ",\n").alias("body"))
    new = diff.filter("object_type = 'table' AND kind = 'added'").select(F.col("id").alias("table_id")).join(c.tables, "table_id").join(lists, "table_id", "left")
    made = F.concat(F.lit("-- Nueva tabla: "), F.col("code"), F.lit("\nCREATE TABLE "), F.col("code"), F.lit(" (\n"), F.coalesce("body", F.lit("")), F.lit("\n);\n"))
    by_code = c.tables.groupBy(F.lower("code").alias("low")).agg(F.max_by("code", "table_ord").alias("table"))
    of = diff.filter("object_type = 'column'").withColumn("low", F.lower("parent")).join(by_code, "low")
    alter = F.concat(F.lit("ALTER TABLE "), F.col("table"))
    one = of.filter("kind = 'modified'").select("table", "name", F.posexplode("changes").alias("item", "c")).filter("c.field IN ('Tipo', 'Longitud', 'Nullable')")
    return reduce(DataFrame.union, [
        new.select(F.lit(0).alias("part"), "name", F.lit(0).alias("item"), made.alias("line")),
        one.select(F.lit(1), "name", "item", F.concat(alter, F.lit(" MODIFY ("), F.col("name"), F.lit(" "), F.col("c.after"), F.lit(");"))),
        of.filter("kind = 'added'").join(cols.select("id", "sized"), "id").select(F.lit(2), "name", F.lit(0), F.concat(alter, F.lit(" ADD ("), F.col("sized"), F.lit(");"))),
        of.filter("kind = 'removed'").select(F.lit(3), "name", F.lit(0), F.concat(alter, F.lit(" DROP COLUMN "), F.col("name"), F.lit(";"))),
        diff.filter("object_type = 'table' AND kind = 'removed'").select(F.lit(4), "name", F.lit(0), F.concat(F.lit("DROP TABLE "), F.col("name"), F.lit(";"))),
    ])
