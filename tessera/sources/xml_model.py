"""Schema catalogs from model files in XML (.pdm, .xml).

Each file becomes rows of nodes (xml_files), in the task that reads it; all that follows is joins and groupings over that table, for any
number of files at once. Tags are compared without namespace and case. Attributes are nodes too, before the children.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..catalog import Catalog
from ..session import cut_lineage, honest_sizes
from .xml_files import NODES, can_open, parse, read_nodes


def node_rows(batches):
    """(model_id, text) to NODES."""
    names = [f.split()[0] for f in NODES.replace("map<string,long>", "map").split(", ")]
    for batch in batches:
        for model_id, text in zip(batch["model_id"], batch["text"]):
            rows = [(model_id, *row) for row in parse([(text or "").encode()])]
            yield pd.DataFrame(rows, columns=names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, model_name, text): one row per file; the name is that of the file without its last extension."""
    found = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_name")
    return found.select(F.col("file_path").alias("model_id"), F.regexp_replace("file_name", r"\.[^.]*$", "").alias("model_name"), F.col("value").alias("text"))


@dataclass(frozen=True)
class Catalogs:
    """The frames of Catalog with model_id before, for all files; `models` is (model_id, name)."""

    models: DataFrame
    tables: DataFrame
    columns: DataFrame
    refs: DataFrame
    indexes: DataFrame
    keys: DataFrame
    domains: DataFrame

    def one(self, model_id: str, name: str = "model") -> Catalog:
        frames = (getattr(self, k).filter(F.col("model_id") == model_id).drop("model_id") for k in ("tables", "columns", "refs", "indexes", "keys", "domains"))
        return Catalog(*frames, name=name)


def _props(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """objects with p: the scalars of a node's direct entries by tag; of entries with one tag the last name counts, and of that
    its first entry."""
    direct = nodes.filter("is_first AND scalar IS NOT NULL").join(objects.select("model_id", F.col("node").alias("parent")), ["model_id", "parent"], "left_semi")
    last = direct.groupBy("model_id", F.col("parent").alias("node"), "tag").agg(F.max_by("scalar", "node").alias("scalar"))
    p = last.groupBy("model_id", "node").agg(F.map_from_entries(F.collect_list(F.struct("tag", "scalar"))).alias("p"))
    return objects.join(p, ["model_id", "node"], "left").withColumn("p", F.coalesce("p", F.create_map().cast("map<string,string>")))


def _v(*names: str) -> Column:
    return F.coalesce(*(F.try_element_at(F.col("p"), F.lit(n)) for n in names))


def _in(nodes: DataFrame, tag: str, container: str, owner: str | None = None, strict: bool = False) -> DataFrame:
    """Nodes with the tag inside the first container of their model or owner; without a container, anywhere inside (strict: none)."""
    found = nodes.filter(F.col("tag").isin(*(("join", "referencejoin") if tag == "join" else (tag,))))
    held, by = nodes.filter(F.col("tag") == container), ["model_id"]
    if owner:
        own = F.try_element_at("within", F.lit(owner))
        found, held, by = found.withColumn("owner", own).filter("owner IS NOT NULL"), held.withColumn("owner", own), ["model_id", "owner"]
    first = held.groupBy(*by).agg(F.min_by("node", F.struct("parent", "node")).alias("container"))
    found = found.join(first, by, "inner" if strict else "left")
    return found.filter(F.col("container").isNull() | F.array_contains("ancestors", F.col("container"))).drop("container")


def _bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def _number(c: Column) -> Column:
    return F.nullif(c.try_cast("double"), F.lit(0.0)).cast("long")


def _ordinal(by: str = "node") -> Column:
    return F.row_number().over(Window.partitionBy("model_id").orderBy(by)) - 1


def _low(c: str | Column) -> Column:
    return F.lower(F.trim(c))


#: Labels of the constraint numbers 0 to 4.
CONSTRAINTS = ["None", "Restrict", "Cascade", "Set Null", "Set Default"]


def constraint(c: Column) -> Column:
    text = F.trim(c)
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.coalesce(F.when(number < len(CONSTRAINTS), F.get(F.array(*map(F.lit, CONSTRAINTS)), number)), text)


def _resolved(values: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """values (by..., owner, at, value) as one array per `by`: each value by the column's file id, code or name within its
    table (the last column with it counts), else as it is; empty values go."""
    v = values.withColumn("value", F.trim("value")).filter("value <> ''").withColumn("low", F.lower("value"))
    for i, key in enumerate(("pd_id", "code", "name")):
        known = columns.filter(F.col(key).isNotNull()).groupBy("model_id", "owner", _low(key).alias("low")).agg(F.max_by("column_id", "col_ord").alias(f"c{i}"))
        v = v.join(known, ["model_id", "owner", "low"], "left")
    entry = F.struct("at", F.coalesce("c0", "c1", "c2", "value").alias("id"))
    return v.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["id"]).alias("columns"))


def _keyed(frame: DataFrame, scope: list[str], ident: str, order: str) -> DataFrame:
    """(scope..., low, id): every name that leads to an object; the last object with a name counts."""
    names = F.explode(F.array_compact(F.array(ident, "code", "name", "pd_id")))
    return frame.select(*scope, order, F.col(ident).alias("id"), names.alias("n")).groupBy(*scope, _low("n").alias("low")).agg(F.max_by("id", order).alias("id"))


def catalogs(files: DataFrame) -> Catalogs:
    """Catalogs of files (model_id, model_name, text). A file without text has no objects. Every frame starts from the
    nodes, and later plans use each frame many times, so each is computed once and kept in the shared folder."""
    return _catalogs(cut_lineage(files.select("model_id", "text").mapInPandas(node_rows, NODES)), files.select("model_id", "model_name"))


def _catalogs(nodes: DataFrame, files: DataFrame) -> Catalogs:
    honest_sizes(nodes.sparkSession)
    none = F.array().cast("array<string>")

    t = _props(nodes, _in(nodes, "table", "tables").select("model_id", "node")).withColumn("table_ord", _ordinal())
    code = F.coalesce(_v("code"), F.concat(F.lit("table_"), F.col("table_ord")))
    t = t.select(
        "model_id", F.col("node").alias("owner"), "table_ord", F.concat(F.lit("table-"), F.col("table_ord")).alias("table_id"),
        _v("id").alias("pd_id"), code.alias("code"), F.coalesce(_v("name"), code).alias("name"), _v("comment").alias("comment"),
    )
    # what a step starts from is written down, so that no plan holds more than a few joins: Spark's driver keeps a plan's text for each stage of it
    t = cut_lineage(t)
    owners = t.select("model_id", "owner", "table_id")

    def numbered(tag: str, container: str) -> DataFrame:
        found = cut_lineage(_in(nodes, tag, container, "table").select("model_id", "owner", "node").join(owners, ["model_id", "owner"]))
        return cut_lineage(_props(nodes, found)).withColumn("at", _ordinal())

    c = numbered("column", "columns")
    code = F.coalesce(_v("code"), F.concat(F.lit("column_"), F.col("at")))
    c = c.select(
        "model_id", "owner", "table_id", F.col("at").cast("long").alias("col_ord"), F.concat(F.lit("column-"), F.col("at")).alias("column_id"), _v("id").alias("pd_id"),
        code.alias("code"), F.coalesce(_v("name"), code).alias("name"), F.coalesce(_v("datatype", "type"), F.lit("unknown")).alias("data_type"),
        _number(_v("length")).alias("length"), _number(_v("precision")).alias("precision"), _bool(_v("column.mandatory", "mandatory", "notnull")).alias("mandatory"),
        _bool(_v("column.identity", "identity", "isidentity")).alias("identity"), _v("defaultvalue", "default").alias("default_value"), _v("comment").alias("comment"),
    )

    c = cut_lineage(c)

    def inside(tag: str, owner_tag: str, value: Column) -> DataFrame:
        own = F.try_element_at("within", F.lit(owner_tag))
        found = nodes.filter(F.col("tag") == tag).select("model_id", own.alias("item"), F.try_element_at("within", F.lit("table")).alias("owner"), F.col("node").alias("at"), value.alias("value"))
        return found.filter("item IS NOT NULL AND value <> ''")

    by = ["model_id", "item"]
    k = numbered("key", "keys")
    kc = cut_lineage(_resolved(inside("column", "key", F.col("label")), c, by))
    k = k.join(kc.withColumnRenamed("item", "node"), ["model_id", "node"], "left").withColumn("name", F.coalesce(_v("name"), F.concat(F.lit("key_"), F.col("at"))))
    k = k.select(
        "model_id", "owner", "table_id", F.col("at").cast("long").alias("key_ord"), F.concat(F.lit("key-"), F.col("at")).alias("key_id"), _v("id").alias("pd_id"),
        "name", F.coalesce("columns", none).alias("columns"), (F.contains(F.lower("name"), F.lit("primary")) | _bool(_v("primary"))).alias("is_primary"),
    )
    k = cut_lineage(k)

    x = numbered("index", "indexes")
    parts = _props(nodes, nodes.filter("tag = 'indexcolumn'").select("model_id", "node", "label", F.try_element_at("within", F.lit("index")).alias("item"), F.try_element_at("within", F.lit("table")).alias("owner")))
    parts = parts.select("model_id", "item", "owner", F.col("node").alias("at"), F.coalesce(_v("indexcolumn.expression", "expression"), "label").alias("value")).filter("value <> ''")
    plain = inside("column", "index", F.col("label")).join(parts.select("model_id", "item"), by, "left_anti")
    xc = cut_lineage(_resolved(cut_lineage(parts.unionByName(plain)), c, by))
    x = x.join(xc.withColumnRenamed("item", "node"), ["model_id", "node"], "left").select(
        "model_id", "table_id", F.col("at").cast("long").alias("index_ord"), F.concat(F.lit("index-"), F.col("at")).alias("index_id"), _v("id").alias("pd_id"),
        F.coalesce(_v("name"), F.concat(F.lit("index_"), F.col("at"))).alias("name"), F.coalesce("columns", none).alias("columns"), _bool(_v("unique")).alias("is_unique"),
    )

    # The primary key: the first key that the table's PrimaryKey names by its file id, else the columns it lists.
    named = nodes.filter("tag = 'key' AND element_at(within, 'primarykey') IS NOT NULL").select("model_id", F.try_element_at("within", F.lit("table")).alias("owner"), _low("scalar").alias("low")).distinct()
    chosen = k.withColumn("low", _low("pd_id")).join(named, ["model_id", "owner", "low"], "left_semi").groupBy("model_id", "owner").agg(F.min_by(F.struct("key_id", "columns"), "key_ord").alias("chosen"))
    listed = inside("column", "primarykey", F.col("label")).select("model_id", "owner", F.col("owner").alias("item"), "at", "value")
    listed = cut_lineage(_resolved(listed, c, by)).withColumnRenamed("item", "owner").withColumnRenamed("columns", "listed")
    t = t.join(chosen, ["model_id", "owner"], "left").join(listed, ["model_id", "owner"], "left")
    pk = F.when(F.col("chosen").isNotNull(), F.col("chosen.columns")).otherwise(F.col("listed"))
    t = cut_lineage(t.withColumn("primary_key", F.when(F.size(pk) > 0, pk)))
    k = k.join(t.select("model_id", "owner", F.col("chosen.key_id").alias("primary")), ["model_id", "owner"], "left").withColumn("is_primary", F.col("is_primary") | F.coalesce(F.col("key_id") == F.col("primary"), F.lit(False))).drop("owner", "primary")
    t = cut_lineage(_placed(nodes, t.drop("owner", "chosen", "listed")))

    d = _props(nodes, _in(nodes, "domain", "domains", strict=True).select("model_id", "node")).withColumn("at", _ordinal()).select(
        "model_id", F.col("at").cast("long").alias("domain_ord"), F.concat(F.lit("domain-"), F.col("at")).alias("domain_id"),
        F.coalesce(_v("name"), F.concat(F.lit("domain_"), F.col("at"))).alias("name"), F.coalesce(_v("datatype"), F.lit("unknown")).alias("data_type"),
    )
    root = nodes.filter("tag = 'model'").groupBy("model_id").agg(F.min_by("node", F.struct("parent", "node")).alias("node"))
    models = files.select("model_id", "model_name").join(_props(nodes, root), "model_id", "left").select("model_id", F.coalesce(_v("name"), "model_name").alias("name"))
    return Catalogs(models, t.withColumn("table_ord", F.col("table_ord").cast("long")), c.drop("owner"), *(cut_lineage(f) for f in (_references(nodes, t, c), x, k, d)))


def _references(nodes: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    r = _props(nodes, _in(nodes, "reference", "references").select("model_id", "node")).withColumn("at", _ordinal())
    r = r.select(
        "model_id", "node", F.col("at").cast("long").alias("ref_ord"), F.concat(F.lit("reference-"), F.col("at")).alias("ref_id"), _v("id").alias("pd_id"),
        F.coalesce(_v("name"), F.concat(F.lit("reference_"), F.col("at"))).alias("name"), F.coalesce(_v("parenttable"), F.lit("")).alias("parent_table"), F.coalesce(_v("childtable"), F.lit("")).alias("child_table"),
        F.coalesce(_v("cardinality"), F.lit("N:1")).alias("cardinality"), constraint(_v("ondelete", "deleteconstraint")).alias("on_delete"), constraint(_v("onupdate", "updateconstraint")).alias("on_update"),
    )
    r, tables = cut_lineage(r), cut_lineage(_keyed(t, ["model_id"], "table_id", "table_ord"))
    for side in ("parent_table", "child_table"):
        r = r.withColumn("low", _low(side)).join(tables.withColumnRenamed("id", "found"), ["model_id", "low"], "left").withColumn(side, F.coalesce("found", side)).drop("low", "found")
    r = cut_lineage(r)
    j = _props(nodes, _in(nodes, "join", "joins", "reference").select("model_id", F.col("owner").alias("ref"), "node")).select(
        "model_id", F.col("ref"), F.col("node").alias("at"), _v("parentcolumn").alias("lp"), _v("childcolumn").alias("lc"), _v("object1").alias("o1"), _v("object2").alias("o2"),
    )
    legacy, empty = F.col("lp").isNotNull() | F.col("lc").isNotNull(), F.lit("")
    j = j.select("model_id", F.col("ref").alias("node"), "at", F.coalesce(F.when(legacy, F.col("lp")).otherwise(F.col("o1")), empty).alias("parent_column"), F.coalesce(F.when(legacy, F.col("lc")).otherwise(F.col("o2")), empty).alias("child_column"))
    j = j.join(r.select("model_id", "node", "parent_table", "child_table"), ["model_id", "node"])
    j, columns = cut_lineage(j), cut_lineage(_keyed(c, ["model_id", "table_id"], "column_id", "col_ord"))
    for side in ("parent", "child"):
        known = columns.select("model_id", F.col("table_id").alias(f"{side}_table"), "low", F.col("id").alias("found"))
        j = j.withColumn("low", _low(f"{side}_column")).join(known, ["model_id", f"{side}_table", "low"], "left").withColumn(f"{side}_column", F.coalesce("found", f"{side}_column")).drop("low", "found")
    joins = j.groupBy("model_id", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "parent_column", "child_column"))), lambda x: F.struct(x["parent_column"].alias("parent_column"), x["child_column"].alias("child_column"))).alias("joins"))
    none = F.array().cast("array<struct<parent_column:string,child_column:string>>")
    return r.join(joins, ["model_id", "node"], "left").select("model_id", "ref_ord", "ref_id", "pd_id", "name", "parent_table", "child_table", F.coalesce("joins", none).alias("joins"), "cardinality", "on_delete", "on_update")


def _placed(nodes: DataFrame, t: DataFrame) -> DataFrame:
    """tables with position: of their symbol, by file id, code or name; the last symbol counts. Rectangles are scaled so that
    their median width is 240."""
    s = _props(nodes, _in(nodes, "tablesymbol", "tablesymbols").select("model_id", "node"))
    n = F.transform(F.regexp_extract_all(_v("rect"), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("double"))
    number = lambda default, *names: F.coalesce(F.nullif(_v(*names).try_cast("double"), F.lit(0.0)), F.lit(default))
    from_rect = F.coalesce(F.size(n) >= 4, F.lit(False))
    rect = F.struct(n[0].alias("x"), n[1].alias("y"), (n[2] - n[0]).alias("w"), (n[3] - n[1]).alias("h"))
    plain = F.struct(number(0.0, "x").alias("x"), number(0.0, "y").alias("y"), number(220.0, "width", "w").alias("w"), number(180.0, "height", "h").alias("h"))
    s = s.select("model_id", "node", _low(_v("object", "table", "code", "name")).alias("low"), from_rect.alias("from_rect"), F.when(from_rect, rect).otherwise(plain).alias("at")).filter("low <> ''")
    width = s.filter("from_rect AND at.w > 0").groupBy("model_id").agg(F.median("at.w").alias("width"))
    scale = F.when(F.col("from_rect"), F.coalesce(240.0 / F.col("width"), F.lit(1.0))).otherwise(1.0)
    at = F.struct(*((F.col(f"at.{f}") * scale).alias(f) for f in "xywh"))
    last = cut_lineage(s.join(width, "model_id", "left").groupBy("model_id", "low").agg(F.max_by(at, "node").alias("at")))
    for i, key in enumerate(("pd_id", "code", "name")):
        t = t.withColumn("low", _low(key)).join(last.withColumnRenamed("at", f"at{i}"), ["model_id", "low"], "left").drop("low")
    return t.withColumn("position", F.coalesce("at0", "at1", "at2")).drop("at0", "at1", "at2")


def read_catalogs(spark: SparkSession, path: str) -> Catalogs:
    """Catalogs of the model files under a path, parsed a piece at a time by the data source of xml_files; where its client can't
    open the path's file system, Spark reads each file as one text."""
    if not can_open(path):
        return catalogs(read_files(spark, path))
    read = cut_lineage(read_nodes(spark, path))
    return _catalogs(read.filter("node >= 0").drop("model_name"), read.filter("node = -1").select("model_id", "model_name"))
