"""Registered queries that write data with the library and read it back: saved state and model files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import annotations
from ..session import cut_lineage, shared_folder, ship_package
from ..sources import xml_files, xml_model
from ..sources.synthetic import oracle, rich_catalog
from .registry import query, table


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("""SELECT CAST(v.version AS bigint) AS version, CAST(doc_id AS varchar) AS id, coalesce(source, 'none') AS table_id,
    CASE WHEN version > 1 AND doc_id % 7 = 0 THEN '' WHEN version > 1 AND doc_id % 11 = 0 THEN 'seen: ' || trim(lang) ELSE trim(lang) END AS text,
    CAST(CASE WHEN version > 1 AND doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 20 ELSE 10 END AS bigint) AS updated_at
    FROM documents CROSS JOIN (VALUES (1), (2), (3)) v(version) WHERE trim(lang) <> '' AND (version < 3 OR doc_id % 5 <> 0)""")
def saved_notes(spark, d):
    """Notes on documents, saved, changed and partly removed under one path: all three versions of the store."""
    docs, path = table(spark, d, "documents"), _scratch(spark)
    ident = F.col("doc_id").cast("string").alias("id")
    new = docs.select(ident, F.coalesce("source", F.lit("none")).alias("table_id"), F.lit("").alias("column_id"), F.col("lang").alias("text"))
    annotations.save_changes(annotations.add(annotations.load_saved(spark, path), new, 10), path)
    said = docs.filter("doc_id % 7 = 0 OR doc_id % 11 = 0").select(ident, F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" seen: "), F.trim("lang"))).alias("text"))
    notes = annotations.load_saved(spark, path)
    annotations.save_changes(annotations.update(notes.join(said.select("id"), "id", "left_semi"), said, 20), path)
    annotations.save_changes(notes.limit(0), path, gone=docs.filter("doc_id % 5 = 0").select(ident))
    found = [annotations.load_saved(spark, path, v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2, 3)]
    return found[0].union(found[1]).union(found[2]).select("version", "id", "table_id", "text", "updated_at")


def _models(spark, d):
    """The rich catalog, a model a nation, written as files and read back."""
    c = rich_catalog(ship_package(spark), d, keep=True)
    nation = table(spark, d, "supplier").select(F.concat(F.lit("table-"), F.col("s_suppkey").cast("string")).alias("table_id"), F.concat(F.lit("nation-"), F.coalesce("s_nationkey", F.lit(-1)).cast("string")).alias("model"))
    path = _scratch(spark)
    xml_files.write_models(cut_lineage(xml_files.model_lines(c, nation)), path)
    return xml_model.read_catalogs(spark, path)


_MODELS = "models AS (SELECT 'table-' || CAST(s_suppkey AS varchar) AS of_table, 'nation-' || CAST(coalesce(s_nationkey, -1) AS varchar) AS model FROM supplier)"


@query(oracle(f"""SELECT m.model, t.code AS "table", t.comment AS table_comment, row_number() OVER (PARTITION BY m.model ORDER BY t.table_ord, c.col_ord) - 1 AS col_ord, 'id-' || c.column_id AS pd_id, trim(c.code) AS code, trim(c.name) AS name,
        coalesce(trim(c.data_type), 'unknown') AS data_type, nullif(c.length, 0) AS length, nullif(c.precision_, 0) AS "precision", c.mandatory, c.identity_ AS "identity", trim(c.comment) AS comment,
        coalesce(t.pk = c.column_id AND t.table_ord % 2 = 0, false) AS in_key
    FROM cat_types c JOIN cat_named t ON t.table_id = c.table_id JOIN models m ON m.of_table = t.table_id""", rich=True).replace("WITH ", f"WITH {_MODELS}, ", 1))  # fmt: skip
def model_file_columns(spark, d):
    """Columns of model files, one file a nation, after writing and parsing them."""
    m = _models(spark, d)
    t = m.tables.select("model_id", "table_id", F.col("code").alias("table"), F.col("comment").alias("table_comment"), "primary_key")
    in_key = F.coalesce(F.array_contains("primary_key", F.col("column_id")), F.lit(False)).alias("in_key")
    read = m.columns.join(t, ["model_id", "table_id"]).join(m.models.select("model_id", F.col("name").alias("model")), "model_id")
    return read.select("model", "table", "table_comment", "col_ord", "pd_id", "code", "name", "data_type", "length", "precision", "mandatory", "identity", "comment", in_key)


@query(oracle(f"""SELECT c.model, 'id-' || r.ref_id AS pd_id, r.name, CASE WHEN p.model = c.model THEN pt.code ELSE 'id-' || r.parent_table END AS parent, ct.code AS child,
        CASE WHEN p.model = c.model AND pc.col_ord IS NOT NULL THEN pc.code ELSE coalesce('id-' || r.parent_column, '') END AS parent_column, coalesce(cc.code, 'id-' || r.child_column) AS child_column, r.cardinality, r.on_delete
    FROM cat_refs r JOIN models c ON c.of_table = r.child_table LEFT JOIN models p ON p.of_table = r.parent_table JOIN cat_tables ct ON ct.table_id = r.child_table LEFT JOIN cat_tables pt ON pt.table_id = r.parent_table
    LEFT JOIN cat_columns pc ON pc.table_id = r.parent_table AND pc.column_id = r.parent_column LEFT JOIN cat_columns cc ON cc.table_id = r.child_table AND cc.column_id = r.child_column""").replace("WITH ", f"WITH {_MODELS}, ", 1))  # fmt: skip
def model_file_references(spark, d):
    """References of the same files: a parent in another file stays as it is written, else ends are found by their file ids."""
    m = _models(spark, d)
    r = m.refs.withColumn("j", F.explode_outer("joins")).join(m.models.select("model_id", F.col("name").alias("model")), "model_id")
    for side in ("parent", "child"):
        t = m.tables.select("model_id", F.col("table_id").alias(f"{side}_table"), F.col("code").alias(side))
        k = m.columns.select("model_id", F.col("table_id").alias(f"{side}_table"), F.col("column_id").alias(f"{side}_at"), F.col("code").alias(f"{side}_code"))
        r = r.withColumn(f"{side}_at", F.col(f"j.{side}_column")).join(t, ["model_id", f"{side}_table"], "left").join(k, ["model_id", f"{side}_table", f"{side}_at"], "left")
    ends = [F.coalesce("parent", "parent_table").alias("parent"), "child", F.coalesce("parent_code", "parent_at").alias("parent_column"), F.coalesce("child_code", "child_at").alias("child_column")]
    return r.select("model", "pd_id", "name", *ends, "cardinality", "on_delete")
