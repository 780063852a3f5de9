"""A schema catalog derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import Catalog
from ..session import honest_sizes, materialise

BASE = "(SELECT count(*) AS n, min(s_suppkey) AS m FROM supplier) b"
SQL = {
    "cat_columns": f"""
        SELECT 'table-' || CAST(p_partkey % n + m AS varchar(20)) AS table_id, p_partkey AS col_ord,
               'column-' || CAST(p_partkey AS varchar(20)) AS column_id,
               CASE WHEN p_size % 7 = 0 THEN replace(lower(p_name), ' ', '_') || '_id' ELSE replace(p_name, ' ', '_') END AS code,
               p_name AS name,
               CASE p_size % 5 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'INTEGER' WHEN 2 THEN 'VARCHAR2' WHEN 3 THEN 'DATE' ELSE 'NUMBER' END AS data_type,
               CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size * 100 AS bigint) END AS length,
               p_size % 2 = 0 AS mandatory, p_size % 11 = 0 AS identity_
        FROM part, {BASE} WHERE p_partkey % n <> 3""",
    "cat_pk": "SELECT table_id, 'column-' || CAST(min(col_ord) AS varchar(20)) AS pk FROM cat_columns GROUP BY table_id",
    "cat_tables": """
        SELECT s_suppkey AS table_ord, 'table-' || CAST(s_suppkey AS varchar(20)) AS table_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'SUP_' || CAST(s_nationkey AS varchar(20)) || '_' || CAST(s_suppkey AS varchar(20))
                    WHEN 1 THEN 'supTable' || CAST(s_suppkey AS varchar(20)) ELSE 'SupTable' || CAST(s_suppkey AS varchar(20)) END AS code,
               s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE pk END AS pk
        FROM supplier LEFT JOIN cat_pk ON table_id = 'table-' || CAST(s_suppkey AS varchar(20))""",
    "cat_refs": f"""
        SELECT p_partkey AS ref_ord, 'reference-' || CAST(p_partkey AS varchar(20)) AS ref_id, 'FK_' || CAST(p_partkey AS varchar(20)) AS name,
               'table-' || CAST(p_partkey * 7 % (n + 1) + m AS varchar(20)) AS parent_table, 'table-' || CAST(p_partkey % n + m AS varchar(20)) AS child_table,
               CASE WHEN p_partkey % 13 = 0 THEN 'column-none' ELSE pk.pk END AS parent_column, 'column-' || CAST(p_partkey AS varchar(20)) AS child_column,
               CASE p_partkey % 3 WHEN 0 THEN '1:N' WHEN 1 THEN 'N : M' ELSE '0..*' END AS cardinality,
               CASE p_partkey % 2 WHEN 0 THEN 'No action' ELSE 'Cascade' END AS on_delete
        FROM part CROSS JOIN {BASE} LEFT JOIN cat_pk pk ON pk.table_id = 'table-' || CAST(p_partkey * 7 % (n + 1) + m AS varchar(20)) WHERE p_size % 7 = 0 AND p_partkey % 4 <> 1""",
    "cat_indexes": """
        SELECT table_id, col_ord AS index_ord, 'IX_' || CAST(col_ord AS varchar(20)) AS name, column_id FROM cat_columns WHERE col_ord % 3 = 0
        UNION ALL
        SELECT table_id, col_ord + 1000000000, 'IY_' || CAST(col_ord AS varchar(20)), column_id FROM cat_columns WHERE col_ord % 15 = 0""",
}

#: The same catalog with comments, keys, domains, unique indexes, precisions, and types of any spelling or none.
RICH = {
    "cat_types": """
        SELECT c.table_id, c.col_ord, c.column_id, c.code, c.name, c.length, c.mandatory, c.identity_,
               CASE p_size % 12 WHEN 0 THEN ' nvarchar2 ' WHEN 1 THEN 'timestamp' WHEN 2 THEN NULL WHEN 3 THEN 'double' WHEN 4 THEN 'Char' WHEN 5 THEN 'bigint' WHEN 6 THEN '' WHEN 7 THEN 'xmltype'
                    WHEN 8 THEN 'Serial' ELSE c.data_type END AS data_type,
               CASE WHEN p_size % 5 < 3 THEN CAST(p_size % 5 AS bigint) END AS precision_,
               CASE p_size % 4 WHEN 0 THEN p_brand || ' of type ' || lower(p_type) WHEN 1 THEN '' END AS comment
        FROM cat_columns c JOIN part ON p_partkey = c.col_ord""",
    "cat_named": """
        SELECT t.table_ord, t.table_id, t.code, t.name, t.pk, CASE WHEN t.table_ord % 4 = 1 THEN 'Blue stock of no ' || CAST(t.table_ord AS varchar(20)) END AS comment, coalesce(n, 0) AS n_columns
        FROM cat_tables t LEFT JOIN (SELECT table_id AS of_table, count(*) AS n FROM cat_columns GROUP BY table_id) k ON k.of_table = t.table_id""",
    "cat_keys": """
        SELECT table_id, table_ord AS key_ord, 'key-' || CAST(table_ord AS varchar(20)) AS key_id, 'PK_' || code AS name, pk AS column_id, true AS is_primary FROM cat_tables WHERE pk IS NOT NULL AND table_ord % 2 = 0
        UNION ALL
        SELECT table_id, table_ord + 1000000000, 'key-a' || CAST(table_ord AS varchar(20)), 'AK ' || name, pk, false FROM cat_tables WHERE table_ord % 3 = 0""",
    "cat_domains": """
        SELECT min(p_partkey) AS domain_ord, 'domain-' || CAST(min(p_partkey) AS varchar(20)) AS domain_id, p_type || ' blue' AS name, CASE WHEN min(p_size) % 2 = 0 THEN 'NUMBER' ELSE 'VARCHAR' END AS data_type
        FROM part GROUP BY p_type""",
}


def oracle(query: str, rich: bool = False) -> str:
    """The query over the catalog, as one statement."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (SQL | (RICH if rich else {})).items()) + "\n" + query


def rich_catalog(spark: SparkSession, sf_dir: str, keep: bool = False) -> Catalog:
    """The catalog of RICH."""
    frames = _frames(spark, sf_dir, SQL | RICH, keep)
    plain = _catalog(frames)
    tables = frames["cat_named"].withColumn("primary_key", F.when(F.col("pk").isNotNull(), F.array("pk"))).drop("pk", "n_columns")
    columns = frames["cat_types"].withColumnsRenamed({"identity_": "identity", "precision_": "precision"})
    indexes = plain.indexes.withColumns({"is_unique": F.col("index_ord") % 2 == 0, "index_id": F.concat(F.lit("index-"), F.col("index_ord").cast("string"))})
    keys = frames["cat_keys"].withColumn("columns", F.when(F.col("column_id").isNotNull(), F.array("column_id"))).drop("column_id")
    return Catalog(tables, columns, plain.refs, indexes, keys, frames["cat_domains"])


def synthetic_catalog(spark: SparkSession, sf_dir: str, keep: bool = False) -> Catalog:
    """keep: write the catalog down first, for operators that look at it many times."""
    return _catalog(_frames(spark, sf_dir, SQL, keep))


def _frames(spark: SparkSession, sf_dir: str, every: dict[str, str], keep: bool) -> dict[str, DataFrame]:
    honest_sizes(spark)
    frames: dict[str, DataFrame] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "supplier")}
    for name, sql in every.items():
        used = {k: v for k, v in frames.items() if k in sql}
        for k in used:
            sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k}", f"JOIN {{{k}}}")
        frames[name] = spark.sql(sql, **used)
        if keep:
            frames[name] = materialise(frames[name])
    return frames


def _catalog(frames: dict[str, DataFrame]) -> Catalog:
    spark = frames["cat_tables"].sparkSession
    pk = F.when(F.col("pk").isNotNull(), F.array("pk"))
    tables = frames["cat_tables"].select("table_ord", "table_id", "code", "name", F.lit(None).cast("string").alias("comment"), pk.alias("primary_key"))
    joins = F.array(F.struct("parent_column", "child_column")).alias("joins")
    refs = frames["cat_refs"].select("ref_ord", "ref_id", "name", "parent_table", "child_table", joins, "cardinality", "on_delete")
    indexes = frames["cat_indexes"].select("table_id", "index_ord", "name", F.array("column_id").alias("columns"), F.lit(False).alias("is_unique"))
    keys = spark.createDataFrame([], "table_id string, key_ord long, name string, columns array<string>, is_primary boolean")
    return Catalog(tables, frames["cat_columns"].withColumnRenamed("identity_", "identity"), refs, indexes, keys)
