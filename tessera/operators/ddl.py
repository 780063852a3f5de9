"""Oracle DDL of a catalog: type translation, tables with their indexes, and foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Catalog

#: Input types, and what they become without a length, with one (n), and with length and precision (n, p).
TYPES = [
    (("INT8", "INT4", "INT2", "SERIAL"), "NUMBER", "NUMBER(n)", "NUMBER(n)"),
    (("FLOAT8", "FLOAT4", "DOUBLE PRECISION", "REAL"), "NUMBER", "NUMBER", "NUMBER"),
    (("BOOL", "BOOLEAN"), "NUMBER(1)", "NUMBER(1)", "NUMBER(1)"),
    (("BYTEA", "BLOB"), "BLOB", "BLOB", "BLOB"),
    (("TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP"), "TIMESTAMP", "TIMESTAMP", "TIMESTAMP"),
    (("MONEY",), "NUMBER(16, 2)", "NUMBER(16, 2)", "NUMBER(16, 2)"),
    (("UNKNOWN", ""), "VARCHAR2(255)", "VARCHAR2(255)", "VARCHAR2(255)"),
    (("INTEGER", "INT"), "NUMBER", "NUMBER", "NUMBER"),
    (("BIGINT",), "NUMBER(19)", "NUMBER(19)", "NUMBER(19)"),
    (("SMALLINT",), "NUMBER(5)", "NUMBER(5)", "NUMBER(5)"),
    (("VARCHAR",), "VARCHAR2(255)", "VARCHAR2(n)", "VARCHAR2(n)"),
    (("CHAR",), "CHAR(1)", "CHAR(n)", "CHAR(n)"),
    (("TEXT", "LONGTEXT", "CLOB"), "CLOB", "CLOB", "CLOB"),
    (("DATE", "DATETIME"), "DATE", "DATE", "DATE"),
    (("DECIMAL", "NUMERIC", "FLOAT", "DOUBLE"), "NUMBER", "NUMBER(n)", "NUMBER(n, p)"),
]


def oracle_type(data_type: Column, length: Column, precision: Column | None = None) -> Column:
    """The Oracle type; a type that isn't listed stays, trimmed and in upper case, with its length and precision; a missing one is VARCHAR."""
    base = F.upper(F.regexp_replace(F.coalesce(data_type, F.lit("VARCHAR")), r"^\s+|\s+$", ""))
    n = F.when(length > 0, length).cast("string")
    p = F.when(precision > 0, precision).cast("string") if precision is not None else F.lit(None).cast("string")

    def filled(plain: Column, one: Column, two: Column) -> Column:
        put = lambda text: F.replace(F.replace(text, F.lit("n"), n), F.lit("p"), p)  # noqa: E731  null where a number is missing
        return F.coalesce(put(two), F.replace(one, F.lit("n"), n), plain)

    out = F.when(F.lit(False), "")
    for names, *targets in TYPES:
        out = out.when(base.isin(*names), filled(*(F.lit(t) for t in targets)))
    other = F.coalesce(F.concat(base, F.lit("("), n, F.lit(", "), p, F.lit(")")), F.concat(base, F.lit("("), n, F.lit(")")), base)
    return out.otherwise(other)


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def default_value(value: Column) -> Column:
    """A default as SQL: numbers, truth values and NULL in upper case, quoted texts and functions as they are, others quoted;
    null for a blank one."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    plain = v.rlike(r"^\d+(\.\d+)?$") | v.rlike("(?i)^TRUE|FALSE$") | v.rlike("(?i)^NULL$")
    kept = v.rlike("^['\"]") | v.rlike(r"(?i)\b(SYSDATE|CURRENT_DATE|CURRENT_TIMESTAMP|USER|SYSTIMESTAMP)\b")
    return F.when(v == "", None).when(plain, F.upper(v)).when(kept, v).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")))


def column_map(c: Catalog) -> DataFrame:
    """(table_id, known): a table's columns (code, name) by id, code and name; of equal keys the first column counts."""
    named = c.columns.select("table_id", "col_ord", "code", "name", F.explode(F.array_distinct(F.array_compact(F.array("column_id", "code", "name")))).alias("k"))
    first = named.groupBy("table_id", "k").agg(F.min_by(F.struct("code", "name"), "col_ord").alias("v"))
    return first.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))


def found(known: Column, ids: Column, field: str) -> Column:
    """A field of the columns with the given ids, in the order of the ids; ids without a column are skipped."""
    return F.array_compact(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.try_element_at(known, i)[field]))


def picked(known: Column, ids: Column) -> Column:
    """The quoted names of the columns with the given ids."""
    return F.transform(found(known, ids, "name"), quoted)


def column_type(prefix: str = "") -> Column:
    return oracle_type(*(F.col(prefix + f) for f in ("data_type", "length", "precision")))


def table_columns(c: Catalog) -> DataFrame:
    """tables with t, the quoted name, c, their columns in order (col_ord, line), and known, as column_map has it."""
    c = c.complete()
    name = quoted(F.col("name"))
    line = F.concat_ws(
        " ", F.concat(F.lit("  "), name), column_type(), F.when(F.col("identity"), "GENERATED BY DEFAULT AS IDENTITY"),
        F.when(F.col("mandatory"), "NOT NULL"), F.concat(F.lit("DEFAULT "), default_value(F.col("default_value"))),
    )
    lists = c.columns.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_ord", line.alias("line")))).alias("c"))
    none = F.expr("cast(array() as array<struct<col_ord:bigint,line:string>>)")
    t = c.tables.withColumn("t", name).join(lists, "table_id", "left").join(column_map(c), "table_id", "left")
    return t.withColumns({"c": F.coalesce("c", none), "known": F.coalesce("known", F.expr("cast(map() as map<string,struct<code:string,name:string>>)"))})


def index_ddl(c: Catalog) -> DataFrame:
    """(table_id, index_ord, ddl) of every index."""
    i = c.indexes.withColumnRenamed("name", "index_name").join(table_columns(c).select("table_id", "t", "known"), "table_id")
    kind = F.when(F.col("is_unique"), "CREATE UNIQUE INDEX ").otherwise("CREATE INDEX ")
    ddl = F.concat(kind, quoted(F.col("index_name")), F.lit(" ON "), F.col("t"), F.lit(" ("), F.array_join(picked(F.col("known"), F.col("columns")), ", "), F.lit(");"))
    return i.select("table_id", "index_ord", ddl.alias("ddl"))


def table_ddl(c: Catalog) -> DataFrame:
    """(table_ord, table_id, ddl): CREATE TABLE with its columns in order and its primary key, then its indexes."""
    first = c.keys.filter("is_primary").groupBy("table_id").agg(F.min_by("name", "key_ord").alias("key_name"))
    indexes = index_ddl(c).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("index_ord", "ddl"))).alias("i"))
    t = table_columns(c).join(first, "table_id", "left").join(indexes, "table_id", "left")
    pk = picked(F.col("known"), F.col("primary_key"))
    key_name = quoted(F.coalesce(F.nullif("key_name", F.lit("")), F.concat(F.lit("PK_"), F.col("name"))))
    constraint = F.when(F.size(pk) > 0, F.array(F.concat(F.lit("  CONSTRAINT "), key_name, F.lit(" PRIMARY KEY ("), F.array_join(pk, ", "), F.lit(")"))))
    body = F.concat(F.transform("c", lambda x: x["line"]), F.coalesce(constraint, F.array().cast("array<string>")))
    create = F.concat(F.lit("CREATE TABLE "), F.col("t"), F.lit(" (\n"), F.array_join(body, ",\n"), F.lit("\n);"))
    return t.select("table_ord", "table_id", F.concat_ws("\n\n", create, F.array_join(F.transform("i", lambda x: x["ddl"]), "\n\n")).alias("ddl"))


def reference_ddl(c: Catalog) -> DataFrame:
    """(ref_ord, ref_id, ddl): ALTER TABLE ... FOREIGN KEY; references without both tables, or without columns, are left out."""
    t = table_columns(c).select("table_id", "t", "known")
    r = c.refs.join(t.toDF("parent_table", "p", "p_known"), "parent_table").join(t.toDF("child_table", "q", "q_known"), "child_table")
    child, parent = (picked(F.col(k), F.transform("joins", lambda j: j[f])) for k, f in (("q_known", "child_column"), ("p_known", "parent_column")))
    ddl = F.concat(
        F.lit("ALTER TABLE "), F.col("q"), F.lit(" ADD CONSTRAINT "), quoted(F.col("name")), F.lit(" FOREIGN KEY ("),
        F.array_join(child, ", "), F.lit(") REFERENCES "), F.col("p"), F.lit(" ("), F.array_join(parent, ", "), F.lit(");"),
    )
    return r.filter((F.size(child) > 0) & (F.size(parent) > 0)).select("ref_ord", "ref_id", ddl.alias("ddl"))


def model_ddl(c: Catalog) -> DataFrame:
    """(part, item, ddl): all tables in order, then all foreign keys."""
    tables = table_ddl(c).select(F.lit(0).alias("part"), F.col("table_ord").alias("item"), "ddl")
    return tables.union(reference_ddl(c).select(F.lit(1), "ref_ord", "ddl"))
