"""The model linter: one small DataFrame per rule, in report order, with severities by configuration; and the score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..functions.text import split_identifier

#: Rule, category, default severity, title.
RULES = [
    ("table-empty", "keys", "error", "Tabla sin columnas"),
    ("table-no-pk", "keys", "error", "Tabla sin clave primaria"),
    ("column-duplicate", "keys", "error", "Columna duplicada"),
    ("pk-nullable", "keys", "error", "Clave primaria anulable"),
    ("fk-undeclared", "keys", "warning", "Posible FK sin declarar"),
    ("fk-no-index", "indexes", "warning", "Clave foránea sin índice"),
    ("text-no-length", "types", "warning", "Texto sin longitud"),
    ("varchar-out-of-range", "types", "warning", "VARCHAR2 fuera de rango"),
    ("identity-non-numeric", "types", "error", "Identity en columna no numérica"),
    ("index-duplicate", "indexes", "warning", "Índices duplicados"),
    ("naming-inconsistent", "naming", "info", "Convención de nombres inconsistente"),
    ("reference-orphan", "relations", "error", "Relación huérfana"),
    ("reference-missing-column", "relations", "error", "Relación con columna inexistente"),
    ("fk-non-pk", "relations", "info", "FK hacia columna no primaria"),
    ("self-reference", "relations", "info", "Auto-referencia"),
    ("many-to-many", "relations", "warning", "Relación N:M sin resolver"),
    ("delete-no-action", "relations", "info", "Borrado sin acción definida"),
]
#: Details; %1, %2, ... stand for the rule's values.
DETAILS = {
    "table-empty": "La tabla %1 no define ninguna columna.",
    "table-no-pk": "La tabla %1 no tiene clave primaria definida.",
    "column-duplicate": "La columna %2 aparece %3 veces en %1.",
    "pk-nullable": "La columna %2 forma parte de la PK de %1 pero admite NULL.",
    "fk-undeclared": "%1.%2 parece un identificador externo pero no participa en ninguna relación.",
    "fk-no-index": "%1.%2 es FK y no tiene índice, lo que penaliza los joins y los borrados.",
    "text-no-length": "%1.%2 usa %3 sin longitud declarada.",
    "varchar-out-of-range": "%1.%2 declara %3 caracteres; en Oracle conviene usar CLOB por encima de 4000.",
    "identity-non-numeric": "%1.%2 es IDENTITY pero su tipo es %3.",
    "index-duplicate": "%1: %2 e %3 cubren las mismas columnas.",
    "naming-inconsistent": "La tabla %1 no sigue el estilo dominante (%2).",
    "reference-orphan": "La relación %1 apunta a una tabla que no existe en el modelo.",
    "reference-missing-column": "La relación %1 referencia columnas que no existen.",
    "fk-non-pk": "%1 apunta a %2.%3, que no forma parte de la clave primaria.",
    "self-reference": "La relación %1 conecta %2 consigo misma; conviene documentarla.",
    "many-to-many": "La relación %1 es N:M; normalmente requiere una tabla intermedia.",
    "delete-no-action": "La relación %1 no define ON DELETE, así que el borrado fallará si hay hijos.",
}
#: What a type's name begins with.
TEXT = r"(?i)^(varchar|varchar2|nvarchar|char|nchar|string|text)"
NUMERIC = r"(?i)^(number|numeric|decimal|integer|int|smallint|bigint|float|double|real|serial)"
PENALTY = {"error": 6.0, "warning": 2.0, "info": 0.5}


def declared_length(length: Column, data_type: Column) -> Column:
    """The declared length, else the first parenthesised number of the type."""
    inner = F.nullif(F.regexp_extract(data_type, r"\((\d+)", 1), F.lit("")).cast("bigint")
    return F.coalesce(F.when(length > 0, length), inner)


def naming_style(code: Column) -> Column:
    return (
        F.when(F.contains(code, F.lit("_")), "snake_case").when(code.rlike("^[a-z]") & code.rlike("[A-Z]"), "camelCase")
        .when(code.rlike("^[A-Z]"), "PascalCase").otherwise("other")
    )


def effective_pk(catalog: Catalog) -> DataFrame:
    """tables with pk: the primary key, else that of the first primary key object, else empty."""
    first = catalog.keys.filter("is_primary").groupBy("table_id").agg(F.min_by("columns", "key_ord").alias("key_columns"))
    pk = F.coalesce("primary_key", "key_columns", F.array().cast("array<string>"))
    return catalog.tables.join(first, "table_id", "left").withColumn("pk", pk)


def issue(rows: DataFrame, rule: str, phase: int, owner: str, item: Column | str, table: str | None, *values) -> DataFrame:
    number = next(i for i, r in enumerate(RULES) if r[0] == rule)
    detail = F.lit(DETAILS[rule])
    for k, v in enumerate(values, 1):
        detail = F.replace(detail, F.lit(f"%{k}"), (F.col(v) if isinstance(v, str) else v).cast("string"))
    of = (F.col(table), F.col(table.replace("_id", "_name"))) if table else (F.lit(None).cast("string"),) * 2
    return rows.select(
        F.lit(rule).alias("rule_id"), detail.alias("detail"), of[0].alias("table_id"), of[1].alias("table_name"), F.lit(phase).alias("phase"),
        F.col(owner).cast("long").alias("owner"), F.lit(number).alias("rule_no"), (F.col(item) if isinstance(item, str) else item).cast("long").alias("item"),
    )


def all_findings(c: Catalog, only: str | None = None) -> DataFrame:
    tables = effective_pk(c).select("table_ord", "table_id", F.col("code").alias("table_code"), F.col("name").alias("table_name"), "pk", "primary_key")
    cols = c.columns.join(tables, "table_id")
    joins = c.refs.select("*", F.posexplode("joins").alias("join_ord", "j")).select("*", "j.*")
    fk = joins.select(F.col("child_column").alias("column_id")).distinct().withColumn("is_fk", F.lit(True))
    covered = c.indexes.select(F.get("columns", F.lit(0)).alias("column_id")).union(c.keys.select(F.explode("columns"))).distinct().withColumn("is_covered", F.lit(True))
    cols = cols.join(fk, "column_id", "left").join(covered, "column_id", "left").withColumn("len", declared_length(F.col("length"), F.col("data_type")))
    in_pk, zero = F.array_contains("pk", F.col("column_id")), F.lit(0)
    with_cols = c.columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    sized = tables.join(with_cols, "table_id", "left")
    text, numeric = F.col("data_type").rlike(TEXT), F.col("data_type").rlike(NUMERIC)
    last_word = F.lower(F.get(F.reverse(split_identifier(F.col("code"))), F.lit(0)))
    dup = cols.groupBy("table_ord", "table_id", "table_code", "table_name", F.lower("code").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("col_ord").alias("at")).filter("n > 1")
    same = Window.partitionBy("table_id", F.array_sort("columns")).orderBy("index_ord")
    twins = c.indexes.withColumns({"rn": F.row_number().over(same), "before": F.first("name").over(same)}).filter("rn > 1").join(tables, "table_id")
    styles = tables.withColumn("style", naming_style(F.col("table_code")))
    ranked = styles.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.min("table_ord").alias("at")).orderBy(F.desc("n"), "at").limit(1)
    dominant = ranked.filter("n >= 3 AND style <> 'other'").select(F.col("style").alias("dominant"))
    odd = styles.join(F.broadcast(dominant), F.col("style") != F.col("dominant"))
    t = lambda rows, rule, item, *v: issue(rows, rule, 0, "table_ord", item, "table_id", *v)
    found = [
        t(sized.filter("n IS NULL"), "table-empty", zero, "table_code"),
        t(sized.filter("size(pk) = 0 AND n > 0"), "table-no-pk", zero, "table_code"),
        t(dup, "column-duplicate", "at", "table_code", "low", "n"),
        t(cols.filter(in_pk & ~F.col("mandatory")), "pk-nullable", "col_ord", "table_code", "code"),
        t(cols.filter((last_word == "id") & ~in_pk & F.col("is_fk").isNull()), "fk-undeclared", "col_ord", "table_code", "code"),
        t(cols.filter("is_fk AND is_covered IS NULL"), "fk-no-index", "col_ord", "table_code", "code"),
        t(cols.filter(text & F.col("len").isNull()), "text-no-length", "col_ord", "table_code", "code", "data_type"),
        t(cols.filter(text & (F.col("len") > 4000)), "varchar-out-of-range", "col_ord", "table_code", "code", "len"),
        t(cols.filter(F.col("identity") & ~numeric), "identity-non-numeric", "col_ord", "table_code", "code", "data_type"),
        t(twins, "index-duplicate", "index_ord", "table_code", "before", "name"),
        t(odd, "naming-inconsistent", zero, "table_code", "dominant"),
    ]
    p = tables.select(F.col("table_id").alias("parent_table"), F.col("table_code").alias("parent_code"), "primary_key")
    q = tables.select(F.col("table_id").alias("child_table"), F.col("table_code").alias("child_code"), F.col("table_name").alias("child_name"))
    label = F.coalesce(F.nullif("name", F.lit("")), "ref_id")
    refs = c.refs.withColumn("label", label).join(p, "parent_table", "left").join(q, "child_table", "left")
    whole = refs.filter("parent_code IS NOT NULL AND child_code IS NOT NULL").withColumn("child_table_id", F.col("child_table")).withColumn("child_table_name", F.col("child_name"))
    known = c.columns.select("table_id", "column_id", "code")
    pairs = whole.select("*", F.posexplode("joins").alias("join_ord", "j")).select("*", "j.*")
    pairs = pairs.join(known.toDF("parent_table", "parent_column", "parent_column_code"), ["parent_table", "parent_column"], "left")
    pairs = pairs.join(known.toDF("child_table", "child_column", "child_column_code"), ["child_table", "child_column"], "left")
    bad = F.col("parent_column_code").isNull() | F.col("child_column_code").isNull()
    no_pk = ~F.array_contains(F.coalesce("primary_key", F.array().cast("array<string>")), F.col("parent_column"))
    r = lambda rows, rule, item, *v: issue(rows, rule, 1, "ref_ord", item, "child_table_id", *v)
    found += [
        issue(refs.filter("parent_code IS NULL OR child_code IS NULL"), "reference-orphan", 1, "ref_ord", zero, None, "label"),
        r(pairs.filter(bad), "reference-missing-column", "join_ord", "label"),
        r(pairs.filter(~bad & no_pk), "fk-non-pk", "join_ord", "label", "parent_code", "parent_column_code"),
        r(whole.filter("parent_table = child_table"), "self-reference", zero, "label", "parent_code"),
        r(whole.filter(F.col("cardinality").rlike(r"(?i)[NM]\s*:\s*[NM]")), "many-to-many", zero, "label"),
        r(whole.filter(F.col("on_delete").rlike("(?i)no action")), "delete-no-action", zero, "label"),
    ]
    return found[next(i for i, r in enumerate(RULES) if r[0] == only)] if only else reduce(DataFrame.unionByName, found)


def lint(catalog: Catalog, config: dict[str, str] | None = None, only: str | None = None) -> DataFrame:
    """Issues (rule_id, severity, category, title, detail, table_id, table_name, and the order columns phase, owner, rule_no,
    item). config: severity per rule; 'off' and unknown severities drop a rule's issues. only: one rule, with no work for the others."""
    severity = {r[0]: (config or {}).get(r[0], r[2]) for r in RULES}
    rules = [(r[0], severity[r[0]], r[1], r[3]) for r in RULES if severity[r[0]] in PENALTY]
    dim = catalog.tables.sparkSession.createDataFrame(rules, "rule_id string, severity string, category string, title string")
    return all_findings(catalog, only).join(F.broadcast(dim), "rule_id")


def lint_score(catalog: Catalog, config: dict[str, str] | None = None) -> DataFrame:
    """One row: score 0..100 and the counts of errors, warnings and infos."""
    count = [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in PENALTY]
    counts = lint(catalog, config).agg(*count)
    units = reduce(DataFrame.unionByName, [x.agg(F.count(F.lit(1)).alias("u")) for x in (catalog.tables, catalog.columns, catalog.refs)]).agg(F.sum("u").alias("units"))
    penalty = sum((F.col(f"n_{s}") * w for s, w in PENALTY.items()), F.lit(0.0))
    raw = 100 * (1 - penalty / F.greatest(F.lit(1), F.col("units")))
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) + 0.5).cast("long")
    return counts.crossJoin(F.broadcast(units)).select(score.alias("score"), *(f"n_{s}" for s in PENALTY))
