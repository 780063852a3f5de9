"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import annotations, data_quality, ddl, diff, edits, export, graph, layers, lint as L, migration, search
from ..operators.duplicates import compared_pairs
from ..session import ship_package
from ..sources.demo import demo_catalog
from ..sources.synthetic import oracle, synthetic_catalog as _catalog

FLAGSHIP = "fk_orphans"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{d}/{name}.parquet")


def synthetic_catalog(spark: SparkSession, d: str, keep: bool = False):
    return _catalog(ship_package(spark), d, keep)


@query("SELECT count(*) AS orphans FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
def fk_orphans(spark, d):
    return data_quality.orphan_count(table(spark, d, "orders"), table(spark, d, "customer"), {"o_custkey": "c_custkey"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS total FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark, d):
    return data_quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(oracle("""SELECT coalesce(t.table_id, e.a) AS table_id, coalesce(n, 0) AS relations FROM cat_tables t FULL JOIN (
    SELECT a, count(*) AS n FROM (SELECT parent_table AS a FROM cat_refs UNION ALL SELECT child_table FROM cat_refs) GROUP BY a) e ON e.a = t.table_id"""))  # fmt: skip
def relation_counts(spark, d):
    return graph.relation_counts(synthetic_catalog(spark, d))


@query(oracle("""SELECT t.table_id, count(b) AS degree FROM cat_tables t LEFT JOIN (
    SELECT parent_table AS a, child_table AS b FROM cat_refs UNION SELECT child_table, parent_table FROM cat_refs) e ON e.a = t.table_id GROUP BY t.table_id"""))  # fmt: skip
def distinct_degree(spark, d):
    return graph.distinct_degree(synthetic_catalog(spark, d))


@query(oracle("""SELECT table_id, n AS n_columns, CASE WHEN hi <= lo THEN 0 WHEN (n - lo) / (hi - lo) < 0.25 THEN 0 WHEN (n - lo) / (hi - lo) < 0.5 THEN 1
    WHEN (n - lo) / (hi - lo) < 0.75 THEN 2 ELSE 3 END AS bin FROM (SELECT *, min(n) OVER () AS lo, CAST(max(n) OVER () AS double) AS hi FROM (
    SELECT t.table_id, count(col_ord) AS n FROM cat_tables t LEFT JOIN cat_columns c ON c.table_id = t.table_id GROUP BY t.table_id))"""))  # fmt: skip
def heat_bins(spark, d):
    c = synthetic_catalog(spark, d)
    n = c.tables.join(c.columns, "table_id", "left").groupBy("table_id").agg(F.count("col_ord").alias("n_columns"))
    return graph.heat(n, "n_columns")


@query(oracle("""SELECT CASE WHEN code LIKE '%\\_%' ESCAPE '\\' THEN split_part(code, '_', 1) ELSE '(sin prefijo)' END AS prefix,
    table_ord, table_id FROM cat_tables"""))  # fmt: skip
def prefix_groups(spark, d):
    return graph.prefix_groups(synthetic_catalog(spark, d))


@query(oracle("""SELECT table_id, min(hop) AS hop FROM (WITH RECURSIVE e AS (SELECT parent_table AS a, child_table AS b FROM cat_refs UNION SELECT child_table, parent_table FROM cat_refs),
    r AS (SELECT 'table-1' AS table_id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN e ON e.a = r.table_id WHERE hop < 3) SELECT * FROM r) GROUP BY table_id HAVING min(hop) > 0"""))  # fmt: skip
def neighbours_within_3(spark, d):
    return graph.neighbours_within(synthetic_catalog(spark, d), "table-1", 3)


@query(oracle("""SELECT t.table_id, pk IS NULL AND EXISTS (SELECT 1 FROM cat_columns c WHERE c.table_id = t.table_id) AS no_pk,
    NOT EXISTS (SELECT 1 FROM cat_refs r WHERE t.table_id IN (r.parent_table, r.child_table)) AND (SELECT count(*) > 1 FROM cat_tables) AS orphan,
    (SELECT count(DISTINCT CASE WHEN r.parent_table = t.table_id THEN r.child_table ELSE r.parent_table END) FROM cat_refs r WHERE t.table_id IN (r.parent_table, r.child_table)) >= 8 AS god,
    EXISTS (SELECT 1 FROM cat_columns c WHERE c.table_id = t.table_id AND c.column_id IN (SELECT child_column FROM cat_refs) AND c.column_id NOT IN (SELECT column_id FROM cat_indexes)) AS fk_no_index,
    EXISTS (SELECT 1 FROM cat_columns c WHERE c.table_id = t.table_id AND c.column_id = t.pk AND NOT c.mandatory) AS nullable_key FROM cat_tables t"""))  # fmt: skip
def semantic_flags(spark, d):
    return graph.semantic_flags(synthetic_catalog(spark, d))


ISSUE = ["rule_id", "severity", "category", "title", "detail", "table_id", "table_name"]
RULE_SQL: dict[str, str] = {}


def _rule(rule: str, sql: str):
    def run(spark, d):
        return L.lint(synthetic_catalog(spark, d), only=rule).select("rule_id", "severity", "detail", "table_id")

    run.__name__ = "lint_" + rule.replace("-", "_")
    number = next(i for i, r in enumerate(L.RULES) if r[0] == rule)
    detail, k = f"'{L.DETAILS[rule]}'", 1
    while f"%{k}" in detail:
        detail, k = detail.replace(f"%{k}", f"' || CAST(v{k} AS varchar) || '"), k + 1
    RULE_SQL[rule] = f"SELECT '{rule}' AS rule_id, '{L.RULES[number][2]}' AS severity, '{L.RULES[number][1]}' AS category, '{L.RULES[number][3]}' AS title, {detail} AS detail, tid AS table_id FROM ({sql})"
    query(oracle(f"SELECT '{rule}' AS rule_id, '{L.RULES[number][2]}' AS severity, {detail} AS detail, tid AS table_id FROM ({sql})"))(run)


COLS = "cat_columns c JOIN cat_tables t ON t.table_id = c.table_id"
REFS = "cat_refs r JOIN cat_tables p ON p.table_id = r.parent_table JOIN cat_tables q ON q.table_id = r.child_table"
IS_TEXT, IS_NUMERIC = "regexp_matches(c.data_type, '(?i)^(varchar|varchar2|nvarchar|char|nchar|string|text)')", "regexp_matches(c.data_type, '(?i)^(number|numeric|decimal|integer|int|smallint|bigint|float|double|real|serial)')"
for _name, _sql in {
    "table-empty": "SELECT t.table_id AS tid, t.code AS v1 FROM cat_tables t WHERE table_id NOT IN (SELECT table_id FROM cat_columns)",
    "table-no-pk": "SELECT t.table_id AS tid, t.code AS v1 FROM cat_tables t WHERE pk IS NULL AND table_id IN (SELECT table_id FROM cat_columns)",
    "column-duplicate": f"SELECT t.table_id AS tid, t.code AS v1, lower(c.code) AS v2, count(*) AS v3 FROM {COLS} GROUP BY ALL HAVING count(*) > 1",
    "pk-nullable": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2 FROM {COLS} WHERE column_id = pk AND NOT mandatory",
    "fk-undeclared": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2 FROM {COLS} WHERE regexp_matches(c.code, '(?i)(^|[^a-z0-9])id$') AND column_id IS DISTINCT FROM pk AND column_id NOT IN (SELECT child_column FROM cat_refs)",
    "fk-no-index": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2 FROM {COLS} WHERE column_id IN (SELECT child_column FROM cat_refs) AND column_id NOT IN (SELECT column_id FROM cat_indexes)",
    "text-no-length": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2, c.data_type AS v3 FROM {COLS} WHERE {IS_TEXT} AND length IS NULL",
    "varchar-out-of-range": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2, length AS v3 FROM {COLS} WHERE {IS_TEXT} AND length > 4000",
    "identity-non-numeric": f"SELECT t.table_id AS tid, t.code AS v1, c.code AS v2, c.data_type AS v3 FROM {COLS} WHERE identity_ AND NOT {IS_NUMERIC}",
    "index-duplicate": "SELECT t.table_id AS tid, t.code AS v1, before AS v2, name AS v3 FROM (SELECT table_id, name, first_value(name) OVER w AS before, row_number() OVER w AS rn FROM cat_indexes WINDOW w AS (PARTITION BY table_id, column_id ORDER BY index_ord)) i JOIN (SELECT table_id, code FROM cat_tables) t ON t.table_id = i.table_id WHERE rn > 1",
    "naming-inconsistent": """SELECT table_id AS tid, code AS v1, dominant AS v2 FROM (SELECT *, CASE WHEN contains(code, '_') THEN 'snake_case' WHEN regexp_matches(code, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(code, '^[A-Z]') THEN 'PascalCase' ELSE 'other' END AS style FROM cat_tables) s,
        (SELECT style AS dominant FROM (SELECT CASE WHEN contains(code, '_') THEN 'snake_case' WHEN regexp_matches(code, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(code, '^[A-Z]') THEN 'PascalCase' ELSE 'other' END AS style, table_ord FROM cat_tables) GROUP BY style HAVING count(*) >= 3 ORDER BY count(*) DESC, min(table_ord) LIMIT 1) WHERE style <> dominant AND dominant <> 'other'""",
    "reference-orphan": "SELECT NULL AS tid, r.name AS v1 FROM cat_refs r WHERE parent_table NOT IN (SELECT table_id FROM cat_tables) OR child_table NOT IN (SELECT table_id FROM cat_tables)",
    "reference-missing-column": f"SELECT child_table AS tid, r.name AS v1 FROM {REFS} LEFT JOIN cat_columns c ON c.table_id = parent_table AND c.column_id = parent_column LEFT JOIN cat_columns e ON e.table_id = child_table AND e.column_id = child_column WHERE c.column_id IS NULL OR e.column_id IS NULL",
    "fk-non-pk": f"SELECT child_table AS tid, r.name AS v1, p.code AS v2, c.code AS v3 FROM {REFS} JOIN cat_columns c ON c.table_id = parent_table AND c.column_id = parent_column JOIN cat_columns e ON e.table_id = child_table AND e.column_id = child_column WHERE parent_column IS DISTINCT FROM p.pk",
    "self-reference": f"SELECT child_table AS tid, r.name AS v1, p.code AS v2 FROM {REFS} WHERE parent_table = child_table",
    "many-to-many": f"SELECT child_table AS tid, r.name AS v1 FROM {REFS} WHERE regexp_matches(cardinality, '(?i)[NM]\\s*:\\s*[NM]')",
    "delete-no-action": f"SELECT child_table AS tid, r.name AS v1 FROM {REFS} WHERE on_delete ILIKE '%no action%'",
}.items():
    _rule(_name, _sql)


ISSUES = f"(SELECT x.*, t.name AS table_name FROM ({' UNION ALL '.join(RULE_SQL.values())}) x LEFT JOIN cat_tables t ON t.table_id = x.table_id)"
SCORED = f"""(SELECT *, CAST(floor(greatest(0, least(100, 100 * (1 - (6 * n_error + 2 * n_warning + 0.5 * n_info) / greatest(1, units)))) + 0.5) AS bigint) AS score FROM (
    SELECT count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info,
        (SELECT count(*) FROM cat_tables) + (SELECT count(*) FROM cat_columns) + (SELECT count(*) FROM cat_refs) AS units FROM {ISSUES}))"""


@query(oracle(f"SELECT * FROM {ISSUES}"))
def lint_issues(spark, d):
    return L.lint(synthetic_catalog(spark, d, keep=True)).select(ISSUE)


@query(oracle(f"SELECT score, n_error, n_warning, n_info FROM {SCORED}"))
def lint_score(spark, d):
    return L.lint_score(synthetic_catalog(spark, d, keep=True))


@query(oracle(f"SELECT CASE WHEN score >= 85 THEN 'good' WHEN score >= 65 THEN 'fair' ELSE 'poor' END AS tone, CAST(score AS varchar) || '%' AS shown FROM {SCORED}"))
def lint_tone(spark, d):
    score = L.lint_score(synthetic_catalog(spark, d, keep=True))
    return score.select(layers.score_tone(F.col("score")).alias("tone"), T.percent(F.col("score") / 100).alias("shown"))


@query(oracle(f"SELECT rule_id, count(*) AS n FROM {ISSUES} WHERE severity = 'warning' GROUP BY rule_id"))
def warnings_by_rule(spark, d):
    return layers.by_severity(L.lint(synthetic_catalog(spark, d, keep=True)), "warning").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("SELECT count(*) * (count(*) - 1) // 2 AS compared FROM cat_tables"))
def compared_table_pairs(spark, d):
    return compared_pairs(synthetic_catalog(spark, d))


@query("""SELECT p_partkey, array_to_string(list_distinct(list_transform(range(1, length(lower(p_name)) + 1), lambda i: substr('#' || lower(p_name) || '#', i, 3))).list_sort(), ',') AS trigrams,
    round(CASE WHEN p_name = p_type THEN 1 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END, 6) AS lev FROM part""")  # fmt: skip
def text_similarity(spark, d):
    name = F.lower("p_name")
    lev = F.round(T.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.trigrams(name)), ",").alias("trigrams"), lev.alias("lev"))


@query("""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), '|') AS words FROM part""")
def split_identifiers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_identifier(F.col("p_name")), "|").alias("words"))


_SINGULAR = """CASE WHEN length(w) <= 3 OR w IN (%s) THEN w WHEN w LIKE '%%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%%es' AND length(w) > 4 AND NOT regexp_matches(w, '[aeiou]es$') THEN w[:-3]
    WHEN w LIKE '%%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END""" % ", ".join(f"'{x}'" for x in T.INVARIANT)
_STOP = ", ".join(f"'{x}'" for x in T.STOPWORDS)


@query(f"""WITH w AS (SELECT p_partkey AS doc_id, unnest(list_filter(list_transform(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS w FROM part),
    p AS (SELECT doc_id, {_SINGULAR} AS term, count(*) AS weight FROM w WHERE w NOT IN ({_STOP}) GROUP BY ALL),
    i AS (SELECT term, ln(1 + (SELECT count(*) FROM part) / (1 + count(*))) AS idf FROM p WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term)
    SELECT doc_id, round(sqrt(sum(power(weight * idf, 2))), 9) AS norm FROM p JOIN i USING (term) GROUP BY doc_id""")
def tfidf_norms(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return search.tfidf_norms(search.postings(docs), docs.agg(F.count(F.lit(1)).alias("n"))).select("doc_id", F.round("norm", 9).alias("norm"))


@query(oracle("""SELECT t.table_ord, t.table_id, 'CREATE TABLE "' || t.name || '" (' || chr(10) || coalesce(body, '') ||
        CASE WHEN pk.name IS NULL THEN '' ELSE ',' || chr(10) || '  CONSTRAINT "PK_' || t.name || '" PRIMARY KEY ("' || pk.name || '")' END || chr(10) || ');' || coalesce(chr(10) || chr(10) || idx, '') AS ddl
    FROM cat_tables t LEFT JOIN cat_columns pk ON pk.column_id = t.pk LEFT JOIN (SELECT table_id, string_agg('  "' || name || '" ' || CASE data_type WHEN 'VARCHAR' THEN 'VARCHAR2(' || coalesce(CAST(length AS varchar), '255') || ')'
        WHEN 'INTEGER' THEN 'NUMBER' WHEN 'DATE' THEN 'DATE' ELSE data_type || coalesce('(' || CAST(length AS varchar) || ')', '') END || CASE WHEN identity_ THEN ' GENERATED BY DEFAULT AS IDENTITY' ELSE '' END ||
        CASE WHEN mandatory THEN ' NOT NULL' ELSE '' END, ',' || chr(10) ORDER BY col_ord) AS body FROM cat_columns GROUP BY table_id) c ON c.table_id = t.table_id
    LEFT JOIN (SELECT i.table_id, string_agg('CREATE INDEX "' || i.name || '" ON "' || t.name || '" ("' || c.name || '");', chr(10) || chr(10) ORDER BY index_ord) AS idx
        FROM cat_indexes i JOIN cat_tables t ON t.table_id = i.table_id JOIN cat_columns c ON c.column_id = i.column_id GROUP BY i.table_id) x ON x.table_id = t.table_id"""))  # fmt: skip
def ddl_tables(spark, d):
    return ddl.table_ddl(synthetic_catalog(spark, d))


@query(oracle("""SELECT ref_ord, ref_id, 'ALTER TABLE "' || q.name || '" ADD CONSTRAINT "' || r.name || '" FOREIGN KEY ("' || cc.name || '") REFERENCES "' || p.name || '" ("' || pc.name || '");' AS ddl
    FROM cat_refs r JOIN cat_tables p ON p.table_id = parent_table JOIN cat_tables q ON q.table_id = child_table
    JOIN cat_columns pc ON pc.table_id = parent_table AND pc.column_id = parent_column JOIN cat_columns cc ON cc.table_id = child_table AND cc.column_id = child_column"""))  # fmt: skip
def ddl_foreign_keys(spark, d):
    return ddl.reference_ddl(synthetic_catalog(spark, d))


def _versions(spark, d):
    """The customers, and a second version: some renamed, some gone, some new, some in another segment."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    k = F.col("id")
    after = base.filter(k % 10 != 3).select(
        F.when(k % 10 == 4, k + 10_000_000).otherwise(k).alias("id"), F.when(k % 10 == 4, F.concat("code", F.lit("-new"))).otherwise(F.col("code")).alias("code"),
        F.when(k % 10 == 5, "OTHER").otherwise(F.col("segment")).alias("segment"), "nation",
    )
    return base, after


@query("""SELECT kind, count(*) AS n, CAST(sum(id) AS bigint) AS ids FROM (
    SELECT CASE c_custkey % 10 WHEN 3 THEN 'removed' WHEN 4 THEN 'removed' ELSE 'modified' END AS kind, c_custkey AS id FROM customer WHERE c_custkey % 10 IN (3, 4) OR (c_custkey % 10 = 5 AND c_mktsegment <> 'OTHER')
    UNION ALL SELECT 'added', c_custkey + 10000000 FROM customer WHERE c_custkey % 10 = 4) GROUP BY kind""")  # fmt: skip
def diff_by_kind(spark, d):
    base, after = _versions(spark, d)
    found = diff.diff_rows(base, after, "id", "id", ["code"], ["code", "segment", "nation"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


CSV_ROW = "concat_ws(',', " + ", ".join(
    f"""CASE WHEN regexp_matches(coalesce({c}, ''), '[",\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END""" for c in ("severity", "rule_id", "title", "detail", "table_name", "category")
) + ")"
JSON_ROW = "'{' || " + " || ',' || ".join(f"""'"{c}":' || coalesce('"' || replace({c}, '"', '\\"') || '"', 'null')""" for c in ISSUE) + " || '}'"


@query(oracle(f"SELECT {CSV_ROW} AS line FROM {ISSUES}"))
def export_csv(spark, d):
    return export.csv_lines(L.lint(synthetic_catalog(spark, d, keep=True))).select("line")


@query(oracle(f"SELECT {JSON_ROW} AS line FROM {ISSUES}"))
def export_json(spark, d):
    return export.json_lines(L.lint(synthetic_catalog(spark, d, keep=True))).select("line")


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS double[]) AS e, sqrt(list_dot_product(CAST(embedding AS double[]), CAST(embedding AS double[]))) AS n FROM embeddings WHERE embedding IS NOT NULL)
    SELECT q_id, vec_id, score FROM (SELECT q.vec_id AS q_id, u.vec_id, round(CASE WHEN q.n * u.n = 0 THEN 0 ELSE list_dot_product(q.e, u.e) / (q.n * u.n) END, 6) AS score
    FROM u AS q JOIN u ON q.vec_id <> u.vec_id AND len(q.e) = len(u.e) WHERE q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) <= 20""")
def cosine_top_20(spark, d):
    v = table(spark, d, "embeddings")
    return search.cosine_top(v, v.filter("vec_id % 100 = 0"), 20)


@query(oracle("""SELECT min(hop) + 1 AS steps FROM (WITH RECURSIVE e AS (SELECT parent_table AS a, child_table AS b FROM cat_refs UNION SELECT child_table, parent_table FROM cat_refs),
    r AS (SELECT 'table-1' AS table_id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN e ON e.a = r.table_id WHERE hop < 20) SELECT * FROM r) WHERE table_id = 'table-9' HAVING min(hop) IS NOT NULL"""))  # fmt: skip
def shortest_path_steps(spark, d):
    path = graph.shortest_path(synthetic_catalog(spark, d), "table-1", "table-9")
    return path.agg(F.count(F.lit(1)).alias("steps")).filter("steps > 0")


@query()
def fk_cycles(spark, d):
    c = synthetic_catalog(spark, d)
    return graph.fk_cycles(c.tables, c.refs).select("cycle", F.array_join("tables", ",").alias("tables"))


RELATION_SIDES = """(SELECT *, parent_table AS table_id, 'child' AS direction, child_table AS other_table FROM cat_refs UNION ALL
    SELECT *, child_table, 'parent', parent_table FROM cat_refs WHERE parent_table <> child_table)"""


@query(oracle(f"""SELECT r.table_id, r.ref_ord, r.ref_id, r.direction, r.other_table, coalesce(coalesce(pc.code, r.parent_column) || ' → ' || coalesce(cc.code, r.child_column), '') AS joins,
        coalesce(i.names, '') AS covering FROM {RELATION_SIDES} r JOIN cat_tables p ON p.table_id = r.parent_table JOIN cat_tables q ON q.table_id = r.child_table
    LEFT JOIN cat_columns pc ON pc.table_id = r.parent_table AND pc.column_id = r.parent_column LEFT JOIN cat_columns cc ON cc.table_id = r.child_table AND cc.column_id = r.child_column
    LEFT JOIN (SELECT table_id, column_id, string_agg(name, ', ' ORDER BY index_ord) AS names FROM cat_indexes GROUP BY ALL) i ON i.table_id = r.child_table AND i.column_id = r.child_column"""))  # fmt: skip
def relations(spark, d):
    return graph.relations_of(synthetic_catalog(spark, d))


@query(oracle("SELECT table_id, (table_ord % 3) * 340.0::double AS x, floor(table_ord / 3) * 260.0::double AS y FROM cat_tables"))
def grid_positions(spark, d):
    return graph.grid_positions(synthetic_catalog(spark, d))


@query(oracle("SELECT DISTINCT split_part(code, '_', 1) AS prefix FROM cat_tables WHERE instr(code, '_') > 1"))
def table_prefixes(spark, d):
    return search.prefixes(synthetic_catalog(spark, d))


@query(oracle("""SELECT t.table_id FROM cat_tables t LEFT JOIN (SELECT table_id, string_agg(name || ' ' || code, ' ' ORDER BY col_ord) AS cols FROM cat_columns GROUP BY table_id) c ON c.table_id = t.table_id
    WHERE contains(lower(concat_ws(' ', t.name, t.code, c.cols)), 'blue ro')"""))  # fmt: skip
def filter_tables(spark, d):
    return search.filter_tables(synthetic_catalog(spark, d), " Blue ro ").select("table_id")


@query()
def lexical_search(spark, d):
    return search.lexical_search(search.table_documents(synthetic_catalog(spark, d)), "supplier green").select("doc_id", F.round("score", 6).alias("score"))


@query(oracle("""SELECT i.table_id, i.index_ord, 'CREATE INDEX "' || i.name || '" ON "' || t.name || '" ("' || c.name || '");' AS ddl
    FROM cat_indexes i JOIN cat_tables t ON t.table_id = i.table_id JOIN cat_columns c ON c.column_id = i.column_id"""))  # fmt: skip
def ddl_indexes(spark, d):
    return ddl.index_ddl(synthetic_catalog(spark, d))


def second_version(c):
    """The catalog without every tenth table, with other comments and lengths, as a second version of it."""
    at, n = F.col("table_ord") % 10, F.col("col_ord") % 7
    tables = c.tables.filter(at != 3).withColumn("comment", F.when(at == 5, "v2").otherwise(F.col("comment")))
    columns = c.columns.withColumn("length", F.when(n == 0, F.coalesce("length", F.lit(0)) + 1).otherwise(F.col("length")))
    return type(c)(tables, columns.join(tables.select("table_id"), "table_id", "left_semi"), c.refs, c.indexes, c.keys)


def _changed(label: str, before: str, after: str) -> str:
    """A field's change as JSON, where what is shown before and after differs."""
    b, a = (f"coalesce(nullif(CAST({x} AS varchar), ''), '—')" for x in (before, after))
    return f"""CASE WHEN {b} <> {a} THEN '{{"field":"{label}","before":"' || {b} || '","after":"' || {a} || '"}}' END"""


_COLUMN_CHANGES = ", ".join(_changed(*x) for x in (
    ("Código", "b.code", "t.code"), ("Nombre", "b.name", "t.name"), ("Tipo", "b.data_type", "t.data_type"), ("Longitud", "nullif(b.length, 0)", "nullif(t.length_2, 0)"),
    ("Nullable", "CASE WHEN b.mandatory THEN 'NOT NULL' ELSE 'NULL' END", "CASE WHEN t.mandatory THEN 'NOT NULL' ELSE 'NULL' END"), ("Identity", "b.identity_", "t.identity_"),
))


# Both versions have the same columns but for their lengths: of one code in a table the last is the match, for the first.
@query(oracle(f"""SELECT 'table' AS object_type, CASE table_ord % 10 WHEN 3 THEN 'removed' ELSE 'modified' END AS kind, table_id AS id, name, CAST(NULL AS varchar) AS parent,
        CASE table_ord % 10 WHEN 3 THEN '[]' ELSE '[{{"field":"Comentario","before":"—","after":"v2"}}]' END AS changes FROM cat_tables WHERE table_ord % 10 IN (3, 5)
    UNION ALL SELECT 'column', kind, id, name, parent, CASE kind WHEN 'modified' THEN changes ELSE '[]' END FROM (
        WITH c AS (SELECT k.*, CASE WHEN col_ord % 7 = 0 THEN coalesce(length, 0) + 1 ELSE length END AS length_2, h.name AS parent,
                arg_max(column_id, col_ord) OVER (PARTITION BY k.table_id, lower(trim(k.code))) AS hit
            FROM cat_columns k JOIN cat_tables h ON h.table_id = k.table_id WHERE h.table_ord % 10 <> 3),
        b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY hit ORDER BY col_ord) = 1 THEN hit END AS target FROM c)
        SELECT CASE WHEN b.column_id IS NULL THEN 'added' WHEN t.column_id IS NULL THEN 'removed' ELSE 'modified' END AS kind, coalesce(t.column_id, b.column_id) AS id, coalesce(t.name, b.name) AS name,
            coalesce(t.parent, b.parent) AS parent, '[' || array_to_string(list_filter([{_COLUMN_CHANGES}], lambda x: x IS NOT NULL), ',') || ']' AS changes
        FROM b FULL JOIN c t ON t.column_id = b.target) WHERE kind <> 'modified' OR changes <> '[]'"""))  # fmt: skip
def diff_models(spark, d):
    c = synthetic_catalog(spark, d, keep=True)
    return diff.diff_models(c, second_version(c)).withColumn("changes", F.to_json("changes"))


@query(f"SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified, count(*) AS total FROM ({ORACLES['diff_models']})")
def diff_totals(spark, d):
    """The summary of the model diff."""
    c = synthetic_catalog(spark, d, keep=True)
    return diff.diff_summary(diff.diff_models(c, second_version(c)))


@query(oracle(f"""SELECT metric, table_id, value, CASE WHEN hi <= lo THEN 0 ELSE least(3, CAST(floor((value - lo) * 4 / CAST(hi - lo AS double)) AS integer)) END AS bin
    FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM (
        SELECT metric, t.table_id, count(x.table_id) AS value FROM cat_tables t CROSS JOIN (VALUES ('columns'), ('indexes'), ('issues'), ('relations')) m(metric) LEFT JOIN (
            SELECT 'columns' AS metric, table_id FROM cat_columns UNION ALL SELECT 'indexes', table_id FROM cat_indexes UNION ALL SELECT 'issues', table_id FROM {ISSUES}
            UNION ALL SELECT 'relations', parent_table FROM cat_refs UNION ALL SELECT 'relations', child_table FROM cat_refs) x USING (metric, table_id) GROUP BY ALL))"""))  # fmt: skip
def heat_of_tables(spark, d):
    """Every metric of the heat map with its bins."""
    c = synthetic_catalog(spark, d, keep=True)
    issues = L.lint(c)
    found = [graph.heat(graph.heat_values(c, m, issues), "value").select(F.lit(m).alias("metric"), "table_id", "value", "bin") for m in ("columns", "indexes", "issues", "relations")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query()
def migration_script(spark, d):
    c = synthetic_catalog(spark, d, keep=True)
    return migration.script_lines(c, second_version(c))


@query()
def rollback_file(spark, d):
    c = synthetic_catalog(spark, d, keep=True)
    return migration.script_file(c, second_version(c), rollback=True).withColumn("at", F.to_json("at"))


@query()
def migration_impact(spark, d):
    c = synthetic_catalog(spark, d, keep=True)
    found = migration.impact(c, second_version(c))
    return found.withColumns({k: F.to_json(k) for k in ("changes", "child_tables", "outgoing_fks", "indexes")})


@query(oracle(f"""SELECT 0 AS section, '# Informe de calidad — synthetic' || chr(10) || chr(10) || '- **Fecha:** 1/1/2026' || chr(10) || '- **Puntuación:** ' || score || '/100' || chr(10) || '- **Errores:** ' || n_error || chr(10) ||
    '- **Avisos:** ' || n_warning || chr(10) || '- **Sugerencias:** ' || n_info || chr(10) || CASE WHEN n_error + n_warning + n_info = 0 THEN chr(10) || '{export.NO_ISSUES}' ELSE '' END AS line FROM {SCORED}
    UNION ALL SELECT section, '## ' || title || ' (' || n || ')' || chr(10) || chr(10) || replace('{export.TABLE_HEAD.replace(chr(10), "~")}', '~', chr(10)) FROM (SELECT severity, count(*) AS n FROM {ISSUES} GROUP BY severity) JOIN (VALUES {", ".join(str((i + 1, *x)) for i, x in enumerate(export.SEVERITIES))}) h(section, severity, title) USING (severity)
    UNION ALL SELECT CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, '| `' || rule_id || '` | ' || title || ' | ' || coalesce(table_name, '—') || ' | ' || replace(detail, '|', '\\|') || ' |' FROM {ISSUES}"""))  # fmt: skip
def export_markdown(spark, d):
    c = synthetic_catalog(spark, d, keep=True)
    return export.markdown_lines(L.lint(c), L.lint_score(c), "synthetic", "1/1/2026").select("section", "line")


@query()
def export_report(spark, d):
    """The report object as lines; to be written with export.write_lines."""
    c = synthetic_catalog(spark, d, keep=True)
    return export.report_object(L.lint(c), L.lint_score(c), "synthetic", T.iso_time(F.lit("2026-01-01 00:00:00").cast("timestamp")))


@query(oracle("""SELECT c.table_id, c.column_id, CASE WHEN t.pk = c.column_id THEN 'PK' WHEN EXISTS (SELECT 1 FROM cat_refs r WHERE r.child_table = c.table_id AND r.child_column = c.column_id) THEN 'FK' ELSE 'C' END AS badge
    FROM cat_columns c LEFT JOIN cat_tables t ON t.table_id = c.table_id"""))  # fmt: skip
def column_badges(spark, d):
    return layers.column_badges(synthetic_catalog(spark, d))


@query(oracle("""SELECT c.table_id, c.column_id, c.code FROM cat_columns c JOIN cat_tables t ON t.table_id = c.table_id
    WHERE t.pk = c.column_id OR EXISTS (SELECT 1 FROM cat_refs r WHERE r.child_table = c.table_id AND r.child_column = c.column_id)"""))  # fmt: skip
def key_columns(spark, d):
    return layers.visible_columns(synthetic_catalog(spark, d), hide_non_key=True).select("table_id", "column_id", "code")


FOCUS = """(SELECT DISTINCT table_id FROM (WITH RECURSIVE e AS (SELECT parent_table AS a, child_table AS b FROM cat_refs UNION SELECT child_table, parent_table FROM cat_refs),
    r AS (SELECT 'table-1' AS table_id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN e ON e.a = r.table_id WHERE hop < 1) SELECT * FROM r))"""


@query(oracle(f"SELECT table_id FROM {FOCUS}"))
def focus_tables(spark, d):
    return layers.focus_set(synthetic_catalog(spark, d), "table-1", 1)


@query(oracle(f"""SELECT ref_ord, ref_id, parent_table IN (SELECT table_id FROM {FOCUS}) AND child_table IN (SELECT table_id FROM {FOCUS}) AS visible,
    CASE WHEN ref_ord % 5 = 0 THEN 'path' ELSE 'emphasis' END AS "class" FROM cat_refs"""))  # fmt: skip
def edge_classes(spark, d):
    c = synthetic_catalog(spark, d)
    return layers.edges(c, "fk", layers.focus_set(c, "table-1", 1), c.refs.filter("ref_ord % 5 = 0"))


@query(oracle("""SELECT a AS table_id, coalesce(array_to_string(list_sort(list(DISTINCT b)), ','), '') AS neighbours FROM (
    SELECT parent_table AS a, child_table AS b FROM cat_refs UNION SELECT child_table, parent_table FROM cat_refs UNION SELECT table_id, NULL FROM cat_tables) GROUP BY a"""))  # fmt: skip
def adjacency(spark, d):
    return graph.adjacency(synthetic_catalog(spark, d)).withColumn("neighbours", F.array_join("neighbours", ","))


@query("""SELECT table_id, count(*) AS notes FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'table-1' ELSE 'table-2' END AS table_id FROM documents
    WHERE trim(lang) <> '' AND doc_id % 5 <> 0) GROUP BY table_id""")
def notes_by_table(spark, d):
    """Notes made from documents: added, some removed, then counted."""
    docs = table(spark, d, "documents")
    new = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, "table-1").otherwise("table-2").alias("table_id"), F.lit("").alias("column_id"), F.col("lang").alias("text"))
    notes = annotations.add(spark.createDataFrame([], "id string, table_id string, column_id string, text string, created_at long, updated_at long"), new, 0)
    return annotations.counts(annotations.remove(notes, docs.filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id"))))


@query(oracle("""SELECT table_id, col_ord AS draft_ord, 'o:Column' AS element, 'file-' || CAST(col_ord AS varchar) AS pd_id, child, value FROM (
    SELECT *, 'a:Name' AS child, name || ' 2' AS value FROM cat_columns WHERE col_ord % 4 = 0 UNION ALL SELECT *, 'a:Length', CASE WHEN col_ord % 2 = 0 THEN '77' END FROM cat_columns WHERE col_ord % 3 = 0 AND (CASE WHEN col_ord % 2 = 0 THEN 77 END) IS DISTINCT FROM length
    UNION ALL SELECT *, 'a:Column.Mandatory', CASE WHEN NOT mandatory THEN '1' END FROM cat_columns WHERE col_ord % 5 = 0) WHERE table_id IN (SELECT table_id FROM cat_tables)"""))  # fmt: skip
def column_edits(spark, d):
    """What drafts with other names, lengths and flags change in the files."""
    c = synthetic_catalog(spark, d)
    c = type(c)(c.tables.withColumn("pd_id", F.col("table_id")), c.columns.withColumn("pd_id", F.concat(F.lit("file-"), F.col("col_ord").cast("string"))), c.refs, c.indexes, c.keys)
    tables, columns = edits.table_drafts(c)
    k = F.col("draft_ord")
    columns = columns.withColumns({
        "name": F.when(k % 4 == 0, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")), "mandatory": F.when(k % 5 == 0, ~F.col("mandatory")).otherwise(F.col("mandatory")),
        "length": F.when(k % 3 == 0, F.when(k % 2 == 0, " 77 ").otherwise("none")).otherwise(F.col("length")),
    })
    return edits.build_edits(c, tables, columns).select("table_id", "draft_ord", "element", "pd_id", "child", "value")


@query("SELECT * FROM (VALUES ('FK_Order_Customer', 'Customer', 'Order'), ('FK_OrderLine_Order', 'Order', 'OrderLine')) v(name, parent, child)")
def demo_references(spark, d):
    c = demo_catalog(spark)
    p, q = (c.tables.select(F.col("table_id").alias(f"{x}_table"), F.col("code").alias(x)) for x in ("parent", "child"))
    return c.refs.join(p, "parent_table").join(q, "child_table").select("name", "parent", "child")


from . import search_queries, source_queries  # noqa: E402, F401  register their queries
