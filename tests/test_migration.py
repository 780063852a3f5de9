"""The migration script between two small catalogs, by hand."""

import pytest
from pyspark.sql import functions as F
from test_operators import catalog

from tessera.operators import migration


@pytest.fixture(scope="module")
def sales(spark):
    return catalog(
        spark,
        [("h", "HEAD", ["h1", "h2"]), ("d", "DETAIL", ["d1"])],
        [("h", "h1", "H_ID", "VARCHAR2", 50, True, False), ("h", "h2", "H_YEAR", "VARCHAR2", 50, True, False), ("h", "h3", "H_NOTE", "VARCHAR2", 50, False, False),
         ("d", "d1", "D_ID", "VARCHAR2", 50, True, False), ("d", "d2", "D_H_ID", "VARCHAR2", 50, True, False), ("d", "d3", "D_H_YEAR", "VARCHAR2", 50, True, False)],
        [("FK_HEAD_DETAIL", "h", "d", "h1", "d2")],
        [("h", "IX_YEAR", ["h2"]), ("d", "IX_DETAIL", ["d2", "d3"])],
    )


def changed(c, **frames):
    return type(c)(*(frames.get(k, getattr(c, k)) for k in ("tables", "columns", "refs", "indexes", "keys")))


def script(lines):
    return [(r.section, r.line) for r in lines.orderBy("section", "owner", "part", "item").collect()]


def test_nothing_to_do(spark, sales):
    assert script(migration.migration_statements(sales, sales)) == []


def test_column_of_a_key_and_an_index_changes(spark, sales):
    wider = changed(sales, columns=sales.columns.withColumn("length", F.when(F.col("column_id") == "h2", 120).otherwise(F.col("length"))))
    lines = migration.script_lines(sales, wider)
    got = script(lines)
    assert [s for s, _ in got] == [0, 0, 1, 2, 3, 5, 6, 7, 8]
    text = [line for _, line in got]
    assert 'GROUP BY "H_ID", "H_YEAR" HAVING COUNT(*) > 1' in text[0]
    assert "Huérfanos en DETAIL hacia HEAD (FK se elimina y recrea" in text[1] and 'WHERE p."H_ID" = c."D_H_ID"' in text[1]
    assert text[2:8] == [
        'ALTER TABLE "DETAIL" DROP CONSTRAINT "FK_HEAD_DETAIL";',
        '-- cubre una columna modificada o eliminada\nDROP INDEX "IX_YEAR";',
        'ALTER TABLE "HEAD" DROP CONSTRAINT "PK_HEAD";',
        'ALTER TABLE "HEAD" MODIFY ("H_YEAR" VARCHAR2(120));',
        'ALTER TABLE "HEAD" ADD CONSTRAINT "PK_HEAD" PRIMARY KEY ("H_ID", "H_YEAR");',
        'CREATE INDEX "IX_YEAR" ON "HEAD" ("H_YEAR");',
    ]
    assert 'ADD CONSTRAINT "FK_HEAD_DETAIL" FOREIGN KEY ("D_H_ID") REFERENCES "HEAD" ("H_ID");' in text[8]
    assert [r.step for r in lines.select("step").distinct().orderBy("step").collect()] == list(range(1, 9))
    assert migration.statement_counts(lines).first().statements == 7


def test_tables_columns_and_references_come_and_go(spark, sales):
    less = changed(
        sales,
        tables=sales.tables.filter("table_id = 'h'").withColumn("comment", F.lit("it's")),
        columns=sales.columns.filter("column_id IN ('h1', 'h2')").withColumn("name", F.when(F.col("column_id") == "h1", "H_KEY").otherwise(F.col("name"))),
        refs=sales.refs.limit(0), indexes=sales.indexes.filter("table_id = 'h'"),
    )
    there = script(migration.migration_statements(sales, less))
    assert (4, 'DROP TABLE "DETAIL";') in there and (1, 'ALTER TABLE "DETAIL" DROP CONSTRAINT "FK_HEAD_DETAIL";') in there
    assert [line for s, line in there if s == 5] == ['ALTER TABLE "HEAD" RENAME COLUMN "H_ID" TO "H_KEY";', 'ALTER TABLE "HEAD" DROP COLUMN "H_NOTE";']
    assert (9, "COMMENT ON TABLE \"HEAD\" IS 'it''s';") in there and not [x for x in there if x[0] == 8]
    back = script(migration.migration_statements(less, sales))
    assert [line.split("\n")[0] for s, line in back if s == 4] == ['CREATE TABLE "DETAIL" (']
    assert [line for s, line in back if s == 5][1] == 'ALTER TABLE "HEAD" ADD ("H_NOTE" VARCHAR2(50));'
    assert "FK nueva" in [line for s, line in back if s == 0][-1] and [s for s, _ in back].count(8) == 1 and (9, 'COMMENT ON TABLE "HEAD" IS NULL;') in back
