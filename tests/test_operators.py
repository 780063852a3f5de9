"""Operators against small hand-made catalogs, and registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.functions import text as T
from tessera.operators import graph, lint
from tessera.operators.duplicates import duplicate_tables
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


def catalog(spark, tables, columns, refs=(), indexes=()):
    """tables: id, code, pk; columns: table, id, code, type, length, mandatory, identity; refs: id, parent, child, pcol, ccol."""
    joins = "array<struct<parent_column:string,child_column:string>>"
    make = spark.createDataFrame
    return Catalog(
        make([(i, t, c, c, None, pk) for i, (t, c, pk) in enumerate(tables)], "table_ord long, table_id string, code string, name string, comment string, primary_key array<string>"),
        make([(t, i, c, code, code, kind, n, m, d) for i, (t, c, code, kind, n, m, d) in enumerate(columns)], "table_id string, col_ord long, column_id string, code string, name string, data_type string, length long, mandatory boolean, identity boolean"),
        make([(i, r, r, p, c, [(x, y)], "1:N", "No action") for i, (r, p, c, x, y) in enumerate(refs)], f"ref_ord long, ref_id string, name string, parent_table string, child_table string, joins {joins}, cardinality string, on_delete string"),
        make([(t, i, n, cols, False) for i, (t, n, cols) in enumerate(indexes)], "table_id string, index_ord long, name string, columns array<string>, is_unique boolean"),
        make([], "table_id string, key_ord long, name string, columns array<string>, is_primary boolean"),
    )


@pytest.fixture(scope="module")
def shop(spark):
    return catalog(
        spark,
        [("t1", "Customer", ["c1"]), ("t2", "Order", ["c2"])],
        [("t1", "c1", "CustomerID", "INTEGER", 10, True, True), ("t2", "c2", "OrderID", "INTEGER", 10, True, True), ("t2", "c3", "CustomerID", "INTEGER", 10, True, False)],
        [("r1", "t1", "t2", "c1", "c3")],
        [("t2", "IX", ["c3"])],
    )


def test_clean_catalog_has_one_info(spark, shop):
    assert [r.rule_id for r in lint.lint(shop).collect()] == ["delete-no-action"]
    assert lint.lint_score(shop).first().score == round(100 * (1 - 0.5 / 6))
    assert lint.lint(shop, {"delete-no-action": "off"}).count() == 0


def test_graph(spark, shop):
    assert {r.table_id: r.relations for r in graph.relation_counts(shop).collect()} == {"t1": 1, "t2": 1}
    assert [(r.table_id, r.hop) for r in graph.neighbours_within(shop, "t1", 2).collect()] == [("t2", 1)]
    assert not any(r.no_pk or r.orphan or r.god or r.fk_no_index for r in graph.semantic_flags(shop).collect())


def test_duplicates(spark):
    cols = [(t, f"{t}{k}", k, "INTEGER", 1, True, False) for t in ("a", "b") for k in ("id", "email", "phone")]
    c = catalog(spark, [("a", "Customers", None), ("b", "Customer", None), ("z", "Other", None)], cols)
    got = duplicate_tables(c).collect()
    assert [(r.table_a, r.table_b, r.verdict) for r in got] == [("a", "b", "high")]


@pytest.mark.parametrize("word,want", [("pedidos", "pedido"), ("almacenes", "almacen"), ("categories", "category"), ("status", "status"), ("address", "address")])
def test_singularize(spark, word, want):
    assert spark.range(1).select(T.singularize(F.lit(word))).first()[0] == want


@pytest.mark.parametrize("value,want", [("OrderLineID", ["Order", "Line", "ID"]), ("FK_Order_Customer", ["FK", "Order", "Customer"]), ("XMLParser", ["XML", "Parser"]), ("", [])])
def test_split_identifier(spark, value, want):
    assert spark.range(1).select(T.split_identifier(F.lit(value))).first()[0] == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "orders", "customer", "lineitem", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(registry.ORACLES[name])
    columns = sorted(rel.columns)
    want = sorted(str([dict(zip(rel.columns, r))[c] for c in columns]) for r in rel.fetchall())
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == want
