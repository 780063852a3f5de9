"""Substring index and global search of many queries against brute-force versions."""

import random
import re

from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators import ddl, search, substring


def test_every_holding_text_is_found(spark, monkeypatch):
    monkeypatch.setattr(substring, "PART", 5)  # most lists are dealt out
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab_ cX") for _ in range(rng.randrange(0, 14))) for _ in range(150)] + ["", " ", "_", "É_é", "a" * 5000, None, "ab"]
    patterns = ["".join(rng.choice("ab_ cx") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["", "a" * 400, "zzz", "é", "abz", None]
    index = substring.build_text_index(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = spark.createDataFrame([(p, f) for p in patterns for f in "lz"] * 2, "pattern string, form string")
    ids = {r.i: r.text for r in spark.createDataFrame([(t,) for t in set(texts) - {None}], "text string").withColumn("i", substring.text_id(F.col("text"))).collect()}
    got = {(r.pattern, r.form, ids[r.text_id]) for r in substring.holding(index, asked).collect()}
    shape = {"l": lambda t: t.lower(), "z": lambda t: re.sub(r"[_\s]", "", t.lower())}
    want = {(p, f, t) for p in set(patterns) - {None, ""} for f in "lz" for t in set(texts) - {None} if p in shape[f](t)}
    assert got == want
    assert substring.holding(index, asked.limit(0)).count() == 0
    none = substring.build_text_index(spark.createDataFrame([], "text string"))
    assert substring.holding(none, asked).count() == 0


def catalog(spark):
    tables = spark.createDataFrame([(1, "t1", "CRM_CUST", "Customer", "People who buy", ["c1"]), (2, "t2", "ORD", "ord", None, None)], "table_ord long, table_id string, code string, name string, comment string, primary_key array<string>")
    columns = spark.createDataFrame(
        [("t1", 1, "c1", "cust_id", "Identifier", "NUMBER", "zebra note"), ("t1", 2, "c2", "Zebra", "zebra", "DATE", None), ("t2", 1, "c3", "fullName", "Full name", None, "zebra note")],
        "table_id string, col_ord long, column_id string, code string, name string, data_type string, comment string",
    )
    refs = spark.createDataFrame([], "ref_ord long, ref_id string, name string, parent_table string, child_table string, joins array<struct<parent_column:string,child_column:string>>, cardinality string, on_delete string")
    indexes = spark.createDataFrame([("t1", 1, "ix7", "IX_ZEBRA", ["c2"], True)], "table_id string, index_ord long, index_id string, name string, columns array<string>, is_unique boolean")
    keys = spark.createDataFrame([("t1", 1, "key3", "PK_CUST", ["c1"], True)], "table_id string, key_ord long, key_id string, name string, columns array<string>, is_primary boolean")
    return Catalog(tables, columns, refs, indexes, keys, spark.createDataFrame([(1, "d1", "ZebraDomain", "NUMBER")], "domain_ord long, domain_id string, name string, data_type string"))


def shown(hits):
    return [(r.kind, r.id, r.table_id, r.title, r.subtitle, r.matched_in, round(r.score, 4)) for r in hits.collect()]


def test_comments_of_columns_are_found_in_order(spark):
    c = catalog(spark)
    assert shown(search.global_search(c, " ZEBRA ")) == [
        ("column", "c2", "t1", "zebra", "Customer · DATE", "zebra", 0.85),
        ("comment", "c1", "t1", "Customer.Identifier", "Comentario de columna", "zebra note", 0.57),
        ("comment", "c3", "t2", "ord.Full name", "Comentario de columna", "zebra note", 0.57),
        ("index", "ix7", "t1", "IX_ZEBRA", "Customer · UNIQUE", "IX_ZEBRA", 0.4),
        ("domain", "d1", None, "ZebraDomain", "Dominio · NUMBER", "ZebraDomain", 0.38),
    ]
    assert shown(search.global_search(c, "cust")) == [
        ("table", "t1", None, "Customer", "CRM_CUST · 2 columnas", "Customer", 0.95),
        ("column", "c1", "t1", "Identifier", "Customer · PK", "cust_id", round(0.85 * 0.95 * 0.95, 4)),
        ("table", "t1", None, "Customer", "CRM_CUST · 2 columnas", "CRM_CUST", 0.76),
        ("comment", "t1", None, "Customer", "Comentario de tabla", "People who buy", 0.57),
        ("comment", "c1", "t1", "Customer.Identifier", "Comentario de columna", "zebra note", 0.57),
        ("key", "key3", "t1", "PK_CUST", "Customer · PK", "PK_CUST", 0.4),
    ]


def test_many_queries_hit_what_each_hits(spark):
    c = catalog(spark)
    asked = ["zebra", " Cust ", "zebra note", "full na", "fullname", "no such thing", "e", "", "  ", "people zebra", "id", "crm_cust", None, "crm cust", "z a"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q_id long, query string")
    for kinds, prefix in ((None, None), (["column", "comment"], None), (None, "CRM")):
        found = search.global_search_many(c, queries, kinds, prefix)
        got = {}
        for r in found.collect():
            got.setdefault(r.q_id, []).append((r.kind, r.id, r.table_id, r.title, r.subtitle, r.matched_in, round(r.score, 4)))
        for q, text in enumerate(asked):
            assert got.get(q, []) == (shown(search.global_search(c, text, kinds, prefix)) if text else []), text


def test_types_that_are_not_listed(spark):
    rows = [("nvarchar2", 50, None), (None, 30, None), (" Decimal ", 9, 2), ("decimal", 9, None), ("double precision", 5, 5), ("xml\n", None, None), ("Raw", 4, 1), ("", 7, None), ("char", None, None), ("number", None, 3)]
    d = spark.createDataFrame(rows, "t string, n long, p long")
    got = [r.x for r in d.select(ddl.oracle_type(F.col("t"), F.col("n"), F.col("p")).alias("x")).collect()]
    assert got == ["NVARCHAR2(50)", "VARCHAR2(30)", "NUMBER(9, 2)", "NUMBER(9)", "NUMBER", "XML", "RAW(4, 1)", "VARCHAR2(255)", "CHAR(1)", "NUMBER"]
