"""Edits, notes, layers, the demo catalog, impact and scripts on small catalogs."""

import json

from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.functions import text as T
from tessera.operators import annotations, duplicates, edits, export, graph, layers, lint, migration
from tessera.sources import xml_model
from tessera.sources.demo import demo_catalog
from test_metadata import MODEL

TEXT = """<?xml version="1.0"?>
<M><!-- <o:Table Id="t1"><a:Name>no</a:Name></o:Table> --><o:Table Id="t1">
<a:Name>Old &amp; é</a:Name>
<c:Columns><o:Column Id="c1">
<a:Name>x</a:Name>
<a:Length>8</a:Length>
</o:Column><o:Column Ref="c1"/><o:Column Id="c2"/></c:Columns></o:Table></M>"""


def edit(at, element, pd_id, child, value):
    return ("m", at, element, pd_id, child, value)


def test_patches_keep_all_other_bytes(spark):
    made = [
        edit(0, "o:Table", "t1", "a:Name", "A < B"), edit(1, "o:Table", "t1", "a:Comment", "first"), edit(2, "o:Column", "c1", "a:Length", None), edit(3, "o:Column", "c1", "a:Code", "X"),
        edit(4, "o:Column", "c2", "a:Name", "empty tag"), edit(5, "o:Table", "none", "a:Name", "unknown"), edit(6, "o:Table", "t1", "a:Comment", "second"), edit(7, "o:Column", "c1", "a:Comment", None),
    ]
    files = spark.createDataFrame([("m", TEXT), ("other", TEXT), ("none", None)], "model_id string, text string")
    rows = spark.createDataFrame(made, "model_id string, at int, element string, pd_id string, child string, value string")
    got = {r.model_id: r.text for r in edits.apply_edits(files, rows).collect()}
    want = TEXT.replace("Old &amp; é", "A &lt; B").replace("\n<a:Length>8</a:Length>", "").replace("<a:Name>x</a:Name>\n", "<a:Name>x</a:Name>\n<a:Code>X</a:Code>\n")
    want = want.replace("</c:Columns></o:Table>", "</c:Columns>\n<a:Comment>second</a:Comment>\n</o:Table>")
    assert got == {"m": want, "other": TEXT, "none": None}


def test_drafts_become_edits_and_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "lib.xml").write_text(MODEL)
    files = xml_model.read_files(spark, f"file://{folder}")
    ident = files.first().model_id
    c = xml_model.catalogs(files).one(ident)
    tables, columns = edits.table_drafts(c)
    assert edits.build_edits(c, tables, columns).count() == 0
    assert all(r.valid for r in edits.valid_drafts(tables, columns).collect())
    assert not any(r.valid for r in edits.valid_drafts(tables.withColumn("code", F.lit(" ")), columns).collect())
    assert not any(r.valid for r in edits.valid_drafts(tables, columns.withColumn("data_type", F.lit(""))).collect())
    tables = tables.withColumn("comment", F.lit(""))
    columns = columns.withColumns({"length": F.when(F.col("pd_id") == "k1", " 7.9 ").otherwise(F.col("length")), "mandatory": F.col("pd_id") == "k4"})
    made = edits.build_edits(c, tables, columns)
    assert sorted(((r.pd_id, r.child, r.value) for r in made.collect()), key=str) == [
        ("k1", "a:Column.Mandatory", None), ("k1", "a:Length", "7"), ("k3", "a:Column.Mandatory", None), ("k4", "a:Column.Mandatory", "1"), ("t1", "a:Comment", None),
    ]
    at = F.struct("part", "table_id", "draft_ord", "field")
    after = edits.apply_edits(files, made.select(F.lit(ident).alias("model_id"), at.alias("at"), "element", "pd_id", "child", "value"))
    export.write_file(after, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out", wholetext=True).first().value == after.first().text + "\n"
    again = xml_model.catalogs(after.withColumn("model_name", F.lit("lib"))).one(ident)
    assert {r.pd_id: (r.length, r.mandatory) for r in again.columns.collect()} == {"k1": (7, False), "k2": (80, False), "k3": (12, False), "k4": (9, True)}
    assert {r.comment for r in again.tables.collect()} == {None}


def test_annotations(spark, tmp_path):
    none = spark.createDataFrame([], "id string, table_id string, column_id string, text string, created_at long, updated_at long")
    new = spark.createDataFrame([("a", "t1", "", " hi "), ("b", "t1", "c1", "col"), ("c", "t2", None, "  ")], "id string, table_id string, column_id string, text string")
    notes = annotations.add(none, new, 5)
    assert sorted((r.id, r.text, r.column_id, r.created_at) for r in notes.collect()) == [("a", "hi", None, 5), ("b", "col", "c1", 5)]
    changed = annotations.update(notes, spark.createDataFrame([("a", " "), ("b", " new ")], "id string, text string"), 9)
    assert sorted((r.id, r.text, r.updated_at) for r in changed.collect()) == [("a", "", 5), ("b", "new", 9)]
    assert [r.id for r in annotations.for_table(changed, "t1").collect()] == ["a"] and [r.id for r in annotations.for_column(changed, "t1", "c1").collect()] == ["b"]
    assert [tuple(r) for r in annotations.counts(changed).collect()] == [("t1", 2)]
    assert annotations.remove(changed, new.filter("id = 'a'")).count() == 1
    annotations.save(changed, f"file://{tmp_path}/notes")
    assert sorted(map(tuple, annotations.load(spark, f"file://{tmp_path}/notes").collect()), key=str) == sorted(map(tuple, changed.collect()), key=str)
    (tmp_path / "raw.json").write_text(json.dumps([{"id": "x", "tableId": "t", "text": "ok"}, {"id": "y", "text": "no table"}, {"id": "z", "tableId": "t"}]))
    assert [r.id for r in annotations.load(spark, f"file://{tmp_path}/raw.json").collect()] == ["x"]


def test_rule_config(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"table-empty": "off", "pk-nullable": "loud", "unknown": "off"}))
    config = annotations.load_rule_config(spark, f"file://{tmp_path}/rules.json")
    assert config["table-empty"] == "off" and config["pk-nullable"] == "error" and len(config) == len(lint.RULES)
    assert annotations.toggled(config, "table-empty")["table-empty"] == "warning" and annotations.toggled(config, "pk-nullable")["pk-nullable"] == "off"
    annotations.save_rule_config(spark, config, f"file://{tmp_path}/saved")
    assert annotations.load_rule_config(spark, f"file://{tmp_path}/saved") == config


def test_demo_catalog_and_layers(spark):
    c = demo_catalog(spark)
    assert [r.rule_id for r in lint.lint(c).collect()] == ["delete-no-action"] and lint.lint_score(c).first().score == 97
    assert duplicates.duplicate_tables(c).count() == 0 and duplicates.compared_pairs(c).first().compared == 3
    assert {r.column_id: r.badge for r in layers.column_badges(c).collect()} == {f"column-{i}": "PK" if i in (1, 5, 9) else "FK" if i in (6, 10) else "C" for i in range(1, 13)}
    assert sorted(r.code for r in layers.visible_columns(c, hide_non_key=True).collect()) == ["CustomerID", "CustomerID", "OrderID", "OrderID", "OrderLineID"]
    extra = Catalog(c.tables, c.columns.withColumn("code", F.when(F.col("col_ord") == 2, "Created_At2").otherwise(F.col("code"))).withColumn("comment", F.when(F.col("col_ord") == 3, "x").otherwise("")).withColumn("data_type", F.when(F.col("col_ord") == 0, "Domain1").otherwise("")), c.refs, c.indexes, c.keys)
    assert [r.col_ord for r in layers.visible_columns(extra, "audit").collect()] == [2] and [r.col_ord for r in layers.visible_columns(extra, "comments").collect()] == [3]
    assert [r.table_id for r in layers.visible_tables(extra, "domains").collect()] == ["table-1"] and layers.visible_tables(c).count() == 3
    assert sorted(r.table_id for r in layers.focus_set(c, "table-1", 1).collect()) == ["table-1", "table-2"]
    got = layers.edges(c, "fk", layers.focus_set(c, "table-1", 1), None, c.tables.filter("table_ord > 0"))
    assert [(r.visible, r["class"]) for r in got.orderBy("ref_ord").collect()] == [(True, "emphasis"), (False, "cycle")]
    assert [r.ref_id for r in layers.references_of(c, "table-2", "incoming").collect()] == ["reference-1"]
    lines = layers.display_lines(spark.createDataFrame([("a  \n\n b\t",)], "sql string"), "sql").collect()
    assert [r.line for r in lines] == ["a", " b"]
    assert {r.table_id: r.neighbours for r in graph.adjacency(c).collect()} == {"table-1": ["table-2"], "table-2": ["table-1", "table-3"], "table-3": ["table-2"]}


def test_report_and_script(spark, tmp_path):
    c = demo_catalog(spark)
    now = T.iso_time(F.lit("2026-01-02 03:04:05").cast("timestamp"))
    lines = export.report_object(lint.lint(c), lint.lint_score(c), "Demo", now)
    order = ["part", *export.ORDER]
    report = json.loads("".join(r.line for r in lines.orderBy(*order).collect()))
    assert report["modelo"] == "Demo" and report["generado"] == "2026-01-02T03:04:05.000Z" and report["puntuacion"] == 97 and report["conteos"] == {"error": 0, "warning": 0, "info": 1}
    assert [(x["regla"], x["tabla"], x["tableId"]) for x in report["incidencias"]] == [("delete-no-action", "Order", "table-2")]
    export.write_lines(lines, order, f"file://{tmp_path}/report")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))) == report
    assert export.slug("--My Model!") == "-my-model".strip("-") and migration.script_name("A b", "", True) == "rollback-a-b-a-modelo.sql"
    same = [r.line for r in migration.script_file(c, c).orderBy("at").collect()]
    assert same[0] == same[-3] == migration.RULE and same[-1] == migration.NO_CHANGES


def test_impact(spark):
    base = demo_catalog(spark)
    keep = base.tables.filter("table_ord <> 2")
    columns = base.columns.filter("table_id <> 'table-3' AND column_id <> 'column-2'").withColumn("length", F.when(F.col("column_id") == "column-5", 12).otherwise(F.col("length")))
    target = Catalog(keep.withColumn("comment", F.when(F.col("table_ord") == 0, "Otros").otherwise(F.col("comment"))), columns, base.refs.filter("ref_ord = 0"), base.indexes.filter("table_id <> 'table-3'"), base.keys.filter("table_id <> 'table-3'"), name="Next")
    rows = {r.table_id: r for r in migration.impact(base, target).collect()}
    assert {k: r.kind for k, r in rows.items()} == {"table-1": "modified", "table-2": "modified", "table-3": "removed"}
    assert rows["table-1"].changes == ["Comentario de la tabla: Otros", "Columna eliminada: FirstName"]
    assert rows["table-2"].changes[0].startswith("Tipo de OrderID: ") and rows["table-2"].changes[1].startswith("Clave primaria se reconstruye")
    assert [(x.name, x.reference) for x in rows["table-2"].child_tables] == [("OrderLine", "FK_OrderLine_Order")] and rows["table-3"].outgoing_fks == ["FK_OrderLine_Order"]
    back = [r.line for r in migration.script_file(base, target, rollback=True).orderBy("at").collect()]
    assert back[1] == "-- Script de rollback Oracle · Next → DemoModel" and migration.LOSSY[0] in back and "-- 1. " + migration.SECTIONS[0] in back
    there = [r.line for r in migration.script_file(base, target).orderBy("at").collect()]
    assert migration.LOSSY[0] not in there and 'DROP TABLE "OrderLine";' in there


def test_term_sets(spark):
    got = spark.range(1).select(T.term_set(F.lit("Clients of OrderLine"), [["cliente", "clients"]]), T.percent(F.lit(0.125)), T.spanish_date(F.lit("2026-03-04").cast("date"))).first()
    assert list(got) == [["clients", "order", "line", "cliente"], "13%", "4/3/2026"]


def test_synonym_files(spark, tmp_path):
    (tmp_path / "groups.txt").write_text("Cliente, customer client\n\nalone\npedido order")
    assert T.read_synonyms(spark, f"file://{tmp_path}/groups.txt") == [["cliente", "customer", "client"], ["pedido", "order"]]
