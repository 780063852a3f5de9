"""XML model files, graph walks, search and version diff on small catalogs with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ddl, diff, export, graph, lint, search
from tessera.session import cut_lineage
from tessera.sources import xml_model


def element(tag, ident, *children, **text):
    inside = "".join(f"<a:{k.replace('_', '.')}>{v}</a:{k.replace('_', '.')}>" for k, v in text.items())
    return f'<o:{tag} Id="{ident}">{inside}{"".join(children)}</o:{tag}>'


def listed(name, *children):
    return f"<c:{name}>{''.join(children)}</c:{name}>"


def ref(tag, ident):
    return f'<o:{tag} Ref="{ident}"/>'


def column(ident, name, kind, **more):
    return element("Column", ident, Name=name, Code=name.upper(), DataType=kind, **more)


def symbol(ident, table, rect):
    return element("TableSymbol", ident, listed("Object", ref("Table", table)), Rect=rect)


READER = element(
    "Table", "t1",
    listed("Columns", column("k1", "Reader No", "NUMBER", Length=9, Column_Mandatory=1, Identity="true"), column("k2", "Full name", "VARCHAR2", Length=80, Comment="as &amp; printed")),
    listed("Keys", element("Key", "y1", listed("Key.Columns", ref("Column", "k1")), Name="ReaderKey"), element("Key", "y2", listed("Key.Columns", ref("Column", "k2")), Name="ByName")),
    listed("PrimaryKey", ref("Key", "y1")),
    listed("Indexes", element("Index", "x1", listed("IndexColumns", element("IndexColumn", "x2", IndexColumn_Expression="Full Name")), Name="IX_NAME", Unique=1)),
    Name="Reader", Code="READER", Comment="who borrows",
)
LOAN = element(
    "Table", "t2",
    listed("Columns", column("k3", "Loan No", "NUMBER", Length=12, Column_Mandatory=1), column("k4", "Borrower", "NUMBER", Length=9)),
    listed("Keys", element("Key", "y3", listed("Key.Columns", ref("Column", "k3")), Name="LoanKey")), listed("PrimaryKey", ref("Key", "y3")),
    Name="Loan", Code="LOAN",
)
BORROWS = element(
    "Reference", "f1", listed("ParentTable", ref("Table", "t1")), listed("ChildTable", ref("Table", "t2")),
    listed("Joins", element("ReferenceJoin", "f2", listed("Object1", ref("Column", "k1")), listed("Object2", ref("Column", "k4")))),
    Name="Borrows", Code="BORROWS", Cardinality="1..*", DeleteConstraint=2, UpdateConstraint=1,
)
SYMBOLS = listed("Symbols", symbol("s1", "t1", "((0,0), (4000,2000))"), symbol("s2", "t2", "((5000,0), (9000,3000))"))
MODEL = (
    '<?xml version="1.0"?><!-- <o:Table Id="t0"/> --><Model xmlns:a="a" xmlns:c="c" xmlns:o="o">'
    + element("RootObject", "r", listed("Children", element("Model", "m", listed("PhysicalDiagrams", element("PhysicalDiagram", "g", SYMBOLS)), listed("Tables", READER, LOAN), listed("References", BORROWS), Name="Library")))
    + "</Model>"
)
#: Values in child elements or attributes, prefixes that nothing declares, ends by code, keys by name.
LEGACY = """<o:Model><a:Name>Old</a:Name><c:Tables>
<o:Table Code="SHELF"><c:Columns><o:Column><a:Code>SHELF_ID</a:Code><a:Type>INTEGER</a:Type><a:NotNull>yes</a:NotNull></o:Column>
<o:Column><a:Code>ROOM</a:Code></o:Column></c:Columns><c:PrimaryKey><Column>SHELF_ID</Column></c:PrimaryKey></o:Table>
<o:Table Code="COPY"><c:Columns><o:Column><a:Code>COPY_ID</a:Code><a:Type>INTEGER</a:Type></o:Column><o:Column><a:Code>SHELF_ID</a:Code><a:Type>INTEGER</a:Type></o:Column></c:Columns></o:Table>
</c:Tables><c:References><o:Reference><a:Name>OnShelf</a:Name><a:ParentTable>shelf</a:ParentTable><a:ChildTable>COPY</a:ChildTable>
<c:Joins><o:Join><a:ParentColumn>shelf_id</a:ParentColumn><a:ChildColumn>SHELF_ID</a:ChildColumn></o:Join></c:Joins></o:Reference></c:References>
<c:TableSymbols><o:TableSymbol><a:Table>SHELF</a:Table><a:X>10</a:X><a:Y>20</a:Y><a:Width>200</a:Width><a:Height>90</a:Height></o:TableSymbol></c:TableSymbols></o:Model>"""


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    for name, text in {"shop.v1.xml": MODEL, "old.pdm": LEGACY, "empty.xml": "", "broken.xml": MODEL[: MODEL.index('<o:Table Id="t2"')]}.items():
        (folder / name).write_text(text)
    return xml_model.read_catalogs(spark, f"file://{folder}")


@pytest.fixture(scope="module")
def by_file(models):
    return {r["model_id"].rsplit("/", 1)[1]: models.one(r["model_id"], r["name"]) for r in models.models.collect()}


@pytest.fixture(scope="module")
def model(by_file):
    return by_file["shop.v1.xml"]


def chain(spark, edges, n):
    from test_operators import catalog

    tables = [(f"t{i}", f"T{i}", None) for i in range(n)]
    return catalog(spark, tables, [(t, f"{t}c", "id", "INTEGER", 1, True, False) for t, _, _ in tables], [(f"r{i}", a, b, f"{a}c", f"{b}c") for i, (a, b) in enumerate(edges)])


def test_xml_model(model):
    assert model.name == "shop.v1"  # the outer element of the format has no name
    t = {r.code: r for r in model.tables.collect()}
    assert {k: (r.name, r.comment) for k, r in t.items()} == {"READER": ("Reader", "who borrows"), "LOAN": ("Loan", None)}
    rows = {r.column_id: r for r in model.columns.collect()}
    key = {i: r.pd_id for i, r in rows.items()}
    assert sorted(key.values()) == ["k1", "k2", "k3", "k4"]
    by = {r.pd_id: r for r in rows.values()}
    assert (by["k1"].data_type, by["k1"].length, by["k1"].mandatory, by["k1"].identity) == ("NUMBER", 9, True, True)
    assert (by["k2"].code, by["k2"].comment, by["k2"].mandatory) == ("FULL NAME", "as & printed", False)
    assert [key[x] for x in t["READER"].primary_key] == ["k1"]
    assert {(r.name, r.is_primary, key[r.columns[0]]) for r in model.keys.collect()} == {("ReaderKey", True, "k1"), ("ByName", False, "k2"), ("LoanKey", True, "k3")}
    assert [(r.name, r.is_unique, [key[x] for x in r.columns]) for r in model.indexes.collect()] == [("IX_NAME", True, ["k2"])]
    r = model.refs.first()
    assert (r.name, r.parent_table, r.child_table, r.cardinality, r.on_delete, r.on_update) == ("Borrows", t["READER"].table_id, t["LOAN"].table_id, "1..*", "Cascade", "Restrict")
    assert [(key[j.parent_column], key[j.child_column]) for j in r.joins] == [("k1", "k4")]
    assert {k: tuple(x.position) for k, x in t.items()} == {"READER": (0, 0, 240, 120), "LOAN": (300, 0, 240, 180)}


def test_legacy_layout(by_file):
    c = by_file["old.pdm"]
    t, k = {r.code: r for r in c.tables.collect()}, {r.column_id: r for r in c.columns.collect()}
    assert sorted(t) == ["COPY", "SHELF"] and [k[x].code for x in t["SHELF"].primary_key] == ["SHELF_ID"]
    assert tuple(t["SHELF"].position) == (10, 20, 200, 90) and t["COPY"].position is None
    r = c.refs.first()
    assert (r.parent_table, r.child_table) == (t["SHELF"].table_id, t["COPY"].table_id)
    assert [(k[j.parent_column].code, k[j.child_column].code, k[j.child_column].table_id) for j in r.joins] == [("SHELF_ID", "SHELF_ID", t["COPY"].table_id)]
    assert {x.code: (x.data_type, x.mandatory) for x in k.values() if x.table_id == t["SHELF"].table_id} == {"SHELF_ID": ("INTEGER", True), "ROOM": ("unknown", False)}


def test_files_without_a_whole_model(by_file):
    assert "empty.xml" not in by_file
    assert [r.code for r in by_file["broken.xml"].tables.collect()] == ["READER"]


def test_xml_model_lint_and_ddl(spark, model):
    assert [x.rule_id for x in lint.lint(model).collect()] == ["fk-no-index"]
    text = [x.ddl for x in ddl.model_ddl(model).orderBy("part", "item").collect()]
    assert len(text) == 3 and 'CONSTRAINT "ReaderKey" PRIMARY KEY ("Reader No")' in text[0] and "FOREIGN KEY" in text[2]


def test_shortest_path(spark):
    c = chain(spark, [("t0", "t2"), ("t0", "t1"), ("t1", "t3"), ("t2", "t3"), ("t3", "t2")], 5)
    path = graph.shortest_path(c, "t0", "t3")
    assert [r.table_id for r in path.orderBy("step").collect()] == ["t0", "t2", "t3"]
    assert sorted(r.ref_id for r in graph.path_edges(c, path).collect()) == ["r0", "r3", "r4"]
    assert graph.shortest_path(c, "t0", "t4").count() == 0
    assert [r.table_id for r in graph.shortest_path(c, "t4", "t4").collect()] == ["t4"]


def walk(n, edges):
    """Cycles of a depth-first walk in one piece, by recursion."""
    near = {i: [b for a, b in edges if a == i and b != i] for i in range(n)}
    seen, found = set(), []

    def visit(at, trail):
        seen.add(at)
        for b in near[at]:
            if b in trail:
                found.append([f"t{x}" for x in trail[trail.index(b) :]])
            elif b not in seen:
                visit(b, [*trail, b])

    for i in range(n):
        if i not in seen:
            visit(i, [i])
    return found


def test_cycles(spark):
    c = chain(spark, [("t0", "t1"), ("t1", "t2"), ("t2", "t0"), ("t3", "t3"), ("t2", "t1")], 4)
    assert [r.tables for r in graph.fk_cycles(c.tables, c.refs).orderBy("cycle").collect()] == [["t0", "t1", "t2"], ["t1", "t2"]]
    assert sorted(r.table_id for r in graph.cycle_members(graph.fk_cycles(c.tables, c.refs)).collect()) == ["t0", "t1", "t2"]


def test_cycles_of_several_parts(spark):
    rng = random.Random(3)
    edges = [(3 * rng.randrange(4) + k, 3 * rng.randrange(4) + k) for k in range(3) for _ in range(8)] + [(11, 12), (12, 13)]
    rng.shuffle(edges)
    c = chain(spark, [(f"t{a}", f"t{b}") for a, b in edges], 14)
    assert [r.tables for r in graph.fk_cycles(c.tables, c.refs).orderBy("cycle").collect()] == walk(14, edges)


def test_relations_and_layout(spark):
    c = chain(spark, [("t0", "t1"), ("t1", "t1"), ("t0", "gone")], 2)
    assert sorted((r.table_id, r.ref_id, r.direction) for r in graph.relations_of(c).collect()) == [("t0", "r0", "child"), ("t1", "r0", "parent"), ("t1", "r1", "child")]
    assert [(r.x, r.y) for r in graph.grid_positions(chain(spark, [], 4)).orderBy("table_id").collect()] == [(0, 0), (340, 0), (680, 0), (0, 260)]


def test_lexical_and_hybrid_search(spark):
    docs = spark.createDataFrame([("a", 0, "customer clientes email", "Customer"), ("b", 1, "order pedidos fecha", "Order"), ("c", 2, "product precio", "Product")], "doc_id string, doc_ord long, text string, name string")
    assert search.lexical_search(docs, "clientes").first().doc_id == "a"
    assert search.lexical_search(docs, "orfer").first().doc_id == "b"
    assert search.lexical_search(docs, "zzz").count() == 0
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "doc_id string, embedding array<double>")
    got = search.hybrid_search(docs, vectors, "precio", [1.0, 0.0]).collect()
    assert got[0].doc_id == "b" and got[0].score == 1.0 and all(0 <= r.score <= 1 for r in got)


def test_filter_and_signature(spark):
    c = chain(spark, [("t0", "t1")], 3)
    assert [r.table_id for r in search.filter_tables(c, " T1 ").collect()] == ["t1"] and search.filter_tables(c, " ").count() == 3
    h = 5381
    for ch in "|".join([c.name, "t0:T0:1", "t1:T1:1", "t2:T2:1", "r0"]):
        h = (h * 33 + ord(ch) + 2**31) % 2**32 - 2**31
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[abs(h) % 36] + digits, abs(h) // 36
    assert search.model_signature(c).first().signature == digits


def test_stored_vectors_and_search(spark, tmp_path):
    c, path = chain(spark, [("t0", "t1")], 2), f"file://{tmp_path}"
    assert search.stored_vectors(c, path) is None
    vectors = spark.createDataFrame([("t0", [1.0, 0.0]), ("t1", [])], "doc_id string, embedding array<double>")
    search.write_vectors(vectors, c, path)
    assert search.stored_vectors(c, path) is None
    search.write_vectors(vectors.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0))), c, path)
    found = search.stored_vectors(c, path)
    assert found.count() == 2 and search.stored_vectors(chain(spark, [], 2), path) is None
    assert search.search_schema(c, " ").count() == 0
    hits = search.search_schema(c, "T1", vectors=found, query_vector=[0.0, 1.0])
    assert search.listed_tables(c, "T1", hits).first().table_id == "t1"
    assert [(r.table_id, r.score) for r in search.listed_tables(c, "t1").collect()] == [("t1", None)]


def test_grouped_hits(spark):
    c = chain(spark, [], 2)
    got = search.grouped_hits(search.global_search(c, "t")).collect()
    assert [r.kind for r in got] == sorted((r.kind for r in got), key=search.KINDS.index) and got[0]["rank"] == 1


def test_diff_models(spark):
    base, target = chain(spark, [("t0", "t1")], 3), chain(spark, [("t0", "t1")], 4)
    assert diff.diff_models(base, base).count() == 0
    wider = type(target)(target.tables, target.columns.withColumn("length", F.when(F.col("table_id") == "t0", 9).otherwise(F.col("length"))), target.refs, target.indexes, target.keys)
    got = cut_lineage(diff.diff_models(base, wider))
    assert sorted((r.object_type, r.kind, r.id, [tuple(x) for x in r.changes]) for r in got.collect()) == [("column", "modified", "t0c", [("Longitud", "1", "9")]), ("table", "added", "t3", [])]
    assert diff.diff_summary(got).first().asDict() == {"added": 1, "removed": 0, "modified": 1, "total": 2}
    lines = [r.line for r in diff.alter_statements(got, wider).orderBy("part").collect()]
    assert lines[0].startswith("-- Nueva tabla: T3\nCREATE TABLE T3 (") and lines[1] == "ALTER TABLE T0 MODIFY (id 9);"


def test_markdown(spark):
    from test_operators import catalog

    c = catalog(spark, [("t", "T", ["c"])], [("t", "c", "Code|ID", "INTEGER", 1, False, False)])
    lines = export.markdown_lines(lint.lint(c), lint.lint_score(c), "shop", "1/1/2026").orderBy("section", *export.ORDER).collect()
    assert lines[0].line.startswith("# Informe de calidad — shop\n\n- **Fecha:** 1/1/2026\n- **Puntuación:** ") and "- **Errores:** 1" in lines[0].line
    assert lines[1].line == "## Errores (1)\n\n" + export.TABLE_HEAD and lines[2].line.startswith("| `pk-nullable` | ") and "Code\\|ID" in lines[2].line
    none = export.markdown_lines(lint.lint(c, {"pk-nullable": "off", "fk-undeclared": "off"}), lint.lint_score(c, {"pk-nullable": "off", "fk-undeclared": "off"}), "x", "d").collect()
    assert [r.section for r in none] == [0] and none[0].line.endswith(export.NO_ISSUES)
    assert export.report_filename("My Shop!", "markdown") == "informe-my-shop-.md" and export.report_filename("", "csv") == "informe-modelo.csv"
