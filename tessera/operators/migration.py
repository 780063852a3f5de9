"""Migration between two versions of a catalog: the Oracle statements as rows in the order in which they have to run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..session import cut_lineage
from . import ddl
from .diff import pair_objects
from .export import slug

#: The sections of a script, in order.
SECTIONS = [
    "Prevalidación (descomenta y ejecuta antes de continuar)",
    "Eliminar las claves foráneas afectadas",
    "Eliminar los índices afectados",
    "Eliminar las claves modificadas (primarias y alternativas)",
    "Tablas: renombrar, crear y eliminar",
    "Columnas: renombrar, modificar, añadir y eliminar",
    "Crear las claves nuevas (primarias y alternativas)",
    "Crear los índices nuevos",
    "Recrear las claves foráneas",
    "Comentarios",
]
CHECKS, DROP_FKS, DROP_INDEXES, DROP_KEYS, TABLES, COLUMNS, ADD_KEYS, ADD_INDEXES, ADD_FKS, COMMENTS = range(10)
#: Why an index or an alternative key is dropped or made: changed, removed, new, over a renamed or changed column.
REASONS = {
    "index": ["índice modificado", "índice eliminado", "índice nuevo", "cubre una columna renombrada", "cubre una columna modificada o eliminada", "cubre una columna modificada"],
    "key": ["clave alternativa modificada", "clave alternativa eliminada", "clave alternativa nueva"] + ["cubre una columna modificada o eliminada"] * 3,
}
NONE = "cast(array() as array<string>)"


def _txt(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _q(c: str) -> Column:
    return ddl.quoted(F.col(c))


def _comment(c: Column) -> Column:
    return F.when(_txt(c) == "", "NULL").otherwise(_join("'", F.replace(c, F.lit("'"), F.lit("''")), "'"))


def _rows(frame: DataFrame, section: int, order: str, item: Column | str, line: Column, part: int = 0) -> DataFrame:
    return frame.select(F.lit(section).alias("section"), F.col(order).cast("long").alias("owner"), F.lit(part).alias("part"), F.col(item).cast("long").alias("item") if isinstance(item, str) else item.cast("long").alias("item"), line.alias("line"))


def primary_keys(c: Catalog) -> DataFrame:
    """(table_id, pk, pk_name, known): the codes of the primary key in its own order, from the table or else from its first primary
    key; the name of its constraint; known: the table's columns by id, code and name."""
    first = c.keys.filter("is_primary").groupBy("table_id").agg(F.min_by(F.struct("name", "columns"), "key_ord").alias("first"))
    t = c.tables.join(first, "table_id", "left").join(ddl.column_map(c), "table_id", "left")
    known = F.coalesce("known", F.expr("cast(map() as map<string,struct<code:string,name:string>>)"))
    name = F.coalesce(F.nullif("first.name", F.lit("")), _join("PK_", F.col("name")))
    return t.select("table_id", ddl.found(known, F.coalesce("primary_key", "first.columns"), "code").alias("pk"), name.alias("pk_name"), known.alias("known"))


def _column_changes(base: Catalog, target: Catalog, tables: DataFrame) -> DataFrame:
    """One row per column on either side of paired tables: bt, tt (the tables), b, t (the columns) and what changed."""
    pairs = pair_objects(base, target, "column", tables)
    both = tables.filter("base_id IS NOT NULL AND target_id IS NOT NULL").toDF("bt", "tt")
    b = base.columns.select(F.col("column_id").alias("base_id"), F.col("table_id").alias("b_table"), F.struct("*").alias("b"))
    t = target.columns.select(F.col("column_id").alias("target_id"), F.col("table_id").alias("t_table"), F.struct("*").alias("t"))
    rows = pairs.join(b, "base_id", "left").join(t, "target_id", "left")
    left, right = rows.filter("b_table IS NOT NULL"), rows.filter("b_table IS NULL")
    rows = left.join(both, F.col("b_table") == F.col("bt")).unionByName(right.join(both, F.col("t_table") == F.col("tt")))
    paired = F.col("b").isNotNull() & F.col("t").isNotNull()
    size = lambda f: F.coalesce(F.col(f"b.{f}"), F.lit(0)) != F.coalesce(F.col(f"t.{f}"), F.lit(0))
    flags = {
        "renamed": ~F.col("b.name").eqNullSafe(F.col("t.name")),
        "retyped": ~F.col("b.data_type").eqNullSafe(F.col("t.data_type")) | size("length") | size("precision"),
        "renulled": ~F.col("b.mandatory").eqNullSafe(F.col("t.mandatory")),
        "redefault": _txt(F.col("b.default_value")) != _txt(F.col("t.default_value")),
        "recomment": _txt(F.col("b.comment")) != _txt(F.col("t.comment")),
    }
    rows = rows.select("bt", "tt", "b", "t", *((paired & v).alias(k) for k, v in flags.items()))
    return rows.withColumn("changed", F.expr("renamed OR retyped OR renulled OR redefault"))


def _plans(base: Catalog, target: Catalog, pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per paired table: its names, keys, touched and renamed columns, and whether keys and references must be made anew."""
    touched = F.when(F.col("changed"), F.col("t.code")).when(F.col("t").isNull(), F.col("b.code"))
    seen = columns.groupBy("bt").agg(F.collect_set(touched).alias("touched"), F.collect_set(F.when(F.col("renamed"), F.col("t.code"))).alias("renamed"))
    p = pairs.filter("base_id IS NOT NULL AND target_id IS NOT NULL").toDF("bt", "tt").join(seen, "bt", "left")
    for side, c, own in (("b", base, "bt"), ("t", target, "tt")):
        t = c.tables.join(primary_keys(c), "table_id").select(
            F.col("table_id").alias(own), F.col("table_ord").alias(f"{side}_ord"), F.col("name").alias(f"{side}_name"), F.col("comment").alias(f"{side}_comment"),
            F.col("pk").alias(f"{side}_pk"), F.col("pk_name").alias(f"{side}_pk_name"), F.col("known").alias(f"{side}_known"),
        )
        p = p.join(t, own)
    p = p.withColumns({k: F.coalesce(k, F.expr(NONE)) for k in ("touched", "renamed")})
    p = p.withColumn("pk_changed", (F.col("b_pk") != F.col("t_pk")) | F.arrays_overlap("t_pk", "touched"))
    return p.withColumn("structural", F.col("pk_changed") | (F.size("touched") > 0))


def _rebuilt(base: Catalog, target: Catalog, pairs: DataFrame, plans: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """What is dropped (bt, name, item, rank, reason) and made (bt, id, name, item, rank, reason) of indexes or alternative keys:
    those that changed, and those over touched columns whose name isn't listed yet."""
    ident, order, frame, flag = {"index": ("index_id", "index_ord", "indexes", "is_unique"), "key": ("key_id", "key_ord", "keys", "is_primary")}[kind]
    found, reasons = pair_objects(base, target, kind, pairs), [F.lit(r) for r in REASONS[kind]]
    sides = {}
    for s, c, own in (("b", base, "bt"), ("t", target, "tt")):
        keep = plans.select(F.col(own).alias("table_id"), "bt", "touched", "renamed", F.col(f"{s}_known").alias("known"))
        f = getattr(c, frame).join(keep, "table_id")
        cover = ddl.found(F.col("known"), F.col("columns"), "code")
        sides[s] = f.select(F.struct(F.col(ident).alias("id"), F.col(order).alias("item"), "name", F.coalesce(flag, F.lit(False)).alias("flag"), F.coalesce("columns", F.expr(NONE)).alias("columns"), "bt", F.arrays_overlap(cover, "touched").alias("hit"), F.arrays_overlap(cover, "renamed").alias("renamed")).alias(s), F.col(ident).alias(f"{s}_id"))
    both = cut_lineage(found.join(sides["b"], F.col("base_id") == F.col("b_id"), "left").join(sides["t"], F.col("target_id") == F.col("t_id"), "left"))
    paired = F.col("b").isNotNull() & F.col("t").isNotNull()
    if kind == "key":
        both = both.filter("NOT coalesce(b.flag, false) OR NOT coalesce(t.flag, false)")
        paired = paired & ~F.col("b.flag") & ~F.col("t.flag")
    changed = paired & ((F.col("b.name") != F.col("t.name")) | (F.col("b.flag") != F.col("t.flag")) | (F.col("b.columns") != F.col("t.columns")))

    def listed(s: str, lone: Column, cover: Column) -> DataFrame:
        other = "t" if s == "b" else "b"
        mine = both.filter(F.col(s).isNotNull() & ~F.col(f"{s}.flag")) if kind == "key" else both.filter(F.col(s).isNotNull())
        rank = F.when(changed, 0).when(F.col(other).isNull(), 1).when(F.col(f"{s}.hit"), 2)
        reason = F.when(changed, reasons[0]).when(F.col(other).isNull(), lone).otherwise(cover)
        rows = mine.select(f"{s}.bt", f"{s}.id", f"{s}.name", f"{s}.item", f"{s}.columns", F.col(f"{other}.name").alias("other_name"), rank.alias("rank"), reason.alias("reason")).filter("rank IS NOT NULL")
        nth = F.row_number().over(Window.partitionBy("bt", "name").orderBy("rank", "item"))
        return rows.withColumn("nth", nth).filter("rank < 2 OR nth = 1").drop("nth")

    drop = listed("b", reasons[1], F.when(F.col("b.renamed"), reasons[3]).otherwise(reasons[4]))
    return drop, listed("t", reasons[2], reasons[5])


def _references(base: Catalog, target: Catalog, pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """References that are dropped or made: b and t, dropped, note. Both sides are compared by the codes of what they join."""
    sides = {}
    for s, c in (("b", base), ("t", target)):
        known = c.tables.select("table_id", "code", "name").join(ddl.column_map(c), "table_id", "left")
        r = c.refs.join(known.toDF("parent_table", "p_code", "p_name", "p_known"), "parent_table", "left").join(known.toDF("child_table", "c_code", "c_name", "c_known"), "child_table", "left")
        codes = [F.array_join(F.transform("joins", lambda j: F.coalesce(F.try_element_at(F.col(k), j[f])["code"], j[f])), ",") for k, f in (("p_known", "parent_column"), ("c_known", "child_column"))]
        said = F.concat_ws("|", "name", F.coalesce("p_code", "parent_table"), F.coalesce("c_code", "child_table"), *codes, _txt(F.col("cardinality")), _txt(F.col("on_delete")), _txt(F.col("on_update")))
        names = [F.transform("joins", lambda j: ddl.quoted(F.try_element_at(F.col(k), j[f])["name"])) for k, f in (("p_known", "parent_column"), ("c_known", "child_column"))]
        sides[s] = r.select(F.col("ref_id").alias(f"{s}_id"), F.struct("ref_ord", "ref_id", "name", "parent_table", "child_table", "p_name", "c_name", said.alias("said"), names[0].alias("parents"), names[1].alias("children")).alias(s))
    found = pair_objects(base, target, "reference").join(sides["b"], F.col("base_id") == F.col("b_id"), "left").join(sides["t"], F.col("target_id") == F.col("t_id"), "left")
    structural = plans.filter("structural").select(F.col("bt").alias("at"))
    gone = pairs.filter("target_id IS NULL").select(F.col("base_id").alias("at"))
    found = found.join(structural.union(gone).toDF("pt").withColumn("p_hit", F.lit(True)), F.col("b.parent_table") == F.col("pt"), "left")
    found = found.join(structural.toDF("ct").withColumn("c_hit", F.lit(True)), F.col("b.child_table") == F.col("ct"), "left")
    changed = F.col("t").isNotNull() & (F.col("b.said") != F.col("t.said"))
    note = F.when(F.col("b").isNull(), "FK nueva").when(F.col("t").isNull(), "FK eliminada").when(changed, "FK modificada").when(F.coalesce("p_hit", "c_hit"), "FK se elimina y recrea")
    order = F.coalesce("b.ref_ord", F.col("t.ref_ord") + 2**40)
    return found.select("b", "t", note.alias("note"), order.alias("at")).filter("note IS NOT NULL")


def _analysis(base: Catalog, target: Catalog) -> tuple[Catalog, Catalog, DataFrame, DataFrame, DataFrame]:
    base, target = base.complete(), target.complete()
    pairs = cut_lineage(pair_objects(base, target, "table"))
    columns = cut_lineage(_column_changes(base, target, pairs))
    return base, target, pairs, columns, cut_lineage(_plans(base, target, pairs, columns))


def migration_statements(base: Catalog, target: Catalog) -> DataFrame:
    """(section, owner, part, item, line): the script from base to target, empty if nothing changed. Lines of a section follow each
    other by owner, part and item; a line may hold a whole CREATE TABLE. A changed comment of a column always has its statement."""
    base, target, pairs, columns, plans = _analysis(base, target)
    named = plans.select("bt", "b_ord", "t_name", "b_name", "t_known")
    made = columns.join(named, "bt").select("*", ddl.quoted(F.col("t_name")).alias("on"))
    alter = _join("ALTER TABLE ", F.col("on"))
    type_of = lambda s: ddl.oracle_type(F.col(f"{s}.data_type"), F.col(f"{s}.length"), F.col(f"{s}.precision"))
    default = _join("DEFAULT ", ddl.default_value(F.col("t.default_value")))
    edits = F.array_compact(F.array(F.when(F.col("retyped"), type_of("t")), F.when(F.col("redefault"), default), F.when(F.col("renulled"), F.when(F.col("t.mandatory"), "NOT NULL").otherwise("NULL"))))
    added = F.concat_ws(" ", type_of("t"), default, F.when(F.col("t.mandatory"), "NOT NULL"))
    both = "b IS NOT NULL AND t IS NOT NULL"
    new = target.tables.join(pairs.filter("base_id IS NULL").select(F.col("target_id").alias("table_id")), "table_id", "left_semi").select("table_id")
    gone = base.tables.join(pairs.filter("target_id IS NULL").select(F.col("base_id").alias("table_id")), "table_id", "left_semi")

    t_cols = target.columns.join(plans.filter("pk_changed").select(F.col("tt").alias("table_id"), "t_pk"), "table_id").filter("array_contains(t_pk, code)")
    listed = t_cols.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "name"))), lambda x: ddl.quoted(x["name"])).alias("pk_names"))
    keyed = plans.join(listed.withColumnRenamed("table_id", "tt"), "tt")
    keys = F.array_join("pk_names", ", ")
    out = [
        _rows(keyed, CHECKS, "b_ord", F.lit(0), _join("-- Duplicados en la nueva PK de ", F.col("t_name"), " (debe devolver 0 filas):\n--   SELECT ", keys, ", COUNT(*)\n--     FROM ", _q("t_name"), "\n--    GROUP BY ", keys, " HAVING COUNT(*) > 1;\n")),
        _rows(plans.filter("pk_changed AND size(b_pk) > 0"), DROP_KEYS, "b_ord", F.lit(0), _join("ALTER TABLE ", _q("b_name"), " DROP CONSTRAINT ", _q("b_pk_name"), ";")),
        _rows(keyed, ADD_KEYS, "b_ord", F.lit(0), _join("ALTER TABLE ", _q("t_name"), " ADD CONSTRAINT ", _q("t_pk_name"), " PRIMARY KEY (", keys, ");")),
        _rows(plans.filter("b_name <> t_name"), TABLES, "b_ord", F.lit(0), _join("ALTER TABLE ", _q("b_name"), " RENAME TO ", _q("t_name"), ";")),
        _rows(gone, TABLES, "table_ord", F.lit(0), _join("DROP TABLE ", _q("name"), ";"), 1),
        _rows(ddl.table_ddl(target).join(new, "table_id", "left_semi"), TABLES, "table_ord", F.lit(0), F.col("ddl"), 2),
        _rows(made.filter("renamed"), COLUMNS, "b_ord", F.col("b.col_ord") * 2, _join(alter, " RENAME COLUMN ", _q("b.name"), " TO ", _q("t.name"), ";")),
        _rows(made.filter(F.size(edits) > 0), COLUMNS, "b_ord", F.col("b.col_ord") * 2 + 1, _join(alter, " MODIFY (", _q("t.name"), " ", F.array_join(edits, " "), ");")),
        _rows(made.filter("b IS NULL"), COLUMNS, "b_ord", F.col("t.col_ord"), _join(alter, " ADD (", _q("t.name"), " ", added, ");"), 1),
        _rows(made.filter("t IS NULL"), COLUMNS, "b_ord", F.col("b.col_ord"), _join(alter, " DROP COLUMN ", _q("b.name"), ";"), 2),
        _rows(made.filter(both).filter("recomment"), COMMENTS, "b_ord", F.col("b.col_ord"), _join("COMMENT ON COLUMN ", F.col("on"), ".", _q("t.name"), " IS ", _comment(F.col("t.comment")), ";")),
        _rows(plans.filter(_txt(F.col("b_comment")) != _txt(F.col("t_comment"))), COMMENTS, "b_ord", F.lit(0), _join("COMMENT ON TABLE ", _q("t_name"), " IS ", _comment(F.col("t_comment")), ";"), 1),
    ]

    drop, make = _rebuilt(base, target, pairs, plans, "index")
    # Statements of one table follow each other by rank, then by the order in the catalog.
    step = F.col("rank") * 2**40 + F.col("item")
    out.append(_rows(drop.join(named, "bt"), DROP_INDEXES, "b_ord", step, _join("-- ", F.col("reason"), "\nDROP INDEX ", _q("name"), ";")))
    whole = ddl.index_ddl(target).withColumnRenamed("index_ord", "item").join(plans.select(F.col("tt").alias("table_id"), "bt", "b_ord"), "table_id")
    out.append(_rows(whole.join(make.select("bt", "item").distinct(), ["bt", "item"], "left_semi"), ADD_INDEXES, "b_ord", "item", F.col("ddl")))
    drop, make = _rebuilt(base, target, pairs, plans, "key")
    out.append(_rows(drop.join(named, "bt"), DROP_KEYS, "b_ord", step, _join("-- ", F.col("reason"), "\nALTER TABLE ", _q("b_name"), " DROP CONSTRAINT ", _q("name"), ";"), 1))
    make = make.join(named, "bt").withColumn("names", ddl.picked(F.col("t_known"), F.col("columns"))).filter("size(names) > 0 AND size(names) = size(columns)")
    out.append(_rows(make, ADD_KEYS, "b_ord", step, _join("-- ", F.col("reason"), "\nALTER TABLE ", _q("t_name"), " ADD CONSTRAINT ", _q("name"), " UNIQUE (", F.array_join("names", ", "), ");"), 1))

    refs = cut_lineage(_references(base, target, pairs, plans))
    out.append(_rows(refs.filter("b.c_name IS NOT NULL"), DROP_FKS, "at", F.lit(0), _join("ALTER TABLE ", _q("b.c_name"), " DROP CONSTRAINT ", _q("b.name"), ";")))
    again = refs.filter("t IS NOT NULL")
    match = F.array_compact(F.zip_with("t.parents", "t.children", lambda p, c: _join("p.", p, " = c.", c)))
    filled = F.transform(F.array_compact(F.col("t.children")), lambda c: _join("c.", c, " IS NOT NULL"))
    check = _join(
        "-- Huérfanos en ", F.col("t.c_name"), " hacia ", F.col("t.p_name"), " (", F.col("note"), ": debe devolver 0):\n--   SELECT COUNT(*) FROM ", _q("t.c_name"), " c\n--    WHERE ",
        F.array_join(filled, " AND "), "\n--      AND NOT EXISTS (SELECT 1 FROM ", _q("t.p_name"), " p WHERE ", F.array_join(match, " AND "), ");\n",
    )
    out.append(_rows(again.filter(F.size(match) > 0).filter("t.c_name IS NOT NULL AND t.p_name IS NOT NULL"), CHECKS, "at", F.lit(0), check, 1))
    fks = ddl.reference_ddl(target).join(again.select("t.ref_id", "at"), "ref_id")
    out.append(_rows(fks, ADD_FKS, "at", F.lit(0), F.col("ddl")))
    return reduce(DataFrame.unionByName, out)


def script_lines(base: Catalog, target: Catalog) -> DataFrame:
    """The statements with `step` and `title`: sections with statements are numbered from 1."""
    lines = cut_lineage(migration_statements(base, target))
    used = lines.select("section").distinct()
    steps = used.select("section", F.row_number().over(Window.orderBy("section")).alias("step"), F.element_at(F.array(*(F.lit(s) for s in SECTIONS)), F.col("section") + 1).alias("title"))
    return lines.join(F.broadcast(steps), "section")


def statement_counts(lines: DataFrame) -> DataFrame:
    """One row: the lines that are neither blank nor a comment."""
    rows = lines.select(F.explode(F.split("line", "\n")).alias("l")).select(F.trim("l").alias("l"))
    return rows.agg(F.count(F.when((F.col("l") != "") & ~F.startswith("l", F.lit("--")), 1)).alias("statements"))


#: The head of a script; the warning of a rollback whose script forwards drops columns or tables; the text without changes.
RULE = "-- =========================================================================="
HEAD = [
    "-- Orden fijo: FKs → índices → PKs → tablas → columnas → PKs → índices → FKs.",
    "-- Los nombres de constraints salen del modelo: contrasta con la base de datos antes de ejecutar.",
]
LOSSY = [
    "-- AVISO: el script directo eliminaba columnas o tablas. El rollback recrea la",
    "-- estructura vacía, pero los datos que se perdieron NO se recuperan.",
]
NO_CHANGES = "-- No hay cambios que aplicar entre los dos modelos."


def is_lossy(statements: DataFrame) -> bool:
    """Whether migration statements drop a table or a column."""
    return not statements.filter((F.col("section") == TABLES) & (F.col("part") == 1) | (F.col("section") == COLUMNS) & (F.col("part") == 2)).isEmpty()


def loses_data(base: Catalog, target: Catalog) -> bool:
    """`is_lossy` of the statements from base to target, which aren't made for it: a table without a partner, or a column of paired tables without one."""
    base, target = base.complete(), target.complete()
    pairs = cut_lineage(pair_objects(base, target, "table"))
    gone = pairs.filter("target_id IS NULL").select(F.col("base_id").alias("table_id"))
    if not base.tables.join(gone, "table_id", "left_semi").isEmpty():
        return True
    return not _column_changes(base, target, pairs).filter("t IS NULL").isEmpty()


def script_file(base: Catalog, target: Catalog, rollback: bool = False) -> DataFrame:
    """(at, line): a whole script in order, a line of it a row: the head, then every section with statements, numbered. A rollback is
    the way from target to base, with a warning where the way forward loses data."""
    a, b = (target, base) if rollback else (base, target)
    lines = script_lines(a, b)
    head = [RULE, f"-- Script de {'rollback' if rollback else 'migración'} Oracle · {a.name} → {b.name}", *HEAD]
    if rollback and loses_data(base, target):
        head += LOSSY
    head.append(RULE)
    if lines.isEmpty():
        head += ["", NO_CHANGES]
    order = ["step", "title_first", "owner", "part", "item", "sub"]
    zero = F.lit(0).cast("long")
    titles = lines.select("step", "title").distinct().select(
        "step", F.lit(0).alias("title_first"), zero.alias("owner"), F.lit(0).alias("part"), zero.alias("item"),
        F.posexplode(F.array(F.lit(""), F.concat(F.lit("-- "), F.col("step").cast("string"), F.lit(". "), "title"))).alias("sub", "line"),
    )
    said = lines.select("step", F.lit(1).alias("title_first"), "owner", "part", "item", F.posexplode(F.split(F.regexp_replace("line", r"\s+$", ""), "\n")).alias("sub", "line"))
    first = lines.sparkSession.createDataFrame([(0, 0, 0, 0, 0, i, x) for i, x in enumerate(head)], "step int, title_first int, owner long, part int, item long, sub int, line string")
    return first.unionByName(titles).unionByName(said).select(F.struct(*order).alias("at"), "line")


def script_name(base: str, target: str, rollback: bool = False) -> str:
    return f"{'rollback' if rollback else 'migracion'}-{slug(base)}-a-{slug(target)}.sql"


def impact(base: Catalog, target: Catalog) -> DataFrame:
    """One row per table that a migration touches: side (0 paired, 1 removed, 2 added), table_ord, table_id, table_name, kind (added, removed,
    modified, affected), changes, child_tables (whose references are dropped), outgoing_fks and indexes (that are dropped)."""
    base, target, pairs, columns, plans = _analysis(base, target)
    none, text = F.lit(None).cast("string"), lambda side: ddl.oracle_type(F.col(f"{side}.data_type"), F.col(f"{side}.length"), F.col(f"{side}.precision"))
    yes_no = lambda c: F.when(c, "sí").otherwise("no")

    def rows(frame: DataFrame, group: int, item: Column, said: list[Column]) -> DataFrame:
        found = F.posexplode(F.array(*said)).alias("sub", "text")
        return frame.select("bt", F.lit(group).alias("g"), item.cast("long").alias("item"), found).filter("text IS NOT NULL")

    both = columns.filter("b IS NOT NULL AND t IS NOT NULL")
    after, had = F.col("t.name"), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    of_column = [
        F.when(F.col("renamed"), _join("Columna renombrada: ", F.col("b.name"), " → ", after)),
        F.when(F.col("retyped"), _join("Tipo de ", after, ": ", text("b"), " → ", text("t"))),
        F.when(F.col("renulled"), F.when(F.col("t.mandatory"), _join(after, " pasa a NOT NULL")).otherwise(_join(after, " admite NULL"))),
        F.when(F.col("redefault"), F.when(had("t.default_value"), _join("Default de ", after, ": ", F.col("t.default_value"))).otherwise(_join("Default de ", after, " eliminado"))),
        F.when(~F.col("b.identity").eqNullSafe(F.col("t.identity")), _join("IDENTITY de ", after, ": ", yes_no(F.col("b.identity")), " → ", yes_no(F.col("t.identity")), " (puede exigir recrear la tabla)")),
        F.when(F.col("recomment"), _join("Comentario de ", after, F.when(had("t.comment"), " actualizado").otherwise(" eliminado"))),
    ]
    pk = [F.array_join(k, ", ") for k in ("b_pk", "t_pk")]
    of_key = (
        F.when(F.size("b_pk") == 0, _join("Clave primaria añadida: (", pk[1], ")")).when(F.size("t_pk") == 0, "Clave primaria eliminada")
        .when(F.col("b_pk") == F.col("t_pk"), "Clave primaria se reconstruye (cambia la definición de alguna de sus columnas)")
        .otherwise(_join("Clave primaria: (", pk[0], ") → (", pk[1], ")"))
    )
    comment = F.when(_txt(F.col("b_comment")) != _txt(F.col("t_comment")), F.when(had("t_comment"), _join("Comentario de la tabla: ", F.col("t_comment"))).otherwise("Comentario de la tabla eliminado"))
    zero = F.lit(0)
    said = [
        rows(plans, 0, zero, [F.when(F.col("b_name") != F.col("t_name"), _join("Tabla renombrada: ", F.col("b_name"), " → ", F.col("t_name"))), comment]),
        rows(both, 1, F.col("b.col_ord"), of_column),
        rows(columns.filter("b IS NULL"), 2, F.col("t.col_ord"), [_join("Columna añadida: ", after, " ", text("t"))]),
        rows(columns.filter("t IS NULL"), 3, F.col("b.col_ord"), [_join("Columna eliminada: ", F.col("b.name"))]),
        rows(plans.filter("pk_changed"), 4, zero, [of_key]),
    ]
    dropped = []
    for k, (kind, word) in enumerate((("index", "Índice"), ("key", "Clave alternativa"))):
        drop, make = _rebuilt(base, target, pairs, plans, kind)
        drop, gender = cut_lineage(drop), "eliminado" if k == 0 else "eliminada"
        own = F.when(F.col("rank") == 0, _join(f"{word} ", F.col("name"), " → ", F.col("other_name"))).when(F.col("rank") == 1, _join(f"{word} {gender}: ", F.col("name")))
        said.append(rows(drop, 5 + 2 * k, F.col("rank") * 2**40 + F.col("item"), [own]))
        said.append(rows(make.filter("rank = 1"), 6 + 2 * k, F.col("item"), [_join(f"{word} {'nuevo' if k == 0 else 'nueva'}: ", F.col("name"))]))
        dropped.append(drop.select("bt", F.struct(F.lit(k).alias("k"), "rank", "item", "name").alias("x")))
    changes = reduce(DataFrame.unionByName, said).groupBy("bt").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "item", "sub", "text"))), lambda x: x["text"]).alias("changes"))
    indexes = dropped[0].union(dropped[1]).groupBy("bt").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("indexes"))

    refs = cut_lineage(_references(base, target, pairs, plans).filter("b IS NOT NULL"))
    entry = F.struct("at", F.col("b.child_table").alias("table_id"), F.coalesce("b.c_name", "b.child_table").alias("name"), F.col("b.name").alias("reference"))
    children = refs.groupBy(F.col("b.parent_table").alias("bt")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("at")).alias("child_tables"))
    toward = _join(F.col("note"), ": ", F.col("b.name"), " hacia ", F.coalesce("b.p_name", "b.parent_table"))
    outgoing = refs.groupBy(F.col("b.child_table").alias("bt")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("b.name").alias("name"), toward.alias("toward")))).alias("out"))

    n = target.columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    new = target.tables.join(pairs.filter("base_id IS NULL").select(F.col("target_id").alias("table_id")), "table_id", "left_semi").join(n, "table_id", "left")
    gone = base.tables.join(pairs.filter("target_id IS NULL").select(F.col("base_id").alias("table_id")), "table_id", "left_semi")
    empty = F.expr(NONE)
    old = plans.select(F.lit(0).alias("side"), F.col("b_ord").alias("table_ord"), F.col("bt"), F.col("t_name").alias("table_name")).join(changes, "bt", "left")
    old = old.unionByName(gone.select(F.lit(1).alias("side"), "table_ord", F.col("table_id").alias("bt"), F.col("name").alias("table_name"), F.array(F.lit("Tabla eliminada")).alias("changes")))
    old = old.join(indexes, "bt", "left").join(children, "bt", "left").join(outgoing, "bt", "left")
    made = F.array(_join("Tabla añadida con ", F.coalesce("n", F.lit(0)).cast("string"), " columna(s)"))
    old = old.unionByName(new.select(F.lit(2).alias("side"), "table_ord", F.col("table_id").alias("bt"), F.col("name").alias("table_name"), made.alias("changes")), allowMissingColumns=True)
    old = old.withColumns({"changes": F.coalesce("changes", empty), "indexes": F.coalesce("indexes", empty)})
    kind = F.when(F.col("side") == 2, "added").when(F.col("side") == 1, "removed").when((F.size("changes") > 0) | (F.size("indexes") > 0), "modified").otherwise("affected")
    names, why = (F.coalesce(F.transform("out", lambda x: x[f]), empty) for f in ("name", "toward"))
    out = old.select(
        "side", "table_ord", F.col("bt").alias("table_id"), "table_name", kind.alias("kind"), F.when(F.size("changes") == 0, why).otherwise(F.col("changes")).alias("changes"),
        F.coalesce("child_tables", F.expr("cast(array() as array<struct<table_id:string,name:string,reference:string>>)")).alias("child_tables"), names.alias("outgoing_fks"), "indexes",
    )
    return out.filter((F.col("kind") != "affected") | (F.size("child_tables") > 0) | (F.size("outgoing_fks") > 0))
