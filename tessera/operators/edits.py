"""Edits of tables and columns: drafts, what a draft changes, and the change put into the model files.

An edit names an element by tag and file id, one of its children, and the child's new text; without a text the child goes.
"""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import Catalog
from ..functions.text import escape_xml

#: The fields of a table and of a column, in order, and their children in a file.
TABLE_FIELDS = [("name", "a:Name"), ("code", "a:Code"), ("comment", "a:Comment")]
COLUMN_FIELDS = [("name", "a:Name"), ("code", "a:Code"), ("data_type", "a:DataType"), ("length", "a:Length"), ("mandatory", "a:Column.Mandatory"), ("comment", "a:Comment")]
TABLE_TAG, COLUMN_TAG = "o:Table", "o:Column"


def table_drafts(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Drafts of all tables (table_id, pd_id, name, code, comment) and of their columns (with draft_ord, data_type, length as a text,
    mandatory); what is missing is an empty text."""
    c = c.complete()
    none = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    tables = c.tables.select("table_id", "pd_id", "name", "code", none("comment"))
    return tables, c.columns.select("table_id", F.col("col_ord").alias("draft_ord"), "pd_id", "name", "code", "data_type", none("length"), "mandatory", none("comment"))


def valid_drafts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, valid): names, codes and types aren't blank."""
    blank = lambda *names: ~F.greatest(*(F.coalesce(F.trim(n), F.lit("")) == "" for n in names))
    fine = columns.groupBy("table_id").agg(F.bool_and(blank("name", "code", "data_type")).alias("fine"))
    return tables.join(fine, "table_id", "left").select("table_id", (blank("name", "code") & F.coalesce("fine", F.lit(True))).alias("valid"))


def draft_length(text: Column) -> Column:
    """The whole part of a length typed in, null where it is no number."""
    return F.trim(text).try_cast("double").cast("long")


def build_edits(c: Catalog, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, part, draft_ord, field, element, pd_id, child, value): what the drafts change, in this order. Tables and columns without a
    file id have no edits; value is the new text, null to remove the child."""
    c = c.complete()

    def listed(both: DataFrame, part: int, element: str, fields: list) -> DataFrame:
        found = []
        for i, (name, child) in enumerate(fields):
            new, old = F.col(f"d.{name}"), F.col(f"s.{name}")
            if name == "length":
                new = draft_length(new)
            elif name == "comment":
                old = F.coalesce(old, F.lit(""))
            value = {"mandatory": F.when(new, "1"), "comment": F.nullif(new, F.lit(""))}.get(name, new.cast("string"))
            found.append(F.when(~new.eqNullSafe(old), F.struct(F.lit(i).alias("field"), F.lit(child).alias("child"), value.alias("value"))))
        edit = F.explode(F.array_compact(F.array(*found)))
        rows = both.select("d.table_id", F.lit(part).alias("part"), "draft_ord", F.lit(element).alias("element"), "s.pd_id", edit.alias("e"))
        return rows.select("table_id", "part", "draft_ord", "e.field", "element", "pd_id", "e.child", "e.value")

    with_file = c.tables.filter("pd_id <> ''")
    t = tables.select("table_id", F.struct("*").alias("d")).join(with_file.select("table_id", F.struct("*").alias("s")), "table_id")
    own = c.columns.filter("pd_id <> ''").join(with_file.select("table_id"), "table_id", "left_semi")
    k = columns.select("table_id", "pd_id", "draft_ord", F.struct("*").alias("d")).join(own.select("table_id", "pd_id", F.struct("*").alias("s")), ["table_id", "pd_id"])
    at = F.lit(0).cast("long").alias("draft_ord")
    return listed(t.select("d", "s", at), 0, TABLE_TAG, TABLE_FIELDS).unionByName(listed(k.select("d", "s", "draft_ord"), 1, COLUMN_TAG, COLUMN_FIELDS))


def element_spans(data: bytes, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, int, dict[str, tuple[int, int]]]]:
    """By tag and file id of the wanted elements that have contents: where these begin and end, and the same of each direct child
    from its first byte to its last, by tag (the first counts). What follows an error in the file isn't found."""
    parser = expat.ParserCreate(encoding="UTF-8")
    out: dict = {}
    open_: list[list] = []  # tag, key, first byte, where the contents begin, children

    def reached() -> None:
        if open_ and open_[-1][3] is None:
            open_[-1][3] = parser.CurrentByteIndex

    def start(tag: str, attrs: dict) -> None:
        reached()
        open_.append([tag, (tag, attrs.get("Id")), parser.CurrentByteIndex, None, {}])

    def end(tag: str) -> None:
        at = parser.CurrentByteIndex
        closed = open_[-1][3] is not None or data[at - 2 : at] != b"/>"  # else an empty tag, after which the parser stands
        reached()
        _, key, first, inside, children = open_.pop()
        if key in wanted and key not in out:
            out[key] = (inside, at, children) if closed else None
        if open_:
            open_[-1][4].setdefault(tag, (first, data.index(b">", at) + 1 if closed else at))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = parser.DefaultHandler = lambda text: reached()
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass
    return {k: v for k, v in out.items() if v}


def patched(text: str, edits: list) -> str:
    """The text with the edits (element, pd_id, child, value) made; all other bytes stay. Of several edits of one child the last counts."""
    last = {((e["element"], e["pd_id"]), e["child"]): e["value"] for e in edits}
    data = (text or "").encode()
    spans = element_spans(data, {k for k, _ in last})
    cuts, added = [], {}
    for (key, child), value in last.items():
        if key not in spans:
            continue
        inside, end, children = spans[key]
        new = b"" if value is None else f"<{child}>{value}</{child}>".encode()
        if child in children:
            a, b = children[child]
            cuts.append((a - (value is None and data[a - 1 : a] == b"\n"), b, new))
        elif value is not None:
            empty, broken = inside == end, data[end - 1 : end] == b"\n"
            before = b"" if key in added or empty or broken else b"\n"
            added.setdefault(key, [end, b""])[1] += before + new + b"\n"
    for a, b, new in sorted([*cuts, *((end, end, new) for end, new in added.values())], reverse=True):
        data = data[:a] + new + data[b:]
    return data.decode()


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(model_id, text) with the edits (model_id, at, element, pd_id, child, value) made in the order of `at`; a file is patched in the task
    that has it. Elements that a file doesn't hold, or that are empty tags, are skipped."""
    value = escape_xml(F.col("value"))
    listed = edits.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("at", "element", "pd_id", "child", value.alias("value")))).alias("edits"))

    def run(batches):
        for batch in batches:
            texts = [t if e is None else patched(t, e) for t, e in zip(batch["text"], batch["edits"])]
            yield pd.DataFrame({"model_id": batch["model_id"], "text": texts})

    return files.select("model_id", "text").join(listed, "model_id", "left").mapInPandas(run, "model_id string, text string")
