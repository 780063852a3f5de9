"""Model files in XML as a Spark data source, read a piece at a time, and catalogs written as such files."""

from __future__ import annotations

import codecs
import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import Catalog
from ..functions.text import escape_xml

NODES = "model_id string, node long, parent long, tag string, scalar string, label string, is_first boolean, ancestors array<long>, within map<string,long>"
#: Tags whose nearest ancestor a node remembers.
OWNERS = {"table", "column", "key", "index", "indexcolumn", "reference", "join", "domain", "tablesymbol", "primarykey"}
PIECE = 1 << 20
#: A task reads files up to this many bytes, or one file.
TASK = 64 << 20


def tag_of(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


@dataclass
class _Element:
    """An element that is still open: what its own row needs of the children, which have gone by then."""

    name: str
    node: int
    parent: int
    is_first: bool
    up: list[int]
    within: dict[str, int]
    text: list[str] = field(default_factory=list)
    #: The scalar of the first child of each name, and the first label that a child had.
    entries: dict[str, str | None] = field(default_factory=dict)
    inner: str | None = None

    def summary(self) -> tuple[str | None, str | None]:
        """(scalar, label). scalar: the text, else that of a child `value` or `text`, else of the only entry. label: that of the
        child code, name or id, else the first text found inside."""
        text, entries = "".join(self.text).strip(), self.entries
        if not entries:
            return text, text
        by_tag = {tag_of(name): scalar for name, scalar in entries.items()}
        named = next((by_tag[k] for k in ("code", "name", "id") if k in by_tag), None)
        scalar = text or next((entries[k] for k in ("value", "text") if k in entries), next(iter(entries.values())) if len(entries) == 1 else None)
        return scalar, named if named is not None else self.inner or text or None


def parse(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """NODES without model_id of a file in UTF-8, each as its element ends; `node` counts starts, attributes before children.
    Names keep their prefix until they become tags, and prefixes need no declaration. Of a file with an error in it, what stands
    before the error counts. Held are the open elements and the rows of one piece, however long the file is."""
    root = _Element("", -1, -2, False, [], {})
    open_, seen, out, count = [root], [set()], [], 0

    def begin(name: str) -> None:
        nonlocal count
        above = open_[-1]
        owner = tag_of(above.name)
        owner = "join" if owner == "referencejoin" else owner
        within = {**above.within, owner: above.node} if owner in OWNERS else above.within
        open_.append(_Element(name, count, above.node, above is root or name not in seen[-1], [*above.up, above.node] if above is not root else [], within))
        seen[-1].add(name)
        seen.append(set())
        count += 1

    def end(_name: str | None = None) -> None:
        e = open_.pop()
        seen.pop()
        scalar, label = e.summary()
        if e.name not in open_[-1].entries:
            open_[-1].entries[e.name] = scalar
        open_[-1].inner = open_[-1].inner or label
        out.append((e.node, e.parent, tag_of(e.name), scalar, label, e.is_first, e.up, e.within))

    def said(more: str) -> None:
        if open_[-1].text or not more.isspace():  # blanks before any text go anyway
            open_[-1].text.append(more)

    def start(name: str, attributes: list[str]) -> None:
        begin(name)
        for key, value in zip(attributes[::2], attributes[1::2]):
            begin(key)
            said(value)
            end()

    parser = expat.ParserCreate(encoding="UTF-8")
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    try:
        for piece in pieces:
            parser.Parse(decoder.decode(piece).encode(), False)
            yield from out
            out.clear()
        parser.Parse(decoder.decode(b"", True).encode(), True)
    except expat.ExpatError:
        pass
    while len(open_) > 1:
        end()
    yield from out


def _opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in a URI)."""
    if path.startswith(("file:", "/")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        return pafs.LocalFileSystem(), local, "file:"
    system, inside = pafs.FileSystem.from_uri(path)
    return system, inside, path[: path.index(inside)] if inside in path else path.split("://")[0] + "://"


def _ident(path: str) -> str:
    """A path as Spark names files in `_metadata.file_path`: what may not stand in a URI is escaped."""
    return re.sub(r'[\x00-\x20"%#?<>\[\]\\^`{|}]', lambda m: f"%{ord(m[0]):02X}", path)


def can_open(path: str) -> bool:
    """Whether pyarrow has a client for the path's file system here."""
    try:
        _opened(path)
    except Exception:
        return False
    return True


@dataclass
class _Files(InputPartition):
    """Paths of the files that one task reads."""

    files: list[str]


class ModelReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options.get("path"), options.get("pathGlobFilter", "*")
        self.task = int(options.get("taskBytes", TASK))
        if not self.path:
            raise ValueError("load() needs a path")

    def partitions(self) -> list[InputPartition]:
        """Files by size of the work, in the order of their paths; hidden and empty ones are left out, as Spark's own sources do."""
        system, inside, _ = _opened(self.path)
        info = system.get_file_info(inside)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inside, recursive=True))
        base = 0 if info.is_file else len(inside.rstrip("/")) + 1
        hidden = lambda p: any(x[:1] in ("_", ".") for x in p[base:].split("/")) if base else False
        groups: list[list[str]] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            if not f.is_file or not f.size or hidden(f.path) or not fnmatch.fnmatch(os.path.basename(f.path), self.glob):
                continue
            if not groups or f.size > room:
                groups.append([])
                room = self.task
            groups[-1].append(f.path)
            room -= f.size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _, before = _opened(self.path)
        for path in partition.files:
            ident, name = before + _ident(path), os.path.basename(path)
            yield (ident, name.rsplit(".", 1)[0] if "." in name else name, -1, None, None, None, None, False, [], {})
            with system.open_input_stream(path) as stream:
                for row in parse(iter(lambda: stream.read(PIECE), b"")):
                    yield (ident, None, *row)


class ModelSource(DataSource):
    """`spark.read.format("model_xml").load(path)`: the nodes of all model files under a path.

    One row a node, and one with node -1 and the model's name a file. Options: pathGlobFilter, taskBytes (files are read
    together up to this size; a file is never cut). The path's file system is opened by pyarrow in the tasks."""

    @classmethod
    def name(cls) -> str:
        return "model_xml"

    def schema(self) -> str:
        return NODES.replace("model_id string", "model_id string, model_name string")

    def reader(self, schema) -> DataSourceReader:
        return ModelReader(self.options)


def read_nodes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of ModelSource."""
    spark.dataSource.register(ModelSource)
    return spark.read.format("model_xml").options(**options).load(path)


def _element(name: str, value: Column) -> Column:
    """Null values have no element, which concat_ws leaves out."""
    return F.concat(F.lit(f"<a:{name}>"), escape_xml(value.cast("string")), F.lit(f"</a:{name}>"))


def _line(*parts: Column | str) -> Column:
    return F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _id(value: Column) -> Column:
    """An object's id in the file: not the catalog's own, as readers number objects anew in that form."""
    return F.concat(F.lit("id-"), F.replace(escape_xml(value), F.lit('"'), F.lit("&quot;")))


def _flag(value: Column) -> Column:
    return F.when(value, "1")


def model_lines(c: Catalog, models: DataFrame) -> DataFrame:
    """(model, at, line): the files' lines in the order of `at`. models: (table_id, model); a table in no model is left out, a
    reference stands in the model of its child. File ids are the catalog's with `id-` before; symbols and indexes aren't written."""
    c = c.complete()
    tables = c.tables.join(models.select("table_id", "model"), "table_id")
    own = tables.select("table_id", "table_ord", "model")
    at = lambda section, *more: F.struct(*(x.cast("long").alias(f"a{i}") for i, x in enumerate((F.lit(section), *more, *[F.lit(0)] * (3 - len(more))))))
    table, column = F.col("table_ord"), F.col("col_ord")
    text = ("Name", "name"), ("Code", "code"), ("Comment", "comment")
    named = [_element(tag, F.col(name)) for tag, name in text]
    refer = lambda kind, value: F.coalesce(F.concat(F.lit(f'<o:{kind} Ref="'), _id(value), F.lit('"/>')), F.lit(""))
    head = _line('<o:Table Id="', _id(F.col("table_id")), '">', *named, "<c:Columns>")
    typed = [_element("DataType", F.col("data_type")), _element("Length", F.col("length")), _element("Precision", F.col("precision")), _element("DefaultValue", F.col("default_value"))]
    flags = [_element("Column.Mandatory", _flag(F.col("mandatory"))), _element("Identity", _flag(F.col("identity")))]
    key_columns = F.array_join(F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda x: refer("Column", x)), "")
    keys = c.keys.join(own, "table_id")
    first = keys.filter("is_primary").groupBy("table_id").agg(F.min_by("key_id", "key_ord").alias("primary"))
    chosen = F.when(F.col("primary").isNotNull(), F.concat(F.lit("<c:PrimaryKey>"), refer("Key", F.col("primary")), F.lit("</c:PrimaryKey>")))
    pairs = F.array_join(F.transform("joins", lambda j: F.concat(F.lit("<o:ReferenceJoin><c:Object1>"), refer("Column", j["parent_column"]), F.lit("</c:Object1><c:Object2>"), refer("Column", j["child_column"]), F.lit("</c:Object2></o:ReferenceJoin>"))), "")
    refs = c.refs.join(own.select(F.col("table_id").alias("child_table"), "model"), "child_table")
    ends = [_line(f"<c:{side}Table>", refer("Table", F.col(f"{side.lower()}_table")), f"</c:{side}Table>") for side in ("Parent", "Child")]
    rules = [_element("Cardinality", F.col("cardinality")), _element("DeleteConstraint", F.col("on_delete")), _element("UpdateConstraint", F.col("on_update"))]
    every = models.select("model").distinct()
    parts = [
        every.select("model", at(0).alias("at"), _line('<?xml version="1.0" encoding="UTF-8"?>\n<o:Model Id="', _id(F.col("model")), '">', _element("Name", F.col("model")), "<c:Tables>").alias("line")),
        tables.select("model", at(1, table).alias("at"), head.alias("line")),
        c.columns.join(own, "table_id").select("model", at(1, table, F.lit(1), column).alias("at"), _line('<o:Column Id="', _id(F.col("column_id")), '">', *named, *typed, *flags, "</o:Column>").alias("line")),
        own.select("model", at(1, table, F.lit(2)).alias("at"), F.lit("</c:Columns><c:Keys>").alias("line")),
        keys.select("model", at(1, table, F.lit(3), F.col("key_ord")).alias("at"), _line('<o:Key Id="', _id(F.col("key_id")), '">', _element("Name", F.col("name")), "<c:Key.Columns>", key_columns, "</c:Key.Columns></o:Key>").alias("line")),
        own.join(first, "table_id", "left").select("model", at(1, table, F.lit(4)).alias("at"), _line("</c:Keys>", chosen, "</o:Table>").alias("line")),
        every.select("model", at(2).alias("at"), F.lit("</c:Tables><c:References>").alias("line")),
        refs.select("model", at(3, F.col("ref_ord")).alias("at"), _line('<o:Reference Id="', _id(F.col("ref_id")), '">', _element("Name", F.col("name")), *rules, *ends, "<c:Joins>", pairs, "</c:Joins></o:Reference>").alias("line")),
        every.select("model", at(4).alias("at"), F.lit("</c:References></o:Model>").alias("line")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_models(lines: DataFrame, path: str) -> None:
    """One file a model, in a folder of its own (model=...): the lines are sorted on disk and streamed, never gathered in memory."""
    lines.repartition("model").sortWithinPartitions("model", "at").select("model", "line").write.partitionBy("model").text(path)
