"""A schema catalog as flat DataFrames, one row per object, each with an explicit order column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

JOINS = "array<struct<parent_column:string,child_column:string>>"
#: Every column of every frame. A frame may lack those that aren't keys or orders; `complete` adds them as nulls.
SCHEMAS = {
    "tables": "table_ord long, table_id string, pd_id string, code string, name string, comment string, position struct<x:double,y:double,w:double,h:double>, primary_key array<string>",
    "columns": "table_id string, col_ord long, column_id string, pd_id string, code string, name string, data_type string, length long, precision long, mandatory boolean, identity boolean, default_value string, comment string",
    "refs": f"ref_ord long, ref_id string, pd_id string, name string, parent_table string, child_table string, joins {JOINS}, cardinality string, on_delete string, on_update string",
    "indexes": "table_id string, index_ord long, index_id string, pd_id string, name string, columns array<string>, is_unique boolean",
    "keys": "table_id string, key_ord long, key_id string, pd_id string, name string, columns array<string>, is_primary boolean",
    "domains": "domain_ord long, domain_id string, name string, data_type string",
}


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    refs: DataFrame
    indexes: DataFrame
    keys: DataFrame
    domains: DataFrame | None = None
    name: str = "model"

    def complete(self) -> Catalog:
        """The same catalog with every column of SCHEMAS; an index or key without an id gets one from its order."""
        frames = {}
        for kind, schema in SCHEMAS.items():
            frame = getattr(self, kind)
            if frame is None:
                frame = self.tables.sparkSession.createDataFrame([], schema)
            fields = [f.split(" ", 1) for f in _fields(schema)]
            own = {"indexes": F.concat(F.lit("index-"), F.col("index_ord").cast("string")), "keys": F.concat(F.lit("key-"), F.col("key_ord").cast("string"))}.get(kind)
            for name, kind_of in fields:
                if name not in frame.columns:
                    frame = frame.withColumn(name, own if name in ("index_id", "key_id") else F.lit(None).cast(kind_of))
            frames[kind] = frame.select(*(F.col(n).cast(t) for n, t in fields))
        return Catalog(**frames, name=self.name)


def _fields(schema: str) -> list[str]:
    """The fields of a schema; commas inside <> don't part them."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
