"""A small demo catalog: customers, orders and order lines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import SCHEMAS, Catalog

#: The demo model. Tables: id, code, comment, position, primary key.
TABLES = [
    ("table-1", "Customer", "Clientes del sistema", (60.0, 80.0, 260.0, 220.0), "column-1"),
    ("table-2", "Order", "Pedidos", (420.0, 140.0, 260.0, 240.0), "column-5"),
    ("table-3", "OrderLine", "Líneas del pedido", (790.0, 200.0, 260.0, 240.0), "column-9"),
]
#: Columns: table, code, type, length, mandatory, identity.
COLUMNS = [
    ("table-1", "CustomerID", "INTEGER", 10, True, True),
    ("table-1", "FirstName", "VARCHAR", 100, False, False),
    ("table-1", "LastName", "VARCHAR", 100, True, False),
    ("table-1", "Email", "VARCHAR", 200, False, False),
    ("table-2", "OrderID", "INTEGER", 10, True, True),
    ("table-2", "CustomerID", "INTEGER", 10, True, False),
    ("table-2", "OrderDate", "DATETIME", None, True, False),
    ("table-2", "Status", "VARCHAR", 50, False, False),
    ("table-3", "OrderLineID", "INTEGER", 10, True, True),
    ("table-3", "OrderID", "INTEGER", 10, True, False),
    ("table-3", "Product", "VARCHAR", 150, True, False),
    ("table-3", "Quantity", "INTEGER", 10, True, False),
]
#: References: name, parent, child, parent column, child column, on delete.
REFERENCES = [
    ("FK_Order_Customer", "table-1", "table-2", "column-1", "column-6", "No action"),
    ("FK_OrderLine_Order", "table-2", "table-3", "column-5", "column-10", "Cascade"),
]
#: Indexes: table, name, column.
INDEXES = [("table-1", "IX_Customer_Email", "column-4"), ("table-2", "IX_Order_CustomerID", "column-6"), ("table-3", "IX_OrderLine_OrderID", "column-10")]
DOMAINS = [("PK", "INTEGER"), ("Text", "VARCHAR(255)")]


def demo_catalog(spark: SparkSession) -> Catalog:
    rows = {
        "tables": [(i, t, None, code, code, said, at, [pk]) for i, (t, code, said, at, pk) in enumerate(TABLES)],
        "columns": [(t, i, f"column-{i + 1}", None, code, code, kind, n, None, must, own, None, None) for i, (t, code, kind, n, must, own) in enumerate(COLUMNS)],
        "refs": [(i, f"reference-{i + 1}", None, name, p, c, [(pc, cc)], "1:N", gone, "Cascade") for i, (name, p, c, pc, cc, gone) in enumerate(REFERENCES)],
        "indexes": [(t, i, f"index-{i + 1}", None, name, [k], False) for i, (t, name, k) in enumerate(INDEXES)],
        "keys": [(t, i, f"key-{i + 1}", None, f"PK_{code}", [pk], True) for i, (t, code, _, _, pk) in enumerate(TABLES)],
        "domains": [(i, f"domain-{i + 1}", name, kind) for i, (name, kind) in enumerate(DOMAINS)],
    }
    return Catalog(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}, name="DemoModel")
