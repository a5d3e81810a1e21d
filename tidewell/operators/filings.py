"""Filed tables: cells and rows with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import pieces, read
from .passages import carried_tables

c = F.col


def grid(table: str) -> list[list[str]]:
    """Cells of a table with spans filled: every row has the text of all cells that cover it; spans end with the table."""
    return next(([[text for text, _ in row] for row in rows] for kind, _, _, _, _, rows in read(table) if kind == "table"), [])


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tab, row, col, label, head, value of every filled cell of tables with a header; docs has doc_id and xml.

    The first column labels its row; a column's head is the texts of the header rows above
    it, with the periods that the table or its cover names. tab is the table's place among
    the filing's pieces; a cell that covers columns stands in the first of them.
    """
    rows = carried_tables(pieces(docs))
    each = rows.select("doc_id", c("pos").alias("tab"), (c("row") + 1).alias("row"), F.get("values", F.lit(0)).alias("label"), "labels", F.posexplode("values").alias("col", "value"))
    return each.where("col > 0 and value <> ''").select("doc_id", "tab", "row", "col", "label", F.get("labels", "col").alias("head"), "value")


def labelled_rows(cells: DataFrame) -> DataFrame:
    """doc_id, tab, row, text: a table row as `label: head value; head value`, columns in their order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("col", "head", "value"))), lambda x: F.concat(x["head"], F.lit(" "), x["value"]))
    return cells.groupBy("doc_id", "tab", "row", "label").agg(F.concat(c("label"), F.lit(": "), F.array_join(parts, "; ")).alias("text")).drop("label")
