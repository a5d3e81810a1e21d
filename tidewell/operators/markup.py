"""Pieces of marked-up filings: titles, texts and tables in order, with the sections they stand in.

The markup of one filing is read by the standard library's tag reader; everything after
that works on the table of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

CELLS = "array<array<struct<text:string,copy:boolean>>>"
PIECES = f"doc_id long, pos int, kind string, outer string, inner string, text string, heads int, rows {CELLS}"
_ARROW = {
    "doc_id": pa.int64(), "pos": pa.int32(), "kind": pa.string(), "outer": pa.string(), "inner": pa.string(), "text": pa.string(), "heads": pa.int32(),
    "rows": pa.list_(pa.list_(pa.struct([("text", pa.string()), ("copy", pa.bool_())]))),
}
#: Characters of filings whose pieces go back together, and filings that are held as Python strings at a time.
READ_AT_ONCE, ROWS_AT_ONCE = 2_000_000, 64
_ROMAN = str.maketrans({"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV"})
#: Elements whose start or end parts one text from the next.
_BREAKS = frozenset("p div library body document title table-group".split())
#: Columns that one cell covers at most, as browsers have it.
MOST_ACROSS = 1000


def title_key(title: str) -> str:
    """A title without white space, with roman numbers as letters."""
    return re.sub(r"\s+", "", title).translate(_ROMAN)


def laid_out(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, bool]]]:
    """Rows of (text, columns, rows) cells as full rows of (text, whether it is a column's copy).

    A cell's text stands in every row that it covers, down to the table's last; in the
    columns it covers it stands once, and copies after it.
    """
    out: list[list[tuple[str, bool]]] = []
    from_above: dict[int, tuple[str, bool, int]] = {}
    for row in rows:
        line = {k: (text, copy) for k, (text, copy, _) in from_above.items()}
        below = {k: (text, copy, left - 1) for k, (text, copy, left) in from_above.items() if left > 1}
        at = 0
        for text, across, down in row:
            while at in from_above:
                at += 1
            for k in range(at, at + across):
                line[k] = (text, k > at)
                if down > 1:
                    below[k] = (text, k > at, down - 1)
            at += across
        out.append([line.get(k, ("", False)) for k in range(max(line, default=-1) + 1)])
        from_above = below
    return out


class _Reader(HTMLParser):
    """Collects (kind, outer, inner, text, heads, rows) of a filing; no tag needs its end."""

    CDATA_CONTENT_ELEMENTS = ()
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.names, self.unnamed = {1: "", 2: ""}, 0
        self.said: list[str] = []
        self.kind, self.table, self.row, self.cell, self.heads, self.heading = "text", None, None, None, 0, False

    def _emit(self, kind: str, text: str, heads: int = 0, rows: list | None = None) -> None:
        self.found.append((kind, self.names[1], self.names[2], text, heads, rows or []))

    def _flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.said)).strip()
        self.said = []
        if text:
            if self.kind == "title" and self.unnamed:
                self.names[self.unnamed], self.unnamed = title_key(text), 0
            self._emit(self.kind, text)
        self.kind = "text"

    def _end_cell(self) -> None:
        if self.cell is not None:
            lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(self.cell[0]).split("\n")]
            self.row.append(("\n".join(x for x in lines if x), *self.cell[1:]))
            self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.row is not None:
            self.table.append(self.row)
            self.heads += self.heading
            self.row = None

    def _end_table(self) -> None:
        if self.table is not None:
            self._end_row()
            self._emit("table", "", self.heads, laid_out(self.table))
            self.table = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if m := re.fullmatch(r"section-([12])", tag):
            self._end_table()
            self._flush()
            self.unnamed = int(m[1])
            for level in range(self.unnamed, 3):
                self.names[level] = ""
        elif tag == "table":
            self._end_table()
            self._flush()
            self.table, self.heads, self.heading = [], 0, False
        elif self.table is None:
            if tag in _BREAKS:
                self._flush()
                self.kind = "title" if tag == "title" else "text"
            elif tag == "br":
                self.said.append(" ")
        elif tag in ("thead", "tbody", "tfoot"):
            self._end_row()
            self.heading = tag == "thead"
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th", "te", "tu"):
            self._end_cell()
            self.row = [] if self.row is None else self.row
            span = {k: int(v) if (v or "").isdigit() else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = ([], min(max(1, span.get("colspan", 1)), MOST_ACROSS), max(1, span.get("rowspan", 1)))
        elif tag == "br" and self.cell is not None:
            self.cell[0].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self._end_table()
        elif self.table is None:
            if tag in _BREAKS or tag.startswith("section-"):
                self._flush()
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row()
            self.heading = self.heading and tag != "thead"
        elif tag in ("td", "th", "te", "tu"):
            self._end_cell()

    def handle_data(self, data: str) -> None:
        if self.table is None:
            self.said.append(data)
        elif self.cell is not None:
            self.cell[0].append(data.replace("\n", " "))

    def close(self) -> None:
        super().close()
        self._end_table()
        self._flush()


def read(xml: str | None) -> list[tuple]:
    reader = _Reader()
    reader.feed(xml or "")
    reader.close()
    return reader.found


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as a shuffle has: a file of few row groups is otherwise read, and worked through, by as few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind (title, text or table), outer and inner (keys of the sections of both levels), text, heads (rows of
    a table's head) and rows (its cells, spans filled), of the filings docs (doc_id, xml).

    A section runs to the next one of its level or above, closing tags or not; its first
    title names it. References are decoded; lines in a cell stay apart. Null gives no rows.
    A batch holds the pieces of some READ_AT_ONCE characters, or of one filing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                for doc_id, xml in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += [(doc_id, pos, *piece) for pos, piece in enumerate(read(xml))]
                    size += len(xml or "")
                    if size >= READ_AT_ONCE:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    return spread(docs.select(c("doc_id").cast("long"), "xml"), "doc_id").mapInArrow(run, PIECES)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ARROW.values(), strict=True)], list(_ARROW))
