"""Passages of filings: what stands above a table carried to its rows, and lines packed to a length.

Notes (titles, sub-headings, captions, units, periods) are carried by windows over a
filing's pieces, rows are written by array expressions, and only the places where one
passage ends and the next begins need an ordered fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .markup import pieces
from .ordered import by_row, fold
from .text import held

c = F.col

# How filings write units, sub-headings, business years and days, and what rows of numbers consist of.
UNIT = r"단위\s*[:：]\s*([^)\]]+)"
SUBHEADING = r"^[가-하]\.\s*\S"
YEAR_NUMBER = r"제\s*(\d+)\s*기"
DAY = r"\d{4}\.\d{2}\.\d{2}"
NUMERIC = r"^[\d,.\s△()%\-]*$"
THREE_MONTHS = "3개월"
REMARK = "※"
#: A text with a unit that is shorter than this is a note; a sub-heading is not longer than this.
UNIT_NOTE, SHORT_HEADING = 60, 40
SPAN = "array<struct<year:string,first:string,last:string>>"


def _line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def _own(row: Column) -> Column:
    """The texts of a row without copies and empty cells."""
    return F.transform(F.filter(row, lambda x: ~x["copy"] & (x["text"] != "")), lambda x: _line(x["text"]))


def _unit(text: Column) -> Column:
    """The unit that a text notes; null if none."""
    found = F.regexp_extract(text, UNIT, 1)
    return F.when(found != "", F.trim(found))


def _classified(found: DataFrame) -> DataFrame:
    """Pieces with what they are: title, sub, unit, para, paras, cover or data; and what they note."""
    rows = F.filter("rows", lambda r: F.exists(r, lambda x: x["text"] != ""))
    t = found.withColumn("rows", rows).withColumn("own", F.transform("rows", _own)).withColumn("flat", F.flatten("own"))
    single = (F.size("rows") == 1) | F.forall("own", lambda r: F.size(r) == 1)
    remark = F.exists("flat", lambda x: x.startswith(REMARK)) & ~F.exists("flat", lambda x: x.rlike(NUMERIC))
    units = F.filter(F.transform("flat", _unit), lambda u: u.isNotNull())
    others = F.filter("flat", lambda x: _unit(x).isNull())
    dated = lambda x: x.rlike(YEAR_NUMBER) & x.rlike(DAY)
    days = lambda x: F.regexp_extract_all(x, F.lit(DAY), F.lit(0))
    spans = F.transform(F.filter(others, dated), lambda x: F.struct(F.regexp_extract(x, YEAR_NUMBER, 1).alias("year"), F.element_at(days(x), 1).alias("first"), F.element_at(days(x), -1).alias("last")))
    is_table, noted = c("kind") == "table", _unit(c("text"))
    heading = ~is_table & c("text").rlike(SUBHEADING)
    what = (
        F.when(c("kind") == "title", "title").when(is_table & (F.size("rows") == 0), "nothing").when(is_table & remark, "paras")
        .when(is_table & single, F.when(F.size(units) > 0, "cover").otherwise("para")).when(is_table, "data")
        .when(noted.isNotNull() & (F.length("text") < UNIT_NOTE), "unit").when(heading & (F.length("text") <= SHORT_HEADING), "sub").otherwise("para")
    )
    t = t.withColumn("what", what)
    cover = c("what") == "cover"
    return t.withColumns(
        {
            "unit": F.when(cover, F.get(units, 0)).when(c("what") == "unit", noted),
            "spans": F.when(cover & (F.size(spans) > 0), spans),
            "caption": F.when(cover, F.array_join(F.filter(others, lambda x: ~dated(x)), " ")),
            "sub": F.when(c("what") == "sub", c("text")).when(heading, F.lit("")),
            "said": F.when(is_table & (what == "para"), F.array_join("flat", " | ")).otherwise(c("text")),
        }
    )


def _carried(found: DataFrame) -> DataFrame:
    """Every piece with the title, sub-heading, caption, unit and spans that hold for it.

    A title ends what was noted before it; a data table uses up caption, unit and spans.
    """
    page = Window.partitionBy("doc_id").orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    titles = F.count_if(c("what") == "title").over(upto)
    t = found.withColumns({"_titles": titles, "_used": titles + F.coalesce(F.count_if(c("what") == "data").over(before), F.lit(0))})
    under = Window.partitionBy("doc_id", "_titles").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    noted = Window.partitionBy("doc_id", "_used").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    return t.withColumns(
        {
            "title": F.coalesce(last(F.when(c("what") == "title", c("text")), under), F.lit("")),
            "sub": F.coalesce(last(c("sub"), under), F.lit("")),
            "unit": F.coalesce(last(c("unit"), noted), F.lit("")),
            "caption": F.coalesce(last(c("caption"), noted), F.lit("")),
            "spans": F.coalesce(last(c("spans"), noted), F.array().cast(SPAN)),
        }
    )


def _heading(title: Column, sub: Column) -> Column:
    return F.array_join(F.filter(F.array(title, sub), lambda x: x != ""), " > ")


def _labels(rows: Column, heads: Column, spans: Column) -> Column:
    """A label for each column: the texts of the head from top to bottom, equal neighbours once, with the days of its business year."""
    top = F.slice(rows, F.lit(1), heads)
    width = F.array_max(F.transform(top, F.size))

    def dated(label):
        mine = F.get(F.filter(spans, lambda s: s["year"] == F.regexp_extract(label, YEAR_NUMBER, 1)), 0)
        last = mine["last"]
        quarter = F.format_string("%s.%02d.01", F.substring(last, 1, 4), F.substring(last, 6, 2).cast("int") - 2)
        first = F.when(label.contains(THREE_MONTHS), quarter).otherwise(mine["first"])
        shown = F.when(mine["first"] == last, last).otherwise(F.concat(first, F.lit("~"), last))
        return F.when(mine.isNull(), label).otherwise(F.concat(label, F.lit("("), shown, F.lit(")")))

    def label(k):
        texts = F.filter(F.transform(top, lambda r: _line(F.coalesce(F.get(r, k)["text"], F.lit("")))), lambda x: x != "")
        return held(texts, lambda ts: F.array_join(F.filter(ts, lambda x, i: (i == 0) | (x != F.get(ts, i - 1))), " "))

    return F.transform(F.sequence(F.lit(0), width - 1), lambda k: held(label(k), dated))


def table_rows(carried: DataFrame) -> DataFrame:
    """doc_id, pos, row, heading, caption, unit, labels and values of the data tables' rows.

    A row without first cell and numbers names periods; it is no row, and its texts join
    the labels of the rows below it.
    """
    heads = F.greatest(F.lit(1), F.least(c("heads"), F.size("rows") - 1))
    t = carried.where("what = 'data'").withColumn("heads", heads).withColumn("labels", _labels(c("rows"), c("heads"), c("spans")))
    body = t.select("doc_id", "pos", "outer", "inner", _heading(c("title"), c("sub")).alias("heading"), "caption", "unit", "labels", F.posexplode(F.slice("rows", c("heads") + 1, F.size("rows"))).alias("row", "cells"))
    values = F.transform("cells", lambda x: F.when(x["copy"], "").otherwise(_line(x["text"])))
    body = body.withColumn("values", values).drop("cells")
    rest = F.filter(F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0))), lambda v: v != "")
    names = (F.size("values") == F.size("labels")) & (F.get("values", F.lit(0)) == "") & (F.size(rest) > 0) & ~F.exists(rest, lambda v: v.rlike(NUMERIC))
    above = Window.partitionBy("doc_id", "pos").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("_names", names).withColumn("_periods", F.last(F.when(names, c("values")), ignorenulls=True).over(above))
    named = F.transform("labels", lambda h, k: F.when(F.coalesce(F.get("_periods", k), F.lit("")) == "", h).otherwise(F.concat(h, F.lit("("), F.get("_periods", k), F.lit(")"))))
    return body.where(~c("_names")).withColumn("labels", F.coalesce(F.when(c("_periods").isNotNull(), named), c("labels"))).drop("_names", "_periods")


def carried_tables(found: DataFrame) -> DataFrame:
    """table_rows of pieces."""
    return table_rows(_carried(_classified(found)))


def _written(labels: Column, values: Column) -> Column:
    """A row's values, each behind its label where the row has as many cells as there are labels."""
    each = F.zip_with(labels, values, lambda h, v: F.when(h == "", v).otherwise(F.concat(h, F.lit(": "), v)))
    named = F.filter(F.transform(each, lambda x, k: F.when(F.get(values, k) != "", x)), lambda x: x.isNotNull())
    return F.array_join(F.when(F.size(labels) == F.size(values), named).otherwise(F.filter(values, lambda v: v != "")), " | ")


def _marked(heading: Column, caption: Column, unit: Column) -> Column:
    """The mark of a table's row, by which numbers in it are read."""
    parts = F.array(F.trim(F.concat(heading, F.lit(" 표"))), caption, F.when(unit != "", F.concat(F.lit("단위 "), unit)).otherwise(""))
    return F.concat(F.lit("["), F.array_join(F.filter(parts, lambda x: x != ""), ", "), F.lit("] "))


def lines(found: DataFrame) -> DataFrame:
    """doc_id, outer, inner, pos, row, kind (title, para or row), title and text of the pieces, tables as their rows."""
    # Three selections follow; the pieces are read, classified and carried once for them all.
    carried = cut(_carried(_classified(found)).where("what in ('title', 'sub', 'para', 'paras', 'data')").select("doc_id", "outer", "inner", "pos", "what", "title", "sub", "said", "own", "heads", "rows", "spans", "caption", "unit"))
    plain = carried.where("what in ('title', 'sub', 'para')").select(
        "doc_id", "outer", "inner", "pos", F.lit(0).alias("row"), F.when(c("what") == "para", "para").otherwise("title").alias("kind"), _heading(c("title"), c("sub")).alias("title"), F.when(c("what") == "sub", _heading(c("title"), c("sub"))).otherwise(c("said")).alias("text")
    )
    remarks = carried.where("what = 'paras'").select("doc_id", "outer", "inner", "pos", F.posexplode(F.transform("own", lambda r: F.array_join(r, " "))).alias("row", "text"), _heading(c("title"), c("sub")).alias("title"))
    remarks = remarks.where("text <> ''").select("doc_id", "outer", "inner", "pos", "row", F.lit("para").alias("kind"), "title", "text")
    rows = table_rows(carried).withColumn("_text", _written(c("labels"), c("values"))).where("_text <> ''")
    rows = rows.select("doc_id", "outer", "inner", "pos", "row", F.lit("row").alias("kind"), c("heading").alias("title"), F.concat(_marked(c("heading"), c("caption"), c("unit")), "_text").alias("text"))
    return plain.unionByName(remarks).unionByName(rows)


def packed(found: DataFrame, most: int = 600) -> DataFrame:
    """doc_id, idx and text: the lines of each filing joined to passages of at most `most` characters.

    found: doc_id, pos, row, kind, title and text. A title ends a passage; longer
    paragraphs are split after sentences; a line that is longer still stands alone. A
    passage that begins with a paragraph names its title first.
    """
    split = F.when((c("kind") == "para") & (F.length("text") > most), F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")).otherwise(F.array("text"))
    units = found.select("doc_id", "pos", "row", "kind", "title", F.posexplode(split).alias("part", "text"))
    units = units.withColumn("named", F.when((c("kind") == "para") & (c("title") != ""), F.length("title") + 3).otherwise(F.lit(0))).withColumn("size", F.length("text"))

    def step(state, unit):
        idx, used = state or (-1, None)
        if unit.kind == "title":
            return (idx, None), (None,)
        if used is None or used + 1 + unit.size > most:
            return (idx + 1, unit.named + unit.size), (idx + 1,)
        return (idx, used + 1 + unit.size), (idx,)

    placed = fold(units, ["doc_id"], ["pos", "row", "part"], "idx int", by_row(step, ["idx"])).where("idx is not null")
    first = F.min_by(F.when(c("named") > 0, F.concat(F.lit("["), "title", F.lit("] "))).otherwise(""), F.struct("pos", "row", "part"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "row", "part", "text"))), lambda x: x["text"])
    return placed.groupBy("doc_id", "idx").agg(F.concat(first, F.array_join(texts, " ")).alias("text"))


def filing_passages(docs: DataFrame, wanted: str, most: int = 600, without: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, section, idx, text, id and sha of the passages of one section of filings (doc_id, xml).

    The section is the one, of either level, whose title's key is `wanted`; sections in it
    whose titles hold a word of `without` are left out. Passages end at titles; rows of
    tables carry title, sub-heading, caption, unit, headers and periods. A filing without
    the section gives no rows.
    """
    inside = (c("outer") == wanted) | (c("inner") == wanted)
    for word in without:
        inside = inside & ~c("inner").contains(word)
    made = packed(lines(pieces(docs).where(inside)), most).withColumn("section", F.lit(wanted))
    return made.select("doc_id", "section", "idx", "text", F.format_string("%d-%s-%04d", "doc_id", "section", "idx").alias("id"), F.sha2("text", 256).alias("sha"))
