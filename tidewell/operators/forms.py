"""Forms of preliminary results: figures of both layouts, the spans they are of, and what a correction changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .markup import pieces

c = F.col

# Units, names of rows and columns of the form, and how it writes quarters and days.
UNIT_WON = {"원": 1, "천원": 10**3, "백만원": 10**6, "억원": 10**8, "조원": 10**12}
BASES = ("당해실적", "누계실적")
SPAN_ROWS = ("당기실적", "전기실적", "전년동기실적", "당기누계실적", "전년동기누적실적")
HEADER = ("구분", "당기실적", "전기실적", "전기대비", "전년동기실적", "전년동기대비")
HEADER_RATE = r"증감율\(%\)$"
CORRECTED = ("정정항목", "정정전", "정정후")
CORRECTION_ROW, CORRECTION_TEXT, ORIGINAL_ROW = "정정일자", "정정신고(보고)", "정정관련 공시서류제출일"
UNIT_CELL = r"단위\s*[:：]\s*([^,)\s]+)"
SHORT_QUARTER = r"^\(\s*['’]?(\d{2})\.([1-4])Q\s*\)$"
LONG_QUARTER = r"^\(\s*(\d{4})\s*년\s*([1-4])\s*분기\s*\)$"
ITEM = r"^-\s*(.+?)\((당해실적|누계실적)\)\s*$"
GROUP_MARK, GROUP_QUARTER = "·", r"\(['’]?\d{2}\.\d[QH]\)\s*$"
KOREAN_DAY = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
_AMOUNT = "decimal(28,4)"


def form_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, row, cells (with lines) and flat (without) of every table's rows; a cell that reaches down stands in each row."""
    tables = pieces(docs).where("kind = 'table'").select("doc_id", "pos", F.posexplode("rows").alias("row", "r"))
    cells = F.transform(F.filter("r", lambda x: ~x["copy"]), lambda x: x["text"])
    return tables.select("doc_id", "pos", "row", cells.alias("cells")).withColumn("flat", F.transform("cells", lambda x: F.replace(x, F.lit("\n"), F.lit(" "))))


def number(text: Column) -> Column:
    """A form's number; null for blanks, dashes and words."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast(_AMOUNT)


def _word(text: Column) -> Column:
    return F.when(~F.trim(text).isin("", "-"), F.trim(text))


def _cell(k: int) -> Column:
    return F.get("flat", F.lit(k))


def figures(rows: DataFrame) -> DataFrame:
    """doc_id, account, basis, current, prior, prior_year, the changes against these two in percent, and in words where a sign turned.

    The newer layout has a column for the words, the older one writes them in the place of
    the percentage. Rows without any value, and tables under other headers, are left out.
    """
    plain = F.transform("flat", lambda x: F.trim(F.regexp_replace(x, HEADER_RATE, "")))
    headed = rows.where(plain == F.array(*map(F.lit, HEADER))).select("doc_id", "pos").distinct()
    new, old = F.size("flat") == 9, F.size("flat") == 7
    pick = lambda a, b: F.when(new, _cell(a)).otherwise(_cell(b))
    word = lambda a, b: F.when(new, _word(_cell(a))).otherwise(F.when(number(_cell(b)).isNull(), _word(_cell(b))))
    made = rows.where(new | old).where(_cell(1).isin(*BASES)).join(headed, ["doc_id", "pos"], "left_semi")
    made = made.select(
        "doc_id", _cell(0).alias("account"), _cell(1).alias("basis"), number(_cell(2)).alias("current"), number(_cell(3)).alias("prior"), number(_cell(4)).alias("prior_change"), word(5, 4).alias("prior_turn"),
        number(pick(6, 5)).alias("prior_year"), number(pick(7, 6)).alias("year_change"), word(8, 6).alias("year_turn"), F.length(F.regexp_extract(_cell(2), r"\.(\d+)", 1)).alias("places"),
    )
    return made.where(F.coalesce("current", "prior", "prior_change", "prior_year", "year_change").isNotNull())


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, name, first and last day of what the form's columns are of.

    Newer forms list days; older ones write three quarters below the header, from which
    the spans from January follow.
    """
    days = lambda x: F.regexp_extract_all(x, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))
    rest = days(F.array_join(F.slice("flat", F.lit(2), F.greatest(F.size("flat") - 1, F.lit(0))), " "))
    listed = rows.where(_cell(0).isin(*SPAN_ROWS) & (F.size(rest) == 2)).select("doc_id", _cell(0).alias("name"), rest[0].cast("date").alias("first"), rest[1].cast("date").alias("last"))

    def quarter(x):
        year = F.coalesce((F.lit(2000) + F.regexp_extract(x, SHORT_QUARTER, 1).try_cast("int")), F.regexp_extract(x, LONG_QUARTER, 1).try_cast("int"))
        n = F.coalesce(F.regexp_extract(x, SHORT_QUARTER, 2).try_cast("int"), F.regexp_extract(x, LONG_QUARTER, 2).try_cast("int"))
        return F.make_date(year, 3 * n - 2, F.lit(1))

    quarters = F.filter(F.transform("flat", lambda x: quarter(F.trim(x))), lambda d: d.isNotNull())
    written = rows.where(F.size(quarters) == 3).select("doc_id", quarters.alias("q"))
    end = lambda d: F.last_day(F.add_months(d, 2))
    named = F.array(
        *(F.struct(F.lit(n).alias("name"), c("q")[k].alias("first"), end(c("q")[k]).alias("last")) for n, k in zip(SPAN_ROWS[:3], range(3), strict=True)),
        *(F.struct(F.lit(n).alias("name"), F.trunc(c("q")[k], "year").alias("first"), end(c("q")[k]).alias("last")) for n, k in zip(SPAN_ROWS[3:], (0, 2), strict=True)),
    )
    older = written.select("doc_id", F.explode(named).alias("x")).select("doc_id", "x.*").join(listed.where(c("name") == SPAN_ROWS[0]), "doc_id", "left_anti")
    return listed.unionByName(older)


def corrections(rows: DataFrame) -> DataFrame:
    """doc_id, heading, item, basis, before and after of the numbers that a correction changed; cells are read line by line.

    A row whose lines do not all pair up with numbers is text and is left out.
    """
    table = Window.partitionBy("doc_id", "pos")
    starts = F.collect_list(F.when(c("flat") == F.array(*map(F.lit, CORRECTED)), c("row"))).over(table)
    body = rows.where(F.size("cells") == 3).withColumn("_start", starts).withColumn("_start", F.explode("_start")).where(c("row") > c("_start"))
    cut = lambda k: F.split(F.get("cells", F.lit(k)), "\n")
    empty = F.struct(F.lit("").alias("heading"), F.array().cast("array<struct<heading:string,item:string,basis:string>>").alias("out"))

    def step(acc, x):
        named = F.trim(F.regexp_replace(F.trim(F.substr(x, F.lit(2))), GROUP_QUARTER, ""))
        item = F.struct(acc["heading"].alias("heading"), F.trim(F.regexp_extract(x, ITEM, 1)).alias("item"), F.regexp_extract(x, ITEM, 2).alias("basis"))
        return F.struct(F.when(x.startswith(GROUP_MARK), named).otherwise(acc["heading"]).alias("heading"), F.when(x.rlike(ITEM), F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    read = body.select("doc_id", F.aggregate(cut(0), empty, step, lambda acc: acc["out"]).alias("items"), F.transform(cut(1), number).alias("b"), F.transform(cut(2), number).alias("a"))
    whole = (F.size("items") > 0) & (F.size("b") == F.size("items")) & (F.size("a") == F.size("items")) & F.forall(F.concat("a", "b"), lambda v: v.isNotNull())
    each = read.where(whole).select("doc_id", F.explode(F.arrays_zip("items", "b", "a")).alias("x"))
    return each.select("doc_id", "x.items.*", c("x.b").alias("before"), c("x.a").alias("after"))


def preliminary(docs: DataFrame) -> DataFrame:
    """figures of result forms (doc_id, xml) with unit, first, last, amount and rounding_unit in won, is_correction and original_day.

    amount is the current value; it is known to rounding_unit, the unit of its last digit.
    Forms without a known unit or span of the current results give no rows.
    """
    rows = cut(form_rows(docs).select("doc_id", "pos", "row", "flat"))  # each form is read once, and its rows are used five times
    unit = F.regexp_extract(F.array_join("flat", " "), UNIT_CELL, 1)
    day = F.regexp_extract(_cell(1), KOREAN_DAY, 0)
    noted = rows.groupBy("doc_id").agg(
        F.min_by(F.when(unit != "", unit), F.when(unit != "", F.struct("pos", "row"))).alias("unit"),
        F.bool_or((_cell(0) == CORRECTION_ROW) | F.array_join("flat", " ").contains(CORRECTION_TEXT)).alias("is_correction"),
        F.min(F.when(_cell(0).contains(ORIGINAL_ROW) & (day != ""), F.make_date(*(F.regexp_extract(day, KOREAN_DAY, k).try_cast("int") for k in (1, 2, 3))))).alias("original_day"),
    )
    won = F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNIT_WON.items() for x in (k, F.lit(v).cast("decimal(13,0)"))]), c("unit"))
    name = F.when(c("basis") == BASES[0], SPAN_ROWS[0]).otherwise(SPAN_ROWS[3])
    placed = figures(rows).join(noted, "doc_id").withColumn("name", name).join(spans(rows), ["doc_id", "name"]).withColumn("_won", won).where("_won is not null")
    step = F.element_at(F.array(*(F.lit(10**k).cast("decimal(5,0)") for k in range(5))), F.least(c("places"), F.lit(4)) + 1)
    return placed.select(
        "doc_id", "account", "basis", "current", "prior", "prior_change", "prior_turn", "prior_year", "year_change", "year_turn", "unit", "first", "last",
        (c("current") * c("_won")).cast("decimal(28,0)").alias("amount"), (c("_won") / step).cast("decimal(28,4)").alias("rounding_unit"), "is_correction", F.when(c("is_correction"), c("original_day")).alias("original_day"),
    )
