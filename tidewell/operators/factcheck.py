"""Fact checks: periods, filed amounts and how claims compare with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import UNITS

c = F.col

# Report codes and the months they close, columns of filed tables and what they hold.
REPORT_MONTHS = {"11013": 3, "11012": 6, "11014": 9, "11011": 12}
COLUMNS = (
    (3, "thstrm", 0, "q"), (3, "frmtrm_q", -1, "q"), (6, "thstrm", 0, "q"), (6, "thstrm_add", 0, "ytd"), (6, "frmtrm_q", -1, "q"), (6, "frmtrm_add", -1, "ytd"),
    (9, "thstrm", 0, "q"), (9, "thstrm_add", 0, "ytd"), (9, "frmtrm_q", -1, "q"), (9, "frmtrm_add", -1, "ytd"), (12, "thstrm", 0, "fy"), (12, "frmtrm", -1, "fy"), (12, "bfefrmtrm", -2, "fy"),
)
STATEMENTS = ("IS", "CIS", "SCE")


def period_start(year: Column, kind: Column, n: Column, cumulative: Column) -> Column:
    from_january = (kind == "year") | cumulative | ((kind == "half") & (n == 1))
    return F.when(from_january, F.make_date(year, F.lit(1), F.lit(1))).when(kind == "half", F.make_date(year, F.lit(7), F.lit(1))).otherwise(F.make_date(year, 3 * n - 2, F.lit(1)))


def period_end(year: Column, kind: Column, n: Column) -> Column:
    quarter = F.when(kind == "year", 4).when(kind == "half", 2 * n).otherwise(n)
    return F.last_day(F.make_date(year, 3 * quarter, F.lit(1)))


def period_label(start: Column, end: Column) -> Column:
    """2025, 2025H1 or 2025Q3 from a span or a single day."""
    whole = (F.month(start) == 1) | (start == end)
    year = F.year(end).cast("string")
    return F.when((F.month(end) == 12) & whole, year).when((F.month(end) == 6) & whole, F.concat(year, F.lit("H1"))).otherwise(F.concat(year, F.lit("Q"), F.quarter(end)))


def finished_quarter(day: Column) -> Column:
    """Label of the last quarter that has ended by a day."""
    at = F.when(F.last_day(F.add_months(F.trunc(day, "quarter"), 2)) <= day, F.trunc(day, "quarter")).otherwise(F.add_months(F.trunc(day, "quarter"), -3))
    return F.concat(F.year(at), F.lit("Q"), F.quarter(at))


def filed_facts(rows: DataFrame) -> DataFrame:
    """One row for each filled column of filed rows: period label, span, amount and column.

    rows has company, year, code (report), account, statement and the text columns of
    COLUMNS. Of several statements with one account the first of STATEMENTS counts. Text
    amounts lose their commas; blanks and dashes are no amount.
    """
    spark = rows.sparkSession
    names = sorted({x[1] for x in COLUMNS})
    place = F.array_position(F.array(*map(F.lit, STATEMENTS)), c("statement"))
    first = F.row_number().over(Window.partitionBy("company", "year", "code", "account").orderBy(place))
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in REPORT_MONTHS.items() for x in kv]), c("code"))
    one = rows.where(place > 0).withColumn("_n", first).where("_n = 1").withColumn("month", month)
    long = one.unpivot(["company", "year", "month", "account"], names, "column", "raw")
    kinds = spark.createDataFrame(COLUMNS, "month int, column string, shift int, kind string")
    found = long.join(F.broadcast(kinds), ["month", "column"])
    amount = F.regexp_replace(F.trim("raw"), ",", "").try_cast("bigint")
    year = c("year") + c("shift")
    end = F.last_day(F.make_date(year, c("month"), F.lit(1)))
    start = F.when(c("kind") == "q", F.make_date(year, c("month") - 2, F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1)))
    spanned = found.withColumns({"amount": amount, "period_start": start, "period_end": end}).where("amount is not null")
    return spanned.select("company", "account", "column", period_label(c("period_start"), c("period_end")).alias("period"), "period_start", "period_end", (c("kind") == "ytd").alias("cumulative"), "amount")


def report_kind(name: Column) -> Column:
    """Struct (type, period) of a regular report's name with its month in brackets; null for others."""
    kind, year, month = (F.regexp_extract(name, r"(사업|반기|분기)보고서\s*\((\d{4})\.(\d{2})\)", i) for i in (1, 2, 3))
    made = lambda t, p: F.struct(F.lit(t).alias("type"), p.alias("period"))
    return (
        F.when((kind == "사업") & (month == "12"), made("annual", year)).when((kind == "반기") & (month == "06"), made("half", F.concat(year, F.lit("H1"))))
        .when((kind == "분기") & month.isin("03", "09"), made("quarter", F.concat(year, F.lit("Q"), (month.try_cast("int") / 3).cast("int"))))
    )


def won(value: Column, unit: Column) -> Column:
    """An amount in a table's unit as won."""
    scale = F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)]), F.regexp_replace(unit, "원$", ""))
    return (value.cast("decimal(28,6)") * F.coalesce(scale, F.lit(1)).cast("decimal(19,0)")).cast("decimal(38,6)")


def same_amount(claim: Column, step: Column, filed: Column, approx: Column, unit: Column) -> Column:
    """A claimed amount equals a filed one: same sign, equal when rounded or cut at the claim's last digit; approximate
    claims within a tenth when rounded at their last non-zero digit; amounts filed in rounded form at that unit.
    """
    a, b = F.abs(claim), F.abs(filed)
    near = lambda x, s: F.when((x % s) * 2 >= s, x - x % s + s).otherwise(x - x % s)
    zeros = F.length(F.regexp_extract((a / step).cast("decimal(38,0)").cast("string"), r"(0*)$", 1))
    coarse = step * F.pow(F.lit(10), zeros).cast("decimal(20,0)")
    exact = (near(b, step) == a) | ((b - b % step) == a)
    rough = approx & (zeros > 0) & (near(b, coarse) == a) & (F.abs(a - b) <= b / 10)
    rounded = (unit > 1) & (step < unit) & (near(a, unit) == near(b, unit))
    return (F.signum(claim) == F.signum(filed)) & (exact | rough | rounded)


# Words for accounts of a report and what they stand for.
ACCOUNTS = {
    "매출액": "revenue", "매출": "revenue", "영업이익률": "operating_margin", "영업이익": "operating_income", "영업손실": "operating_income",
    "당기순이익": "net_income", "당기순손실": "net_income", "순이익률": "net_margin", "순이익": "net_income", "순손실": "net_income",
}
_ACCOUNT = "|".join(sorted(ACCOUNTS, key=len, reverse=True))
_DIGITS = r"[-△▲]?\d[\d,]*(?:\.\d+)?"
_MONEY = rf"{_DIGITS}\s*(?:조|십억|억|천만|백만|만|천)(?:\s*\d[\d,]*(?:\.\d+)?\s*(?:십억|억|천만|백만|만|천))*(?:\s*원)?|{_DIGITS}\s*원"
_SHARE = rf"{_DIGITS}\s*(?:%p|%|퍼센트)"


def verdict(results: DataFrame, key: str) -> DataFrame:
    """Status of each sentence from its amounts' results: mismatch, match, partial or unknown."""
    wrong, right, total = F.count_if(c("result") == "mismatch"), F.count_if(c("result") == "match"), F.count("*")
    return results.groupBy(key).agg(F.when(wrong > 0, "mismatch").when(right == total, "match").when(right > 0, "partial").otherwise("unknown").alias("status"))


def reserve(events: DataFrame, key_cap: int, total_cap: int) -> DataFrame:
    """Reservations of tokens in order, accepted while a key's and then everyone's use stays within the caps.

    events: day, at, tie, key, amount. The total cap makes a day one sequence, so a day
    is a key of the fold.
    """
    from .ordered import by_row, fold

    def step(state, row):
        total, used = state or (0, {})
        mine = used.get(row.key, 0)
        ok = mine + row.amount <= key_cap and total + row.amount <= total_cap
        if ok:
            used[row.key], total = mine + row.amount, total + row.amount
        return (total, used), (bool(ok),)

    return fold(events, ["day"], ["at", "tie"], "accepted boolean", by_row(step, ["accepted"]))
