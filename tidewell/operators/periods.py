"""Periods that a sentence names, as column expressions.

A text is a list of stretches. Kinds of expressions claim their stretches one after
another, bases of comparison first; what one kind has claimed the next ones do not see.
Then one fold from left to right gives each claimed stretch its period.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import held

# Words for years and quarters relative to the day of the report, and what years away they are; words of comparison.
YEARS_AWAY = {"올해": 0, "금년": 0, "당해 연도": 0, "이번 해": 0, "작년": -1, "지난해": -1, "전년도": -1, "전년": -1, "재작년": -2, "지지난해": -2}
QUARTERS_AWAY = {"이번 분기": 0, "최근 분기": 0, "당 분기": 0, "직전 분기": -1, "전 분기": -1, "지난 분기": -1}
LAST_YEARS_SAME = ("전년 동기", "작년 동기")
COMPARED_BASES = ("전년 동기", "작년 동기", "전년도", "전년", "작년", "지난해", "직전 분기", "전 분기", "지난 분기", "전기")
COMPARISONS = ("대비", "比", "보다", "에 비해", "와 비교")
COMPARISONS_AFTER = (*COMPARISONS, "과 비교")
CUMULATIVE = ("누적", "누계")
YEAR_WORDS = ("년도", "년", "회계연도", "사업연도")

PERIOD = "struct<start:int,end:int,label:string,year:int,kind:string,n:int,cumulative:boolean,relative:boolean,shifted:boolean>"
_NAMED = "struct<start:int,end:int,year:int,kind:string,n:int,cumulative:boolean>"
_MARK = "\x01"


def _words(words) -> str:
    """An alternative of words, longest first, with or without the blanks inside them."""
    return "|".join(r"\s*".join(map(re.escape, w.split(" "))) for w in sorted(words, key=len, reverse=True))


_LETTER = "0-9A-Za-z_가-힣"
_QUOTE = "['‘’]"
_YEAR4 = r"(?:19|20)\d{2}"
_TO = r"1\s*[~∼\-]\s*[2-4]\s*분기"
_SUM = rf"(?:\s*(?:{_words(CUMULATIVE)}))?"
#: What may follow a year: quarters from the first, a quarter, a half, a month; and that it is cumulative.
_PART = rf"(?:\s*(?:{_TO}|[1-4]\s*(?:분기|Q(?![A-Za-z]))|[상하]반기|[12]H(?![A-Za-z])|(?:1[0-2]|0?[1-9])\s*월))?{_SUM}"
_SHORT = r"(?:[1-4]\s*분기|[1-4]Q|[상하]반기|[12]H|1\s*[~∼\-])"
_NOT_AFTER_LETTER = rf"(?<![{_LETTER}.])"
#: Kinds in the order in which they claim; the first are no periods of the sentence.
KINDS = {
    "base": rf"(?:{_words(COMPARED_BASES)})\s*(?:{_words(COMPARISONS)})",
    "named": "|".join(
        (
            rf"{_NOT_AFTER_LETTER}{_YEAR4}\s*(?:Q[1-4]|H[12])(?![0-9A-Za-z]){_SUM}",
            rf"{_NOT_AFTER_LETTER}(?:[1-4]Q|[12]H)(?:{_QUOTE}?\d{{2}}|\s*{_YEAR4})(?![\d.]){_SUM}",
            rf"(?<![\d.]){_QUOTE}?(?:{_YEAR4}|\d{{2}})\.\s*(?:[1-4]Q|[12]H)(?![A-Za-z]){_SUM}",
            rf"FY\s*{_QUOTE}?(?:{_YEAR4}|\d{{2}})(?!\d){_PART}",
            rf"(?<![\d,.]){_YEAR4}(?:\s*(?:{_words(YEAR_WORDS)})|(?=\s*[1-4]Q|\s*[12]H)){_PART}",
            rf"{_QUOTE}\d{{2}}\s*(?:년도|년){_PART}",
            rf"(?<![\d,.'‘’])\d{{2}}년(?=\s*{_SHORT}){_PART}",
        )
    ),
    "same": _words(LAST_YEARS_SAME),
    "year": rf"(?:{_words(YEARS_AWAY)})(?!\s*동기){_PART}",
    "quarter": rf"(?<![가-힣])당\s*분기|{_words([w for w in QUARTERS_AWAY if not w.startswith('당')])}",
    "bare": rf"{_TO}{_SUM}|(?<![\d.])[1-4]\s*분기{_SUM}|{_NOT_AFTER_LETTER}[1-4]Q(?![0-9A-Za-z'‘’]){_SUM}|[상하]반기{_SUM}|{_NOT_AFTER_LETTER}[12]H(?![0-9A-Za-z'‘’]){_SUM}",
}
_AFTER = rf"^\s*(?:{_words(COMPARISONS_AFTER)})"


def as_of_label(label: Column) -> Column:
    """year, quarter (the last one) of a label such as 2026, 2026H1 or 2026Q2."""
    n = F.regexp_extract(label, r"[QH](\d)$", 1).try_cast("int")
    return F.struct(F.substring(label, 1, 4).try_cast("int").alias("year"), F.when(label.contains("Q"), n).when(label.contains("H"), 2 * n).otherwise(4).alias("quarter"))


def as_of_day(day: Column) -> Column:
    """year, quarter of the last quarter that has ended by a day."""
    at = F.when(F.last_day(F.add_months(F.trunc(day, "quarter"), 2)) <= day, F.trunc(day, "quarter")).otherwise(F.add_months(F.trunc(day, "quarter"), -3))
    return F.struct(F.year(at).alias("year"), F.quarter(at).alias("quarter"))


def label(year: Column, kind: Column, n: Column) -> Column:
    return F.concat(year, F.when(kind == "year", "").otherwise(F.concat(F.when(kind == "quarter", "Q").otherwise("H"), n)))


def last_quarter(kind: Column, n: Column) -> Column:
    return F.when(kind == "year", 4).when(kind == "half", 2 * n).otherwise(n)


def _claimed(stretches: Column, kind: str, pattern: str) -> Column:
    """Stretches without a kind, cut at the matches of a pattern, which get it."""

    def cut(s):
        parts = F.split(F.regexp_replace(s["text"], f"(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK)
        fresh = F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.when(i % 2 == 1, kind).otherwise("").alias("kind")))
        return F.when(s["kind"] == "", fresh).otherwise(F.array(s))

    return F.flatten(F.transform(stretches, cut))


def stretches(text: Column) -> Column:
    """Array of (text, kind, start, end, base): a text cut into claimed stretches and what lies between, which has no kind.

    base: the stretch is what another period is compared with.
    """
    whole = F.array(F.struct(F.translate(F.coalesce(text, F.lit("")), _MARK, " ").alias("text"), F.lit("").alias("kind")))
    for kind, pattern in KINDS.items():
        whole = _claimed(whole, kind, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,kind:string,start:int,end:int>>").alias("out"))

    def step(acc, s):
        end = acc["at"] + F.length(s["text"])
        here = F.struct(s["text"].alias("text"), s["kind"].alias("kind"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    placed = F.aggregate(whole, start, step, lambda acc: acc["out"])
    base = lambda ps, s, i: (s["kind"] == "base") | F.coalesce(F.get(ps, i + 1)["text"].rlike(_AFTER), F.lit(False))
    return held(placed, lambda ps: F.filter(F.transform(ps, lambda s, i: F.struct(s["text"].alias("text"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base(ps, s, i).alias("base"))), lambda s: s["kind"] != ""))


def _part(text: Column, year: Column) -> Column:
    """The period within a year that a stretch names: cumulative quarters, a quarter, a half, a quarter's last month, or the year."""
    made = lambda kind, n, whole: F.struct(year.cast("int").alias("year"), F.lit(kind).alias("kind"), n.cast("int").alias("n"), whole.alias("cumulative"))

    def read(text):
        first = lambda *patterns: F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("int") for p in patterns))
        # Each part is read once, and only where those before it were not found.
        either = lambda n, found, otherwise: held(n, lambda n: F.when(n.isNotNull(), found(n)).otherwise(otherwise))
        month = held(first(r"(\d{1,2})\s*월"), lambda n: F.when(n % 3 == 0, made("quarter", n / 3, F.lit(False))).otherwise(made("year", F.lit(0), F.lit(False))))
        half = F.coalesce(F.when(text.contains("상반기"), 1).when(text.contains("하반기"), 2), first(r"([12])H", r"H([12])(?!\d)"))
        half = either(half, lambda n: made("half", n, F.lit(False)), month)
        quarter = either(first(r"([1-4])\s*(?:분기|Q)", r"Q([1-4])(?!\d)"), lambda n: made("quarter", n, (n != 1) & text.rlike(_words(CUMULATIVE))), half)
        return either(first(r"1\s*[~∼\-]\s*([2-4])\s*분기"), lambda n: made("quarter", n, F.lit(True)), quarter)

    return held(F.regexp_replace(text, _YEAR4, " "), read)  # its last digit is no quarter


def _year(text: Column) -> Column:
    """The year that a named stretch gives, in four digits or in two."""
    four = F.regexp_extract(text, f"({_YEAR4})", 1).try_cast("int")
    two = F.regexp_extract(text, rf"(?:^(?:FY)?\s*{_QUOTE}?|[QH]{_QUOTE}?)(\d{{2}})(?!\d)", 1).try_cast("int")
    return F.coalesce(four, two + 2000)


def periods(text: Column, as_of: Column) -> Column:
    """Array of the periods that a text claims, in order: start and end in the text, label, year, kind, n, cumulative, relative, shifted.

    as_of: struct (year, quarter). Bases of comparison are no claims. "Same period of last
    year" is a year before the nearest named period, or before as_of's quarter. A quarter or
    half without year takes the year of the period before it, else as_of's; where it would
    end after as_of it is the one of the year before, and shifted. Positions count
    characters. Null text has none.
    """
    return held(stretches(text), lambda ps: resolved(ps, as_of))


def resolved(found: Column, as_of: Column) -> Column:
    """The periods of a text's stretches."""
    moved = lambda year, quarter, by: (year * 4 + quarter - 1 + by)

    def all_of(ps):
        of = lambda s: held(_part(s["text"], _year(s["text"])), lambda p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p["year"].alias("year"), p["kind"].alias("kind"), p["n"].alias("n"), p["cumulative"].alias("cumulative")))
        # Only "same period of last year" looks at the named ones.
        named = F.when(F.exists(ps, lambda s: s["kind"] == "same"), F.transform(F.filter(ps, lambda s: (s["kind"] == "named") & ~s["base"]), of)).otherwise(F.array().cast(f"array<{_NAMED}>"))

        def walk(named):
            def one(s, before):
                word = F.regexp_replace(s["text"], r"\s+", "")
                away = lambda table: F.coalesce(*(F.when(word.startswith(w.replace(" ", "")), F.lit(n)) for w, n in sorted(table.items(), key=lambda x: -len(x[0]))))
                made = lambda year, kind, n, cumulative, shifted=F.lit(False): F.struct(year.cast("int").alias("year"), kind.alias("kind"), n.cast("int").alias("n"), cumulative.alias("cumulative"), shifted.alias("shifted"))
                plain = lambda part: held(part, lambda x: made(x["year"], x["kind"], x["n"], x["cumulative"]))
                nearest = F.element_at(F.array_sort(F.transform(named, lambda x: F.struct(F.abs(x["start"] - s["start"]).alias("far"), x.alias("p")))), 1)["p"]
                now = made(as_of["year"] - 1, F.lit("quarter"), as_of["quarter"], F.lit(False))
                same = F.when(F.size(named) > 0, held(nearest, lambda x: made(x["year"] - 1, x["kind"], x["n"], x["cumulative"]))).otherwise(now)
                quarter = held(moved(as_of["year"], as_of["quarter"], away(QUARTERS_AWAY)), lambda at: made(F.floor(at / 4), F.lit("quarter"), at % 4 + 1, F.lit(False)))
                alone = before.isNull()
                late = lambda x: alone & (moved(x["year"], last_quarter(x["kind"], x["n"]), 0) > moved(as_of["year"], as_of["quarter"], 0))
                bare_one = held(_part(s["text"], F.coalesce(before, as_of["year"])), lambda x: held(late(x), lambda l: made(x["year"] - l.cast("int"), x["kind"], x["n"], x["cumulative"], l)))
                p = F.when(s["kind"] == "named", plain(_part(s["text"], _year(s["text"])))).when(s["kind"] == "same", same).when(s["kind"] == "year", plain(_part(F.regexp_replace(s["text"], f"^(?:{_words(YEARS_AWAY)})", ""), as_of["year"] + away(YEARS_AWAY)))).when(s["kind"] == "quarter", quarter).otherwise(bare_one)
                relative = s["kind"].isin("year", "quarter") | ((s["kind"] == "same") & (F.size(named) == 0)) | ((s["kind"] == "bare") & alone)
                return held(p, lambda p: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(p["year"], p["kind"], p["n"]).alias("label"), p["year"].alias("year"), p["kind"].alias("kind"), p["n"].alias("n"), p["cumulative"].alias("cumulative"), relative.alias("relative"), p["shifted"].alias("shifted")))

            def step(acc, s):
                return held(one(s, acc["year"]), lambda p: F.struct(p["year"].alias("year"), F.concat(acc["out"], F.array(p)).alias("out")))

            start = F.struct(F.lit(None).cast("int").alias("year"), F.array().cast(f"array<{PERIOD}>").alias("out"))
            return F.aggregate(F.filter(ps, lambda s: ~s["base"]), start, step, lambda acc: acc["out"])

        return held(named, walk)

    return all_of(found)


def without_periods(text: Column) -> Column:
    """A text with its periods and bases of comparison blanked, so that the numbers left are amounts."""
    out = F.translate(text, _MARK, " ")
    for pattern in KINDS.values():
        out = F.regexp_replace(out, f"(?:{pattern})", " ")
    return out
