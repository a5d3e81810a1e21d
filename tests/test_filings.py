"""Filings and sentences: pieces, tables, passages, forms, periods, companies and claims, by cases worked out by hand."""

from datetime import date
from decimal import Decimal

import compare
import pytest
from pyspark.sql import functions as F

from tidewell import catalog, plans
from tidewell.operators import claims, companies, filings, forms, markup, passages, periods, subjects

assert plans


def now():
    return periods.as_of_label(F.lit("2026H1"))


def filed(spark, xml):
    return spark.createDataFrame([(1, xml)], "doc_id long, xml string")


def rows_of(spark, xml):
    found = passages.lines(markup.pieces(filed(spark, xml)))
    return [(r.kind, r.text) for r in found.orderBy("pos", "row").collect()]


def test_rows_carry_what_stands_above_them(spark):
    body = "<P>Intro.</P><P>(단위: 억원)</P><TABLE><TR><TH></TH><TH>2024</TH></TR><TR><TD>a<TD>1</TR><TR><TD>b</TD></TR></TABLE><TITLE>Two</TITLE><TABLE><TR><TD>just one</TD><TD>row</TD></TR></TABLE><TABLE><TR><TD>Sales</TD><TD>(단위 : 원)</TD></TR></TABLE><TABLE><TR><TH>k</TH><TH>m</TH></TR><TR><TD>7</TD><TD>8</TD></TR></TABLE>"
    assert rows_of(spark, body) == [("para", "Intro."), ("row", "[표, 단위 억원] a | 2024: 1"), ("row", "[표, 단위 억원] b"), ("title", "Two"), ("para", "just one | row"), ("row", "[Two 표, Sales, 단위 원] k: 7 | m: 8")]


def test_headers_of_two_rows_sub_headings_and_period_rows(spark):
    body = (
        "<TITLE>Sum</TITLE><P>가. Whole &amp; half</P><P>(단위 : 원)</P><TABLE><TR><TH>item</TH><TH>제9기</TH><TH>제8기</TH></TR><TR><TD></TD><TD>6월말</TD><TD>12월말</TD></TR><TR><TD>Assets</TD><TD>5</TD><TD>4</TD></TR>"
        "<TR><TD></TD><TD>1~6월</TD><TD></TD></TR><TR><TD>Sales</TD><TD>3</TD><TD>2</TD></TR></TABLE><P>나. A paragraph that goes on and so ends the heading that was before it, all in all.</P>"
        "<TABLE><TR><TD>Income</TD></TR><TR><TD>제 9 기 2026.01.01 부터 2026.06.30 까지</TD></TR><TR><TD>(단위 : 천원)</TD></TR></TABLE>"
        "<TABLE><THEAD><TR><TH ROWSPAN=2>item</TH><TH COLSPAN=2>제 9 기</TH></TR><TR><TH>3개월</TH><TH>누적</TH></TR></THEAD><TR><TD ROWSPAN=2>Sales</TD><TD>1</TD><TD>2</TD></TR><TR><TD>3</TD><TD>4</TD></TR></TABLE>"
        "<TABLE><TR><TD>※ a remark</TD></TR><TR><TD>on two lines</TD></TR></TABLE>"
    )
    quarter, half = "제 9 기 3개월(2026.04.01~2026.06.30)", "제 9 기 누적(2026.01.01~2026.06.30)"
    assert rows_of(spark, body) == [
        ("title", "Sum"), ("title", "Sum > 가. Whole & half"), ("row", "[Sum > 가. Whole & half 표, 단위 원] item: Assets | 제9기(6월말): 5 | 제8기(12월말): 4"), ("row", "[Sum > 가. Whole & half 표, 단위 원] item: Sales | 제9기(1~6월): 3 | 제8기: 2"),
        ("para", "나. A paragraph that goes on and so ends the heading that was before it, all in all."),
        ("row", f"[Sum 표, Income, 단위 천원] item: Sales | {quarter}: 1 | {half}: 2"), ("row", f"[Sum 표, Income, 단위 천원] item: Sales | {quarter}: 3 | {half}: 4"), ("para", "※ a remark"), ("para", "on two lines"),
    ]


def test_passages_end_at_titles_and_at_their_length(spark):
    found = spark.createDataFrame(
        [(1, 0, "title", "T", "T"), (1, 1, "para", "T", "One. Two two."), (1, 2, "row", "T", "[x] r"), (1, 3, "title", "U", "U"), (1, 4, "para", "U", "z")], "doc_id long, pos int, kind string, title string, text string"
    ).withColumn("row", F.lit(0))
    assert [r.text for r in passages.packed(found, 12).orderBy("idx").collect()] == ["[T] One.", "[T] Two two.", "[x] r", "[U] z"]
    whole = "다" * 700 + "."
    alone = spark.createDataFrame([(1, 0, 0, "para", "", whole)], "doc_id long, pos int, row int, kind string, title string, text string")
    assert [r.text for r in passages.packed(alone).collect()] == [whole]


def test_sections_need_no_end_and_notes_go(spark):
    xml = "<SECTION-1><TITLE>Ⅰ. One</TITLE><P>a</P><SECTION-1><TITLE> III. 재무 사항</TITLE><SECTION-2><TITLE>1. Sums</TITLE><P>b &lt; c</P><SECTION-2><TITLE>2. 주석</TITLE><P>note</P>"
    text = lambda *a, **k: [r.text for r in passages.filing_passages(filed(spark, xml), *a, **k).orderBy("idx").collect()]
    assert text("I.One") == ["[Ⅰ. One] a"]
    assert text("III.재무사항", without=("주석",)) == ["[1. Sums] b < c"]
    assert text("2.주석") == ["[2. 주석] note"] and text("IV.None") == []
    assert passages.filing_passages(filed(spark, None), "I.One").collect() == []


def test_spans_end_with_the_table(spark):
    assert filings.grid("<TABLE><TR><TD ROWSPAN=5>a</TD><TD>b &amp; c</TD></TR></TABLE>") == [["a", "b & c"]]
    assert filings.grid("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>") == [["a", "a", "b"], ["a", "a", "c"]]
    cells = filings.table_cells(filed(spark, "<TABLE><TR><TH>k</TH><TH>2025</TH><TH>2024</TH></TR><TR><TD>Revenue</TD><TD>10</TD><TD>9</TD></TR></TABLE>"))
    assert filings.labelled_rows(cells).first().text == "Revenue: 2025 10; 2024 9"


def test_forms_of_both_layouts(spark):
    old = (
        "<table><tr><td>(단위 : 억원, %)</td></tr><tr><td rowspan=2>구분</td><td>당기실적</td><td>전기실적</td><td rowspan=2>전기대비증감율(%)</td><td>전년동기실적</td><td rowspan=2>전년동기대비증감율(%)</td></tr>"
        "<tr><td>(2023년 3분기)</td><td>(2023년 2분기)</td><td>('22.3Q)</td></tr><tr><td>영업이익</td><td>당해실적</td><td>-1,791.5</td><td>-2,882</td><td>37.8</td><td>1,660</td><td>적자전환</td></tr></table>"
    )
    r = forms.preliminary(filed(spark, old)).first()
    assert (r.current, r.prior_change, r.year_change, r.year_turn, r.first, r.last) == (Decimal("-1791.5"), Decimal("37.8"), None, "적자전환", date(2023, 7, 1), date(2023, 9, 30))
    assert r.amount == -179_150_000_000 and r.rounding_unit == 10_000_000 and not r.is_correction and r.original_day is None
    spans = {x.name: (x.first, x.last) for x in forms.spans(forms.form_rows(filed(spark, old))).collect()}
    assert spans["당기누계실적"] == (date(2023, 1, 1), date(2023, 9, 30)) and spans["전년동기실적"] == (date(2022, 7, 1), date(2022, 9, 30))
    assert forms.preliminary(filed(spark, old.replace("억원", "달러"))).collect() == [] and forms.preliminary(filed(spark, "<p>x")).collect() == []


@pytest.mark.parametrize(
    ("said", "wanted"),
    [
        ("올해 상반기 값", ["2026H1"]), ("금년 1분기와 재작년", ["2026Q1", "2024"]), ("작년 3분기 이익", ["2025Q3"]), ("최근 분기와 직전 분기", ["2026Q2", "2026Q1"]), ("해당 분기", []), ("3분기 매출", ["2025Q3"]), ("하반기 값", ["2025H2"]),
        ("2024년 상반기와 하반기", ["2024H1", "2024H2"]), ("지난해에는 2024년 3분기가 좋았다", ["2025", "2024Q3"]), ("전년 대비 3% 늘었다", []), ("2분기는 전년 동기 대비 늘었다", ["2026Q2"]), ("2024년보다 2025년에", ["2025"]), ("작년 4분기에 비해", []),
        ("2024년 3분기는 8조, 전년 동기는 7조", ["2024Q3", "2023Q3"]), ("전년 동기 매출", ["2025Q2"]), ("2024Q2의 값, 2023 Q3", ["2024Q2", "2023Q3"]), ("3Q25 2H24 '23.1Q FY22 '21년 20년 1분기", ["2025Q3", "2024H2", "2023Q1", "2022", "2021", "2020Q1"]),
        ("2025년 1~3분기", ["2025Q3"]), ("2025년 9월 말과 2025년 5월", ["2025Q3", "2025"]), ("2026H3 12.5Q 매출2Q", []), ("2001Q2 2002H1", ["2001Q2", "2002H1"]), ("", []), (None, []),
    ],
)
def test_periods(spark, said, wanted):
    found = spark.createDataFrame([(said,)], "t string").select(periods.periods(F.col("t"), now()).alias("p")).first().p
    assert [p.label for p in found] == wanted
    assert all(said[p.start : p.end].strip() for p in found)


def test_what_periods_tell(spark):
    said = [("3분기",), ("2분기",), ("2025년 3분기 누적",), ("1분기 누적",), ("작년",), ("25.3Q 누계",)]
    found = [r.p[0] for r in spark.createDataFrame(said, "t string").coalesce(1).select(periods.periods(F.col("t"), now()).alias("p")).collect()]
    assert [p.shifted for p in found] == [True, False, False, False, False, False]
    assert [p.cumulative for p in found] == [False, False, True, False, False, True]
    assert [p.relative for p in found] == [True, True, False, True, True, False]


NAMES = [("삼성전자", 1, False), ("SK하이닉스", 2, False), ("SK", 3, False), ("나노", 4, True), ("Hanbit Materials Co., Ltd.", 5, False), ("A", 6, False)]


@pytest.mark.parametrize(
    ("said", "own", "found", "other"),
    [
        ("SK하이닉스와 SK의 실적", 1, [2, 3], "SK하이닉스"), ("SKC와 삼성의 실적", 1, [], None), ("삼성전자는 SK하이닉스보다 크다.", 1, [1, 2], None), ("SK하이닉스는 삼성전자 대비 크다.", 1, [2, 1], "SK하이닉스"),
        ("나노 공정이 어렵다", 1, [], None), ("㈜나노가 크다", 1, [4], "나노"), ("나노(주)가 크다", 1, [4], "나노"), ("나노가 크다", 4, [4], None), ("ｓｋ 하이닉스의 값", 2, [2], None), ("hanbit materials가 샀다", 1, [5], "Hanbit Materials Co., Ltd."), ("A는 크다", 1, [], None), (None, 1, [], None),
    ],
)
def test_company_mentions(spark, said, own, found, other):
    names = spark.createDataFrame(NAMES, "name string, company int, common boolean")
    texts = spark.createDataFrame([(7, said, own)], "id long, text string, company int")
    got = companies.mentions(texts, names, "id")
    assert [r.company for r in got.orderBy("at").collect()] == found
    about = companies.subjects(got, "id").first()
    assert (about.other if about else None) == other


def test_contained_names(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "aaa b ring"), (2, None), (3, "")], "id long, text string")
    names = spark.createDataFrame([("a",), ("aa",), ("ring",), ("in",), ("",), ("ring",)], "name string")
    want = {(1, "a", 3), (1, "aa", 1), (1, "ring", 1), (1, "in", 1)}
    assert {tuple(r) for r in companies.contained(texts, "id", names).collect()} == want
    monkeypatch.setattr(companies, "MOST_NAMES", 1)
    assert {tuple(r) for r in companies.contained(texts, "id", names).collect()} == want


@pytest.mark.parametrize(
    ("claim", "passage", "valid"),
    [
        ("㈜한빛소재와 거래한다.", "한빛소재(주)와 거래", True), ("한빛소재 주식회사와 거래", "주식회사 한빛소재는 크다", True), ("SYSTEM과 거래", "그 System은 크다", True), ("SYSTEM과 거래", "Systems는 크다", False),
        ("'고려제강'과 거래", "고려 제강은 크다", True), ("주식회사 삼성과 거래", "삼성전자와 거래", False), ("'FNC'를 산다", "에프엔씨(이하 'FNC')를 판다", True), ("값이 올랐다.", "다른 글", True), ("OWN은 늘었다", "당사는 늘었다", True), ("INCHEON 공장", "Incheon 공장", True),
    ],
)
def test_subject_of_passages(spark, claim, passage, valid):
    df = spark.createDataFrame([(claim, passage)], "c string, p string")
    names = subjects.claimed_names(F.col("c"), F.array(F.lit("Own Co., Ltd.")))
    assert df.select(subjects.subject_valid(names, F.col("p"), subjects.aliases(F.array("p"))).alias("v")).first().v is valid


@pytest.mark.parametrize(("claim", "names"), [("대우는 Ace를 샀다.", ["대우", "Ace"]), ("당사는 제품을 생산하는", []), ("㈜한빛이며 “새 이름”과", ["새 이름", "한빛"]), ("매출이 늘었다", []), (None, [])])
def test_name_candidates(spark, claim, names):
    got = spark.createDataFrame([(claim,)], "c string").select(subjects.name_candidates(F.col("c"), F.lit("")).alias("n")).first().n
    assert sorted(got) == sorted(names)
    assert spark.range(1).select(subjects.has_name(F.lit("삼성전자와"), F.lit("삼성전자")).alias("a"), subjects.has_name(F.lit("삼성전자와"), F.lit("삼성")).alias("b"), subjects.has_name(F.lit("x (c)."), F.lit("(c).")).alias("c")).first() == (True, False, True)


@pytest.mark.parametrize(
    ("said", "wanted"),
    [
        ("2025년 2분기 매출은 전 분기 3조원에서 5조원으로 늘었다.", [("2025Q1", 3), ("2025Q2", 5)]), ("2025년 2분기 매출은 전년 동기 3조원에서 5조원으로", [("2024Q2", 3), ("2025Q2", 5)]), ("2025년 매출은 전년 3조원에서 5조원으로", [("2024", 3), ("2025", 5)]),
        ("2025년 2분기 매출은 전년 3조원에서 5조원으로", [(None, 3), ("2025Q2", 5)]), ("2025년 2분기 매출은 3조원에서 5조원으로", [("2025Q2", 5)]), ("2025년 2분기 매출은 전 분기 3조원에서 2025년 3분기 5조원으로", [("2025Q3", 5)]),
        ("2024년과 2025년 매출은 각각 3조원, 5조원", [("2024", 3), ("2025", 5)]), ("매출은 2025년 3조원, 2024년 5조원", [("2025", 3)]), ("매출은 3조원", [(None, 3)]), ("2025년 매출, 2024년 영업이익은 5조원", [("2024", 5)]),
    ],
)
def test_periods_of_claims(spark, said, wanted):
    p = F.col("x.period")
    each = spark.createDataFrame([(said,)], "t string").select(F.posexplode(claims.dated_claims(F.col("t"), now())).alias("i", "x"))
    got = each.orderBy("i").select(periods.label(p["year"].cast("string"), p["kind"], p["n"].cast("string")).alias("l"), F.col("x.value").alias("v")).collect()
    assert [(r.l, r.v / 10**12) for r in got] == wanted


def test_base_periods(spark):
    cases = [
        ((2026, "quarter", 1, False), "prev_q", "2025Q4"), ((2026, "quarter", 2, False), "prev", "2026Q1"), ((2026, "half", 1, False), "prev", "2025H2"), ((2025, "year", 0, False), "prev_y", "2024"), ((2026, "half", 1, False), "yoy", "2025H1"),
        ((2026, "quarter", 2, False), "prev_y", None), ((2026, "half", 1, False), "prev_q", None), ((2025, "quarter", 3, True), "prev_q", None), ((2025, "quarter", 3, True), "yoy", "2024Q3"),
    ]
    df = spark.createDataFrame([(p, k, i) for i, (p, k, _) in enumerate(cases)], "p struct<year:int,kind:string,n:int,cumulative:boolean>, k string, i int").withColumn("b", claims.base_period(F.col("p"), F.col("k")))
    got = df.orderBy("i").select(periods.label(F.col("b.year").cast("string"), F.col("b.kind"), F.col("b.n").cast("string")).alias("l")).collect()
    assert [r.l for r in got] == [x[2] for x in cases]


def test_evaluated_claims(spark):
    """Any final fact may match, superseded ones never; several accounts must all be known; one statement for a sentence."""
    fact = lambda account, statement, amount, final=True, current=True, gone=False: (1, account, statement, date(2025, 1, 1), date(2025, 12, 31), Decimal(amount), 1, final, current, "f", False, gone)
    schema = "company int, account string, statement string, first date, last date, amount decimal(28,0), rounding_unit int, final boolean, current boolean, filed string, corrected boolean, superseded boolean"
    claim = lambda key, idx, account, value: (key, idx, 1, account, Decimal(value), Decimal(1), False, date(2025, 1, 1), date(2025, 12, 31))
    kinds = "key string, idx int, company int, account string, value decimal(38,6), step decimal(38,6), approximate boolean, first date, last date"
    rows = [fact("revenue", "CFS", 100), fact("revenue", "CFS", 110, current=False), fact("revenue", "CFS", 999, gone=True), fact("revenue", "CFS", 777, final=False), fact("revenue", "OFS", 60), fact("operating_income", "OFS", 7), fact("operating_income", "CFS", 9), fact("net_income", "CFS", 5)]
    said = [claim("a", 0, "revenue", 100), claim("b", 0, "revenue", 110), claim("c", 0, "revenue", 777), claim("d", 0, "revenue", 60), claim("d", 1, "operating_income", 7), claim("e", 0, "revenue", 60), claim("e", 1, "operating_income", 9), claim("f", 0, "net_income", 4), claim("g", 0, "net_income", 5), claim("h", 0, "other", 5)]
    out = {(r.key, r.idx): (r.status, r.statement, r.note) for r in claims.evaluated(spark.createDataFrame(said, kinds), spark.createDataFrame(rows, schema), "key").collect()}
    assert out == {
        ("a", 0): ("match", "CFS", "restated_exists"), ("b", 0): ("match", "CFS", "restated"), ("c", 0): ("mismatch", "CFS", "restated_exists"), ("d", 0): ("match", "OFS", "separate_only"), ("d", 1): ("match", "OFS", "separate_only"),
        ("e", 0): ("mismatch", "CFS", "restated_exists"), ("e", 1): ("match", "CFS", None), ("f", 0): ("unknown", "CFS", "candidate_missing"), ("g", 0): ("match", "CFS", None), ("h", 0): ("unknown", None, None),
    }


def test_filings_of_one_partition_are_read_by_many_tasks(spark):
    docs = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("<P>a</P>").alias("xml"))
    assert markup.pieces(docs).select(F.spark_partition_id()).distinct().count() > 1


def test_forms_are_read_once(spark):
    docs = filed(spark, "<TABLE><TR><TD>a</TD></TR></TABLE>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(forms.corrections(forms.form_rows(docs))).count("MapIn") == 1
    assert plan(forms.preliminary(docs)).count("MapIn") == 0


def test_pieces_are_read_once_for_their_lines(spark):
    found = passages.lines(markup.pieces(filed(spark, "<P>a</P>")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 0


@pytest.mark.parametrize("name", ["tx02_flat_blocks", "fc01_report_sections"])
def test_documents_without_text_stay(spark, tmp_path, name):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "가. a\n\nb & <c>"), (4, "\n")], "doc_id long, text string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    said = compare.difference(spark, compare.views(str(tmp_path)), catalog.QUERIES[name], catalog.ORACLE_SQL[name], str(tmp_path))
    assert said is None


def test_words_at_which_no_name_begins_are_not_looked_up(spark):
    """Two plain first characters decide; what keys leave out (marks, suffixes, blanks, dots) keeps a word in."""
    known = companies.dictionary(spark.createDataFrame([("Apex Tool", 1), ("삼성전자", 2), ("Co. Foo", 3)], "name string, company int"))
    words = ["apex", "ARROW", "삼성전자는", "삼일은", "2분기", "co.", "주식회사", "A", "C-Com", "매출은"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    kept = {r.word for r in companies._promising(df, F.upper("word"), known).collect()}
    assert kept == {"apex", "삼성전자는", "co.", "주식회사", "A", "C-Com"}


def test_mentions_after_marks_and_suffixes(spark):
    """Names whose first characters keys leave out are found as before."""
    names = spark.createDataFrame([("Foo Works", 1), ("삼성전자", 2), ("A. Bee", 3)], "name string, company int")
    texts = spark.createDataFrame([(1, "Co. Foo Works는 좋다"), (2, "㈜삼성전자와 주식회사 삼성전자"), (3, "A Bee의 값")], "k int, text string")
    found = companies.mentions(texts, names, "k").select("k", "company").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1), (2, 2), (2, 2), (3, 3)]
