"""What a sentence claims: whether it is checked, which amounts it gives for which periods, and how filed facts agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import periods as P
from .factcheck import _ACCOUNT, _MONEY, _SHARE, ACCOUNTS, period_end, period_start, same_amount
from .lineage import cut
from .text import held, no_claim, parse_numbers

c = F.col

# Words of shares, margins, growth, markets, forecasts and opinions; accounts whose growth is filed with preliminary results.
SHARES = r"\d[\d,]*(?:\.\d+)?\s*(%p|%포인트|%|퍼센트)"
MARGINS = ("영업 이익률", "이익률", "마진율")
MARGIN_SIGN = r"(?<![A-Za-z])OPM(?![A-Za-z])"
GROWTH = (
    "YoY", "QoQ", "전년 동기 대비", "전년 대비", "전분기 대비", "전 분기 대비", "전기 대비", "직전 분기 대비", "증가율", "감소율", "증감률", "증감율", "성장률", "성장", "증가", "감소", "늘", "줄", "급증", "급감", "상승", "하락",
)
MARKET = ("목표 주가", "목표가", "주가", "시가 총액", "시총", "EV/EBITDA", "투자 의견", "컨센서스", "밸류에이션", "배당 수익률", "매수 의견", "매도 의견")
MARKET_SIGNS = r"P[EB]R(?![A-Za-z])"
FORECAST = ("예상", "전망", "추정", "예정", "관측", "목표", "것으로 보", "할 것", "될 것", "넘을 것", "기대")
OPINION = (
    "것으로 보", "것이라", "것이다", "판단한다", "판단된다", "생각한다", "본다", "보인다", "예상", "전망", "기대", "추정", "우려", "가능성", "여지", "할 수 있", "듯하", "같다", "바람직", "필요하다", "해야",
)
PRELIMINARY_GROWTH = r"매출|영업\s*이익(?!\s*률)"
LIST_LEAD = r"(?:정리|요약|살펴보)\S*면\s+(?:다음|아래)(?:\s*표)?\s*(?:와|과)\s*같(?:다|습니다|음|이)"
HEADER_KINDS = r"(?:리뷰|점검|분석|프리뷰|코멘트|요약|정리|(?<![A-Za-z])(?i:review|preview|comment|update))$"
HEADER_CUT, STOCK_CODE = r"\s*[:：—–]\s*", r"\(\s*\d{6}\s*\)"
INTRO = r"^\s*(?:다음은|아래는)\s.*(?:메모|초안|정리|답변|요약)(?:이다|입니다|다)\s*[.!]?\s*$"
SAME_PERIOD = r"(?<![가-힣])(?:(?:같은|해당)\s*(?:분기|기간|해(?:(?![가-힣])|(?=[에의는도가]))|연도|반기|회계\s*연도)|당\s*분기|이번\s*분기|동\s*분기|동\s*기간)"
#: Years after a period in whose reports it may be compared, months back without a period, characters of a header line.
HORIZON, RECENT, HEADER_LENGTH = 2, 12, 40
#: Accounts that a claimed word may stand for; all must be known before a difference counts.
CANDIDATES = {"net_income": ("net_income", "net_income_owners")}
#: Words before the first of two amounts that name the period it is of, from the second one's.
BASE_WORDS = {"yoy": ("전년 동기", "작년 동기"), "prev_q": ("직전 분기", "전 분기", "지난 분기"), "prev_y": ("전년도", "전년", "작년", "지난해")}
SILENT = "은 는 이 가 의 을 를 도 로 으로 에서 이다 였다 이었다 입니다 였습니다 이었습니다 기록했다 기록하였다 기록했습니다 집계됐다 그리고 및 약".split()
STATEMENT_WORDS = "연결|별도|개별"
_LETTERS = "abcdefghij"


def _has(text: Column, words) -> Column:
    return text.rlike(P._words(words))


def derived_kind(text: Column) -> Column:
    """What a share in a text measures: growth, margin or other; null without a share."""
    shares = F.regexp_extract_all(text, F.lit(SHARES), F.lit(1))
    points = F.exists(shares, lambda u: u.isin("%p", "%포인트"))
    margin = _has(text, MARGINS) | text.rlike(MARGIN_SIGN)
    return F.when(F.size(shares) == 0, None).when(points, "other").when(margin, "margin").when(_has(text, GROWTH), "growth").otherwise("other")


def has_amount(text: Column) -> Column:
    """Digits are left without periods and stock codes."""
    return F.regexp_replace(P.without_periods(text), STOCK_CODE, " ").rlike(r"\d")


def line_kind(text: Column, named: Column) -> Column:
    """lead, intro or header of a line that opens others; null for sentences. named: a company or period stands in it.

    A header ends in a word for reports, at a colon or a dash or at the end of a short line.
    """
    parts = F.split(F.trim(text), HEADER_CUT, 2)
    head = F.trim(parts[0])
    # Amounts are looked for last: that blanks all periods first.
    header = head.rlike(HEADER_KINDS) & named & ((F.size(parts) == 2) | (F.length(head) <= HEADER_LENGTH)) & ~has_amount(text)
    return F.when(~text.rlike(r"\d") & text.rlike(LIST_LEAD), "lead").when(text.rlike(INTRO) & ~has_amount(text), "intro").when(header, "header")


def triage(text: Column, company: Column, period: Column) -> Column:
    """Struct (check, reason) of a sentence by rules; company and period: whether one is named."""
    made = lambda check, why: F.struct(F.lit(check).alias("check"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    why, kind = no_claim(text), line_kind(text, company | period)
    return (
        F.when(why.isNotNull(), made(False, F.concat(F.lit("not_claim:"), why))).when(kind.isin("lead", "intro"), made(False, "not_claim:lead")).when(kind == "header", made(False, "not_claim:header"))
        .when(text.rlike(r"\d"), made(True, "number")).when(company, made(True, "company")).when(period, made(True, "period")).when(_market(text), made(False, "market")).when(_has(text, OPINION), made(False, "opinion")).otherwise(made(False, "no_fact"))
    )


def _market(text: Column) -> Column:
    return _has(text, MARKET) | text.rlike(MARKET_SIGNS)


def _ends_after(year: Column, kind: Column, n: Column, as_of: Column) -> Column:
    return year * 4 + P.last_quarter(kind, n) > as_of["year"] * 4 + as_of["quarter"]


def scope(text: Column, other: Column, periods: Column, as_of: Column) -> Column:
    """Struct (category, reason) of a checked sentence: the first of other company, market, forecast, future period, derived value.

    other: name of another company that is its subject, or null. Growth of accounts that
    preliminary results list, and margins, are checked.
    """
    made = lambda category, why: F.struct(F.lit(category).alias("category"), (F.lit(why).cast("string") if why is None or isinstance(why, str) else why).alias("reason"))
    kind = derived_kind(text)
    future = F.exists(periods, lambda p: _ends_after(p["year"], p["kind"], p["n"], as_of))
    return (
        F.when(other.isNotNull(), made("other_company", F.concat(F.lit("other_company:"), other))).when(_market(text), made("out_of_scope", "market")).when(_has(text, FORECAST), made("out_of_scope", "forecast")).when(future, made("out_of_scope", "future_period"))
        .when((kind == "growth") & text.rlike(PRELIMINARY_GROWTH), made("checked", "derived:growth")).when(kind == "growth", made("derived", "derived:growth_unsupported")).when(kind == "margin", made("checked", "derived:margin"))
        .when(kind == "other", made("derived", "derived:other")).otherwise(made("checked", None))
    )


def search_periods(periods: Column, as_of: Column) -> Column:
    """Labels of the reports in which the periods may be found, by their ends: from a period's end to HORIZON years later;
    without periods, those that end within RECENT months before as_of's end."""
    quarter = lambda year, q: F.last_day(F.make_date(year, 3 * q, F.lit(1)))
    spans = F.transform(periods, lambda p: F.struct(quarter(p["year"], P.last_quarter(p["kind"], p["n"])).alias("low"), F.last_day(F.add_months(quarter(p["year"], P.last_quarter(p["kind"], p["n"])), 12 * HORIZON)).alias("high")))
    now = quarter(as_of["year"], as_of["quarter"])
    recent = F.array(F.struct(F.date_add(F.last_day(F.add_months(now, -RECENT)), 1).alias("low"), now.alias("high")))

    def reports(span):
        def of(y):
            one = lambda kind, n: F.struct(quarter(y, P.last_quarter(F.lit(kind), F.lit(n))).alias("end"), P.label(y.cast("string"), F.lit(kind), F.lit(n).cast("string")).alias("label"))
            return F.array(*(one("quarter", n) for n in range(1, 5)), one("half", 1), one("year", 0))

        return F.filter(F.flatten(F.transform(F.sequence(F.year(span["low"]), F.year(span["high"])), of)), lambda x: x["end"].between(span["low"], span["high"]))

    wanted = held(F.when(F.size(periods) > 0, spans).otherwise(recent), lambda ss: F.flatten(F.transform(ss, reports)))
    return F.transform(F.array_sort(F.array_distinct(wanted)), lambda x: x["label"])


def relative_only(text: Column, periods: Column) -> Column:
    """The text names its period only by "the same quarter" and the like."""
    return (F.size(periods) == 0) & text.rlike(SAME_PERIOD)


def inherited(sentences: DataFrame, key: str, order: str) -> DataFrame:
    """sentences with period (struct or null) and company_note, taken over from the sentences before.

    sentences: key, order, text, periods, own (its company), subjects (array of companies
    in its subject) and anchor (whether these set the context: a number or a topic).
    A period comes from the nearest sentence before that has one, if it has one only, not
    shifted, of the unit that the text asks for. Without a subject the nearest anchor
    decides: another company alone is `other`, own and others together `ambiguous`.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    plain = F.array_distinct(F.transform("periods", lambda p: F.struct(p["label"].alias("label"), p["kind"].alias("kind"), p["cumulative"].alias("cumulative"))))
    one = F.struct((F.size(plain) == 1).alias("single"), F.exists("periods", lambda p: p["shifted"]).alias("shifted"), F.get(plain, F.lit(0)).alias("p"))
    near = F.last(F.when(F.size("periods") > 0, one), ignorenulls=True).over(before)
    words = F.regexp_extract_all("text", F.lit(SAME_PERIOD), F.lit(0))

    def accepts(word, p):
        return (
            F.when(word.contains("분기"), (p["kind"] == "quarter") & ~p["cumulative"]).when(word.contains("반기"), p["kind"] == "half")
            .when(word.contains("기간"), F.lit(True)).otherwise(p["kind"] == "year")
        )

    fits = c("_near.single") & ~c("_near.shifted") & F.forall(words, lambda w: accepts(w, c("_near.p")))
    anchors = F.last(F.when(c("anchor") & (F.size("subjects") > 0), c("subjects")), ignorenulls=True).over(before)
    df = sentences.withColumns({"_near": near, "_anchor": anchors})
    others = F.filter("_anchor", lambda x: x != c("own"))
    note = F.when((F.size("subjects") > 0) | c("_anchor").isNull() | (F.size(others) == 0), None).when(F.array_contains("_anchor", c("own")), "ambiguous").otherwise("other")
    return df.withColumns({"period": F.when(relative_only(c("text"), c("periods")) & fits, c("_near.p")), "company_note": note}).drop("_near", "_anchor")


def _marked(clean: Column, stretches: Column) -> Column:
    """The text with each period as a token of its number and, for words that are a base of comparison, its kind; bases with a word of comparison are blanked."""

    def build(ss):
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("out"))

        def kind(s):
            found = None
            for k, words in BASE_WORDS.items():
                test = s["text"].rlike(f"^(?:{P._words(words)})$")
                found = F.when(test, k) if found is None else found.when(test, k)
            return F.coalesce(found, F.lit(""))

        def step(acc, s):
            token = F.when(s["base"], " ").otherwise(F.concat(F.lit("\x03"), F.translate(acc["i"].cast("string"), "0123456789", _LETTERS), F.when(kind(s) != "", F.concat(F.lit("z"), F.replace(kind(s), F.lit("_"), F.lit("")))).otherwise(""), F.lit("\x04")))
            return F.struct(s["end"].alias("at"), (acc["i"] + F.when(s["base"], 0).otherwise(1)).alias("i"), F.concat(acc["out"], F.substr(clean, acc["at"] + 1, s["start"] - acc["at"]), token).alias("out"))

        return F.aggregate(ss, start, step, lambda acc: F.concat(acc["out"], F.substr(clean, acc["at"] + 1)))

    return build(stretches)


_BASES = {"zyoy": "yoy", "zprevq": "prev_q", "zprevy": "prev_y"}
_TOKENS = r"\x03([a-j]+)(z[a-z]+)?\x04"


def dated_claims(text: Column, as_of: Column) -> Column:
    """Array of (account, value, step, approximate, period, base) of the amounts that a text gives for accounts and periods.

    period is the nearest one before the amount, or the only one; with "each", the one of
    the amount's place in the list. In `from A to B` after a base of comparison (the year
    before, the quarter before) A is of that base's period, reckoned from B's, which is
    the nearest one before the base; with a period between them, or without such a word,
    only B is claimed. period is null where none can be told. Losses are negative.
    """

    def read(ss, ps):
        parts = F.split(F.regexp_replace(_marked(clean, ss), f"({_ACCOUNT})", "\x01$1\x02"), "\x01")
        tokens = lambda s: F.regexp_extract_all(s, F.lit(_TOKENS), F.lit(0))
        phrase = "struct<account:string,phrase:string,rest:string,token:string,base:string>"
        none = F.array().cast(f"array<{phrase}>")

        def part(p):
            account, rest = F.split(p, "\x02")[0], F.split(p, "\x02")[1]
            margin = account.endswith("률")
            return F.struct(account.alias("account"), rest.alias("rest"), margin.alias("margin"), F.when(margin, F.regexp_extract_all(rest, F.lit(_SHARE), F.lit(0))).otherwise(F.regexp_extract_all(rest, F.lit(_MONEY), F.lit(0))).alias("values"))

        def step(acc, p):
            rest, values, n = p["rest"], p["values"], F.size(p["values"])
            made = lambda account, v, token, base=None: F.struct(account.alias("account"), v.alias("phrase"), rest.alias("rest"), token.alias("token"), F.lit(base).cast("string").alias("base") if base is None else base.alias("base"))
            upto = lambda v: F.substr(rest, F.lit(1), F.greatest(F.instr(rest, v) - 1, F.lit(0)))
            last = lambda ts: F.try_element_at(ts, F.lit(-1))
            nearest = lambda v: last(F.concat(acc["seen"], tokens(upto(v))))
            one, two = F.get(values, F.lit(0)), F.get(values, F.lit(1))
            before = upto(one)
            after = F.substr(rest, F.instr(rest, one) + F.length(one))
            between = F.substr(after, F.lit(1), F.greatest(F.instr(after, two) - 1, F.lit(0)))
            from_to = (n > 1) & after.rlike(r"^\s*(?:에서|→)")
            based = before.rlike(r"\x03[a-j]+z[a-z]+\x04\s*$") & (F.size(tokens(between)) == 0)
            earlier = F.concat(acc["seen"], tokens(before))
            anchor = last(F.slice(earlier, F.lit(1), F.greatest(F.size(earlier) - 1, F.lit(0))))
            kinds = F.create_map(*[F.lit(x) for kv in _BASES.items() for x in kv])
            kind = F.try_element_at(kinds, F.regexp_extract(last(earlier), _TOKENS, 2))
            single = (
                F.when((n > 1) & rest.contains("각각"), F.transform(values, lambda v, i: made(p["account"], v, F.get(acc["seen"], i))))
                .when(from_to & based, F.array(made(p["account"], one, anchor, kind), made(p["account"], two, anchor)))
                .when(from_to, F.array(made(p["account"], two, last(F.concat(earlier, tokens(between)))))).when(n > 0, F.array(made(p["account"], one, nearest(one)))).otherwise(none)
            )
            waiting = F.filter(acc["waiting"], lambda a: a.endswith("률") == p["margin"])
            group = F.concat(F.when(F.size(waiting) == F.size(acc["waiting"]), waiting).otherwise(F.array().cast("array<string>")), F.array(p["account"]))
            found = F.when(F.size(group) == 1, single).when(F.size(group) == n, F.zip_with(group, values, lambda a, v: made(a, v, nearest(v)))).otherwise(none)
            goes_on = (n == 0) & rest.rlike(r"^\s*(?:[와과,·]|및)?\s*$")
            return F.struct(F.when(goes_on, group).otherwise(F.array().cast("array<string>")).alias("waiting"), F.concat(acc["out"], found).alias("out"), F.concat(acc["seen"], tokens(rest)).alias("seen"))

        def value(x):
            at = F.instr(x["rest"], x["phrase"])
            before, after = F.substr(x["rest"], F.greatest(at - 6, F.lit(1)), F.least(at - 1, F.lit(6))), F.substr(x["rest"], at + F.length(x["phrase"]), F.lit(6))
            loss = x["account"].contains("손실") | x["phrase"].rlike("^[-△▲]") | after.rlike("손실|적자")
            account = F.element_at(F.create_map(*[F.lit(y) for kv in ACCOUNTS.items() for y in kv]), x["account"])
            number = F.translate(F.regexp_extract(x["token"], _TOKENS, 1), _LETTERS, "0123456789").try_cast("int")
            period = F.coalesce(F.get(ps, number), F.when(x["token"].isNull() & (F.size(ps) == 1) & x["base"].isNull(), F.get(ps, F.lit(0))))
            amount = lambda v: F.struct(account.alias("account"), F.when(loss, -v["value"]).otherwise(v["value"]).alias("value"), v["step"].alias("step"), (before.contains("약") | after.rlike(r"^\s*(?:가량|정도|안팎|여)")).alias("approximate"), F.when(x["base"].isNull(), _as_period(period)).otherwise(base_period(period, x["base"])).alias("period"), x["base"].alias("base"))
            return held(F.get(parse_numbers(x["phrase"]), F.lit(0)), amount)

        def walk(pieces):
            start = F.struct(F.array().cast("array<string>").alias("waiting"), none.alias("out"), tokens(F.get(pieces, F.lit(0))).alias("seen"))
            rows = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), part)
            return F.transform(F.aggregate(rows, start, step, lambda acc: acc["out"]), value)

        return held(parts, walk)

    clean = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03\x04", "    ")
    return held(P.stretches(clean), lambda ss: held(P.resolved(ss, as_of), lambda ps: read(ss, ps)))


def amount_claims(text: Column) -> Column:
    """Array of (account, value, approximate) of the amounts that a text gives for accounts; losses are negative.

    An account takes the first amount after it, up to the next account; two amounts where
    each is said, the second one of `from A to B`, or both after a base of comparison.
    Accounts that follow each other without amounts take the amounts after the last one in
    turn, if there are as many, else none. Margins take percentages.
    """
    no_day = F.struct(F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("quarter"))
    return F.transform(dated_claims(text, no_day), lambda x: F.struct(x["account"].alias("account"), x["value"].alias("value"), x["approximate"].alias("approximate")))


def _as_period(p: Column) -> Column:
    return F.when(p.isNotNull(), F.struct(p["year"].alias("year"), p["kind"].alias("kind"), p["n"].alias("n"), p["cumulative"].alias("cumulative")))


def base_period(p: Column, kind: Column) -> Column:
    """The period that a claim's period is compared with; null where the words leave it open.

    yoy: a year before. prev_q: the quarter before a quarter. prev_y: the year before a
    year. prev: the unit before. What is cumulative has only a year before.
    """
    made = lambda year, n: F.struct(year.cast("int").alias("year"), p["kind"].alias("kind"), n.cast("int").alias("n"), p["cumulative"].alias("cumulative"))
    units = F.when(p["kind"] == "half", 2).otherwise(4)
    back = made(F.when(p["n"] == 1, p["year"] - 1).otherwise(p["year"]), F.when(p["n"] == 1, units).otherwise(p["n"] - 1))
    return (
        F.when(kind == "yoy", made(p["year"] - 1, p["n"])).when(p["cumulative"], None).when(kind.isin("prev_q", "prev") & (p["kind"] == "quarter"), back)
        .when((kind == "prev") & (p["kind"] == "half"), back).when(kind.isin("prev_y", "prev") & (p["kind"] == "year"), made(p["year"] - 1, p["n"]))
    )


def unread(text: Column) -> Column:
    """Words of a sentence that are neither periods, accounts, amounts, statements' names nor words that claim nothing more."""
    left = F.regexp_replace(F.regexp_replace(P.without_periods(text), f"{_MONEY}|{_SHARE}", " "), f"{_ACCOUNT}|{STATEMENT_WORDS}", " ")
    words = F.transform(F.split(left, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,·]+|[.,·]+$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*SILENT))


def supported(same: Column, digits: Column, left: Column) -> Column:
    """Supported without a judge: equal amounts of two or more significant digits, and nothing left unread."""
    return F.coalesce(same & (digits >= 2) & (F.size(left) == 0), F.lit(False))


def spans_of(claims: DataFrame) -> DataFrame:
    """claims (with period) with first and last, its days; claims without a period have none."""
    p = c("period")
    return claims.withColumns({"first": period_start(p["year"], p["kind"], p["n"], p["cumulative"]), "last": period_end(p["year"], p["kind"], p["n"])})


def evaluated(claims: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, idx, status (match, mismatch or unknown), statement, amount and note of claims against filed facts.

    claims: key, idx, company, account, value, step, approximate, first, last. facts:
    company, account, statement (CFS or OFS), first, last, amount, rounding_unit, final,
    current (not a later report's comparison), filed, corrected, superseded. Superseded
    facts don't count, preliminary ones only without final ones; any final one may match,
    a restated one is noted. A word for several accounts matches any and differs only if
    all are known. The claims of a key are compared within one statement if one fits
    them all, consolidated first; else each where it matches.
    """
    claims = cut(claims)  # compared once and listed once
    accounts = F.create_map(*[x for k, v in CANDIDATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = claims.withColumn("_accounts", F.coalesce(F.try_element_at(accounts, c("account")), F.array("account"))).withColumn("_n", F.size("_accounts"))
    each = each.select(key, "idx", "company", "value", "step", "approximate", "first", "last", "_n", F.posexplode("_accounts").alias("_place", "account"))
    live = facts.where("not superseded").select("company", "account", "statement", "first", "last", "amount", "rounding_unit", "final", "current", "filed", "corrected")
    joined = each.join(live, ["company", "account", "first", "last"])
    wide = "decimal(38,6)"
    same = same_amount(c("value").cast(wide), c("step").cast(wide), c("amount").cast(wide), c("approximate"), c("rounding_unit").cast(wide))
    rank = F.struct("final", "current", "filed", "corrected", "amount")
    one = joined.withColumn("_same", F.coalesce(same, F.lit(False))).groupBy(key, "idx", "statement", "_place", "_n").agg(
        F.bool_or("final").alias("_final"), F.bool_or(c("_same") & c("final")).alias("_any"), F.max_by(F.struct("_same", "amount"), rank).alias("_top"), F.max_by(F.when(c("_same"), c("amount")), F.struct("_same", rank)).alias("_hit"), F.count_distinct(F.when(c("final"), c("amount"))).alias("_values"),
    )
    match = F.when(c("_final"), c("_any")).otherwise(c("_top._same"))
    note = F.when(c("_values") > 1, F.when(match & ~c("_top._same"), "restated").otherwise("restated_exists"))
    one = one.select(key, "idx", "statement", "_place", "_n", match.alias("_match"), F.when(match, c("_hit")).otherwise(c("_top.amount")).alias("amount"), note.alias("note"))
    best = F.min_by(F.struct("_match", "amount", "note"), F.struct(~c("_match"), "_place"))
    per = one.groupBy(key, "idx", "statement").agg(best.alias("_best"), F.count("*").alias("_known"), F.first("_n").alias("_n"))
    status = F.when(c("_best._match"), "match").when(c("_known") == c("_n"), "mismatch").otherwise("unknown")
    result = F.struct(status.alias("status"), F.when(status != "unknown", c("_best.amount")).alias("amount"), F.when(status == "unknown", "candidate_missing").otherwise(c("_best.note")).alias("note"))
    pair = per.withColumn("_r", result).groupBy(key, "idx").agg(*(F.max(F.when(c("statement") == s, c("_r"))).alias(s) for s in ("CFS", "OFS")))
    all_ = claims.select(key, "idx").join(pair, [key, "idx"], "left")
    whole = Window.partitionBy(key)
    fits = lambda s: F.min(F.coalesce((c(f"{s}.status") == "match"), F.lit(False)).cast("int")).over(whole) == 1
    all_ = all_.withColumns({"_cfs": fits("CFS"), "_ofs": fits("OFS")})
    chosen = (
        F.when(c("_cfs") | (~c("_ofs") & F.coalesce(c("CFS.status") == "match", F.lit(False))), "CFS").when(c("_ofs"), "OFS")
        .when(c("CFS.status") == "mismatch", "CFS").when(c("OFS.status") == "mismatch", "OFS").when(c("CFS").isNotNull(), "CFS").when(c("OFS").isNotNull(), "OFS")
    )
    got = F.when(c("_s") == "CFS", c("CFS")).otherwise(c("OFS"))
    out = all_.withColumn("_s", chosen).withColumn("_r", got)
    separate = c("_ofs") & ~c("_cfs") & (c("_s") == "OFS")
    return out.select(key, "idx", F.coalesce("_r.status", F.lit("unknown")).alias("status"), c("_s").alias("statement"), c("_r.amount").alias("amount"), F.when(separate, F.concat_ws(",", F.lit("separate_only"), "_r.note")).otherwise(c("_r.note")).alias("note"))
