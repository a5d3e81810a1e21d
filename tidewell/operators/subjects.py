"""Whose sentence it is: names that a claim uses, and whether a passage has them at the bounds of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import held

# Legal marks, particles and endings behind nouns, endings of stems that are verbs, and nouns that name nobody.
MARK = r"㈜|\(\s*주\s*\)|주식회사"
LEGAL = rf"{MARK}|(?i)\bCo\.,?\s*Ltd\.?|\bCo\.(?![A-Za-z])|\bLtd\.?(?![A-Za-z])|\bInc\.?(?![A-Za-z])|\bCorp(?:oration|\.)?(?![A-Za-z])"
TAILS = "으로부터 로부터 에게서 입니다 이었다 에서는 에게 에서 으로 이다 이며 였다 와의 과의 은 는 이 가 을 를 의 에 와 과 로 도 다".split()
MORE_TAILS = ("만", "및")
VERBAL = "하 되 있 없 않 했 됐 한 된 었 았 였 겠 졌 할 될 니".split()
GENERIC = (
    "당사 회사 동사 자사 본사 매출 매출액 매출처 제품 사업 부문 고객 고객사 거래처 공급처 협력사 경쟁사 시장 기업 그룹 계열사 자회사 종속회사 지배회사 연결회사 이익 영업이익 순이익 비중 원재료 설비 공장 생산 판매 수출 수입 "
    "연구 개발 계약 기술 투자 위험 환율 금리 주요 국내 해외 전년 당기 전기 비용 가격 수요 공급 서비스 브랜드 업체 주주 최대주주 사업부 법인 지역"
).split()
QUOTED = r"['‘\"“「『]([^'’\"”」』]{2,})['’\"”」』]"
DEFINED = r"([가-힣A-Za-z0-9&.\-]{2,})\s*\(\s*(?:이하\s*)?['‘\"“「]?([^()'’\"”」,]{2,}?)['’\"”」]?\s*(?:(?:이)?라\s*(?:한다|함|합니다))?\s*\)"

_LETTER = "[가-힣A-Za-z0-9]"
_TAIL = "|".join(sorted((*TAILS, *MORE_TAILS), key=len, reverse=True))
_MARK = "\x02"


def _stem(word: Column) -> Column:
    """A word without its particle or ending; null if it has none."""
    fits = F.filter(F.array(*map(F.lit, TAILS)), lambda t: word.endswith(t) & (F.length(word) > F.length(t)))
    return F.when(F.size(fits) > 0, F.substr(word, F.lit(1), F.length(word) - F.length(F.get(fits, F.lit(0)))))


def _one_of(word: Column, words) -> Column:
    return word.isin(*words)


def name_candidates(claim: Column, company: Column) -> Column:
    """Distinct names that a claim may use: the company itself, quoted ones, those with legal marks or capitals, and nouns with particles.

    Wide on purpose: a name too many asks for a closer look, a missed one does not.
    """
    claim = F.coalesce(claim, F.lit(""))

    def of(raw):
        marked = raw.rlike(MARK)
        bare = F.regexp_replace(F.regexp_replace(raw, MARK, ""), r"(?U)^[^\w]+|[^\w]+$", "")

        def read(word):
            stem = _stem(word)
            short = F.coalesce(stem, word)
            noun = stem.rlike("^[가-힣]{2,}$") & ~stem.rlike(f"(?:{'|'.join(VERBAL)})$") & ~_one_of(stem, GENERIC)
            return (
                F.when(marked, F.when(short.rlike(r"(?U)^[A-Za-z0-9가-힣][\w&.\-]*$") & (F.length(short) >= 2), short))
                .when(word.rlike("[A-Z]"), F.when(word.rlike("[가-힣]$"), short).otherwise(word)).when(noun, stem)
            )

        return held(bare, read)

    quoted = F.transform(F.regexp_extract_all(claim, F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x))
    own = F.when((company != "") & claim.contains(company), F.array(company)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(own, quoted, F.transform(F.split(claim, r"\s+"), of)), lambda x: x.isNotNull() & (x != "")))


def _bounded(name: Column, blanks: bool) -> Column:
    """The pattern of a name at the bounds of words, up to two particles behind it; `blanks` may part its letters."""
    plain = F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(name, r"\s+", ""), r"(\\?.)", r"$1\\s*") if blanks else plain
    return F.concat(F.lit(f"(?<!{_LETTER})"), body, F.lit(f"(?=(?:{_TAIL}){{0,2}}(?!{_LETTER}))"))


def has_name(passage: Column, name: Column) -> Column:
    """A passage has a name at the bounds of words; particles may follow. 삼성 is not in 삼성전자."""
    return F.regexp(passage, _bounded(name, False))


def names_in_passage(claim: Column, passage: Column, company: Column) -> Column:
    """All names of a claim are in the passage; true without names."""
    return F.forall(name_candidates(claim, company), lambda n: has_name(passage, n))


def compared(name: Column) -> Column:
    """The form in which a passage's names are compared: lower case, without legal marks, suffixes and blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, LEGAL, ""), r"\s+", ""))


def aliases(passages: Column) -> Column:
    """Array of (name, other) of the short forms that passages define in brackets, both ways."""

    def of(p):
        clean = F.regexp_replace(p, LEGAL, "")
        ones, twos = (F.transform(F.regexp_extract_all(clean, F.lit(DEFINED), F.lit(k)), lambda x: F.trim(x)) for k in (1, 2))
        return F.zip_with(ones, twos, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    pairs = F.filter(F.flatten(F.transform(passages, of)), lambda x: (compared(x["a"]) != "") & (compared(x["b"]) != "") & (compared(x["a"]) != compared(x["b"])))
    way = lambda x, y: F.transform(pairs, lambda p: F.struct(compared(p[x]).alias("name"), p[y].alias("other")))
    return F.array_distinct(F.concat(way("a", "b"), way("b", "a")))


def claimed_names(claim: Column, own: Column) -> Column:
    """Names in a claim that are no company of its own: with legal marks, in capitals, or quoted.

    own: array of the chosen company's names. Mentions of a dictionary come beside these.
    """
    words = F.filter(F.split(F.regexp_replace(F.coalesce(claim, F.lit("")), MARK, f" {_MARK} "), r"[\s(),/·:;\[\]]+"), lambda w: w != "")

    def name(w):
        cut = F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", "")
        return held(F.coalesce(_stem(cut), cut), lambda x: F.coalesce(_stem(x), x))

    def of(ws):
        def each(w, i):
            beside = F.coalesce((F.get(ws, F.greatest(i - 1, F.lit(0))) == _MARK) & (i > 0), F.lit(False)) | F.coalesce(F.get(ws, i + 1) == _MARK, F.lit(False))
            capital = name(w).rlike(r"^[A-Z][A-Z0-9&\-]*[A-Z0-9]$") & (F.length(F.regexp_replace(name(w), "[^A-Z]", "")) >= 2)
            return F.when((w != _MARK) & ((beside & (F.length(name(w)) >= 2)) | capital), name(w))

        return F.transform(ws, each)

    quoted = F.filter(F.transform(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x)), lambda q: (F.length(q).between(2, 20)) & ~_one_of(q, GENERIC))
    mine = F.transform(own, compared)
    return F.array_distinct(F.filter(F.concat(held(words, of), quoted), lambda x: x.isNotNull() & (x != "") & ~F.array_contains(mine, compared(x))))


def subject_valid(names: Column, passage: Column, known: Column) -> Column:
    """Every name, or another form of it among `known` aliases, stands in the passage, legal marks and letter case aside."""
    text = F.lower(F.regexp_replace(F.coalesce(passage, F.lit("")), LEGAL, ""))
    found = lambda n: F.regexp(text, _bounded(compared(n), True))
    others = lambda n: F.transform(F.filter(known, lambda x: x["name"] == compared(n)), lambda x: x["other"])
    return F.forall(names, lambda n: found(n) | F.exists(others(n), found))
