"""Format-preserving pseudonyms for personal data.

Found values are checked (Luhn, mod 97, calendar, octets), ranked within their
format, permuted by a keyed Feistel network with cycle walking over exactly the
values of that format, and written back in the separators they came in. Equal values
get equal pseudonyms in every document, and the key undoes them. Only where a value's
pseudonym would make a longer or earlier number beside it pass its check, another one
is taken, as the key couldn't undo it else.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

ROUNDS = 10
#: The key of the registered query only; elsewhere a key comes from a secret store.
DEMO_KEY = b"tidewell demonstration key"
LEAST_KEY = 16
KINDS = ("email", "secret", "iban", "card", "ip", "phone", "ssn", "date")
#: Names of the patterns; tokens with a prefix of their own count as secrets.
PATTERNS = ("email", "secret", "token", "iban", "date", "ip", "ssn", "card", "phone")


class Permutation:
    """A keyed permutation of 0 .. n - 1 for integers of any size."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.blake2b(key, digest_size=32).digest(), kind.encode()

    def _once(self, x: int, n: int, half: int, rounds) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        size = (half + 7) // 8
        for r in rounds:
            mask = int.from_bytes(hashlib.shake_128(self.key + self.kind + b"%d:%d:" % (n, r) + right.to_bytes(size, "big")).digest(size), "big") & ((1 << half) - 1)
            left, right = right, left ^ mask
        return (right << half) | left  # halves swapped, so that the reversed rounds undo it

    def __call__(self, x: int, n: int, back: bool = False) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
        x = self._once(x, n, half, rounds)
        while x >= n:
            x = self._once(x, n, half, rounds)
        return x


def _luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


def _rank(value: str, alphabets: list[str]) -> tuple[int, int]:
    """The number of a word among all of its alphabets, and how many there are."""
    x, n = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        x, n = x * len(a) + a.index(c), n * len(a)
    return x, n


def _word(x: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _refill(value: str, symbols: str, fresh: str) -> str:
    """value with its characters among the symbols replaced in turn."""
    new = iter(fresh)
    return "".join(next(new) if c in symbols else c for c in value)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Country codes of one and two digits, from the public numbering plan; all others have three.
ONE_DIGIT, TWO_DIGITS = ("1", "7"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Characters of an IBAN by country, from the public register.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Groups of digits a card number has at most where it is a part of a longer run.
CARD_GROUPS = 5
#: Characters around a value in which a match that overlaps it may lie; steps of a permutation until none of these passes.
REACH, MOST_WALKS = 64, 1000
DAYS = (date(1900, 1, 1), date(2099, 12, 31))


class Pseudonyms:
    """Replaces personal data in texts; with back=True puts the originals back."""

    FOUND = re.compile(
        r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@\w[\w-]*(?:\.\w[\w-]*)+)"
        r"|(?P<secret>(?i:token|secret|password|passwd|pwd|api[_-]?key|key)\s*[=:]\s*[\"']?(?P<hex>[0-9a-f]{16,}+(?![A-Za-z])|[0-9A-F]{16,}+(?![A-Za-z])|(?=[^\s\"']*[0-9])(?=[^\s\"']*[A-Za-z])[A-Za-z0-9_/+.~!@#%^&*-]{8,}))"
        r"|(?P<token>\b(?:sk-(?:[a-z]+-)?|gh[pousr]_|xox[abps]-|AKIA(?=[0-9A-Z]{16}\b)|eyJ(?=[\w-]{8,}\.[\w-]{8,}\.))(?=[\w-]*[0-9])[A-Za-z0-9_-]{16,}(?:\.[\w-]{8,}){0,2})"
        r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)"
        r"|(?P<date>(?<![0-9.])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9]|\.[0-9]))"
        r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])|(?<![\w:.])(?=(?:[0-9A-Fa-f]*:){2})(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))"
        r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
        r"|(?P<card>(?<![0-9+])[0-9](?:[0-9]|[ -](?!(?:[0-9]{1,3}\.){3}[0-9])[0-9]){12,18}(?![0-9]))"
        r"|(?P<phone>(?:(?<!\+)\+|(?<![0-9+])00)[1-9](?:(?:[ ./-]?\(0\)[ ./-]?|[ ./-]?\(|\)[ ./-]?|[ ./-])?(?!(?:[0-9]{1,3}\.){3}[0-9])[0-9]){7,14}(?![0-9])"
        r"|(?<![0-9+.,])0[1-9](?:[ ./-]?(?!(?:[0-9]{1,3}\.){3}[0-9])[0-9]){7,10}(?![0-9])"
        r"|\([0-9]{2,5}\) ?[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])"
        r"|(?<![0-9+.-])[2-9][0-9]{2}(?P<sep>[.-])[2-9][0-9]{2}(?P=sep)[0-9]{4}(?![0-9]|[.-][0-9])"
        r"|(?i:\b(?:tel|phone|mobile|cell|fax)\b[.:]{0,2} ?)(?P<number>[0-9](?:[ ./-]?(?!(?:[0-9]{1,3}\.){3}[0-9])[0-9]){6,11})(?![0-9]|[ -][0-9]))"
    )
    MARK = re.compile("[0-9@]|eyJ")
    RUN = re.compile(r"[0-9](?:[0-9]|[ -](?!(?:[0-9]{1,3}\.){3}[0-9])[0-9])*")
    #: A phone number with a trunk or international prefix, as it is looked for in a digit run that is no card.
    TRUNK = re.compile(r"(?:00[1-9]|0[1-9])[0-9]{0,3}(?:[ -][0-9]{2,4}){2,5}")

    def __init__(self, key: bytes, back: bool = False):
        if not isinstance(key, bytes) or not key:
            raise ValueError("a key of bytes is needed")
        self.back, self.checking = back, False
        self.permutations = {k: Permutation(key, k) for k in (*KINDS, "domain")}

    def _moved(self, kind: str, x: int, n: int, ok: Callable[[int], bool] | None = None) -> int:
        """x permuted; walks on along its cycle until the result is of x's own class, where `ok` names one."""
        if self.checking or n < 2:
            return x
        x = self.permutations[kind](x, n, self.back)
        while ok is not None and not ok(x):
            x = self.permutations[kind](x, n, self.back)
        return x

    def _classes(self, kind: str, value: str, alphabets: list[str], ok: Callable[[str], bool] | None = None) -> str:
        """A word permuted among all words with the same alphabet at each place."""
        x, n = _rank(value, alphabets)
        return _word(self._moved(kind, x, n, None if ok is None else lambda y: ok(_word(y, alphabets))), alphabets)

    def _passes(self, kind: str, value: str) -> bool:
        make: Callable[[str], str | None] = getattr(self, kind)
        self.checking = True
        passed = make(value) is not None
        self.checking = False
        return passed

    def _digits(self, kind: str, digits: str, ok: Callable[[str], bool] | None = None) -> str:
        return self._classes(kind, digits, [DIGITS] * len(digits), ok)

    def _cased(self, kind: str, value: str) -> str:
        """Letters and digits permuted within their kind, whatever their case, which stays."""
        low = "".join(c.lower() if c in UPPER else c for c in value)
        moved = self._classes(kind, low, [next((a for a in (DIGITS, LOWER) if c in a), c) for c in low])
        return "".join(m.upper() if c in UPPER else m for c, m in zip(value, moved, strict=True))

    def email(self, value: str) -> str:
        """Names and domains are permuted apart, so that equal domains stay linked; the last label stays."""
        name, _, domain = value.partition("@")
        inner, _, last = domain.rpartition(".")
        return f"{self._cased('email', name)}@{self._cased('domain', inner)}.{last}"

    def secret(self, value: str) -> str:
        start = self.FOUND.match(value).start("hex")
        head, body = value[:start], value[start:]
        for hexes in ("0123456789abcdef", "0123456789ABCDEF"):
            if set(body) <= set(hexes):
                letters = not body.isdigit()
                return head + self._classes("secret", body, [hexes] * len(body), lambda y: letters != y.isdigit())
        return head + self._symbols(body)

    def _symbols(self, body: str) -> str:
        hexes = lambda y: set(y) <= set("0123456789abcdef") or set(y) <= set("0123456789ABCDEF")
        return self._classes("secret", body, [next((a for a in (DIGITS, LOWER, UPPER) if c in a), c) for c in body], None if hexes(body) else lambda y: not hexes(y))

    def token(self, value: str) -> str:
        start = re.match("sk-(?:[a-z]+-)?|gh[pousr]_|xox[abps]-|AKIA|eyJ", value).end()
        return value[:start] + self._classes("secret", value[start:], [next((a for a in (DIGITS, LOWER, UPPER) if c in a), c) for c in value[start:]])

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not check.isdigit() or _mod97(country, account) != int(check):
            return None
        account = self._classes("iban", account, [DIGITS if c in DIGITS else UPPER for c in account])
        return self._spaced(value, f"{country}{_mod97(country, account):02d}{account}")

    @staticmethod
    def _spaced(value: str, plain: str) -> str:
        new = iter(plain)
        return "".join(c if c == " " else next(new) for c in value)

    def card(self, value: str) -> str | None:
        digits = re.sub("[ -]", "", value)
        # Payment cards start with 2 to 6; other numbers, and those with a wrong check digit, are no cards.
        if digits[0] not in "23456" or _luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = digits[0] + self._digits("card", digits[1:-1])
        return _refill(value, DIGITS, body + str(_luhn(body)))

    def ip(self, value: str) -> str | None:
        if ":" in value:
            return self._ip6(value)
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        x = self._moved("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ip6(self, value: str) -> str | None:
        """The significant hexadecimal digits of the groups, so that short and long forms stay linked."""
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        groups = [(g, len(g) - len(g.lstrip("0"))) for g in value.split(":")]
        if sum(1 for g, zeros in groups if len(g) > zeros) < 3:
            return None
        digits = "".join(g[zeros:] for g, zeros in groups)
        firsts = {sum(len(g) - zeros for g, zeros in groups[:i]) for i, (g, zeros) in enumerate(groups) if len(g) > zeros}
        alphabets = [(DIGITS[1:] if i in firsts else DIGITS) if c in DIGITS else LOWER[:6] for i, c in enumerate(digits)]
        new = iter(self._classes("ip", digits.lower(), alphabets))
        return ":".join("0" * zeros + "".join(next(new).upper() if c in UPPER else next(new) for c in g[zeros:]) for g, zeros in groups)

    def phone(self, value: str) -> str | None:
        """The number without its writing is permuted: +44 20.., 0044 20.. and +4420.. stay linked.

        Country codes, trunk zeros and the plan of North American numbers stay.
        """
        digits = "".join(c for c in value if c in DIGITS)
        nanp = lambda d: len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"
        lead, number = "", digits
        abroad = value[0] == "+" or digits[:2] == "00"
        if abroad:
            lead = "00" if value[0] != "+" else ""
            number = digits[len(lead) :]
            code = number[:1] if number[:1] in ONE_DIGIT else number[:2] if number[:2] in TWO_DIGITS else number[:3]
            lead, number = lead + code, number[len(code) :]
            if not 8 <= len(code) + len(number) <= 15 or (code == "1" and len(number) != 10) or not number:
                return None
            if "(0)" in value and number[0] == "0":  # +44 (0)20 is +44 20
                lead, number = lead + "0", number[1:]
            ok = (lambda d: nanp(d) == nanp(number)) if code == "1" else None
        elif digits[0] == "0":
            if not 9 <= len(digits) <= 12 or digits[1] == "0":
                return None
            lead, number, ok = "0", digits[1:], lambda d: d[0] != "0"
        else:
            ok = (lambda d: nanp(d)) if nanp(digits) else (lambda d: d[0] != "0" and not nanp(d))
        return _refill(value, DIGITS, lead + self._digits("phone", number, ok))

    def ssn(self, value: str) -> str | None:
        area, group, serial = (int(x) for x in value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x = self._moved("ssn", x, 898 * 99 * 9999)
        area, group, serial = x // (99 * 9999), x // 9999 % 99, x % 9999
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, value: str) -> str | None:
        """Year first, or day first; with slashes month first where no day fits otherwise."""
        iso = value[4] == "-"
        try:
            day = date.fromisoformat(value) if iso else date(int(value[6:]), int(value[3:5]), int(value[:2]))
            month_first = False
        except ValueError:
            try:
                day = date(int(value[6:]), int(value[:2]), int(value[3:5]))
            except ValueError:
                return None
            month_first = True
            if iso or value[2] != "/" or value[5] != "/":
                return None
        of = lambda x: DAYS[0] + timedelta(x)
        day = of(self._moved("date", (day - DAYS[0]).days, (DAYS[1] - DAYS[0]).days + 1, (lambda x: of(x).day > 12) if month_first else None))
        if iso:
            return day.isoformat()
        one, two = (day.month, day.day) if month_first else (day.day, day.month)
        return f"{one:02d}{value[2]}{two:02d}{value[5]}{day.year}"

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the input."""
        if not self.MARK.search(text):
            return text, []
        found = self._found(text)
        return self._replaced(text, found), [("secret" if kind == "token" else kind, start, end) for kind, start, end, _, _ in found]

    def _ends(self, kind: str, value: str) -> Iterator[int]:
        """Lengths at which a value of the kind may end within the match, the likeliest first."""
        if kind == "phone":
            gaps = [m.start() for m in re.finditer(r"[ ./-]+", value)] + [len(value)]
            counts = [(sum(c in DIGITS for c in value[:g]), g) for g in gaps]
            least = 11 + 2 * value.startswith("00") if value[0] == "+" or value.startswith("00") else 10
            yield from [g for n, g in counts if n >= least][:1]
            yield from [g for n, g in reversed(counts) if n < least]
            return
        if kind == "iban":
            marks = [i + 1 for i, c in enumerate(value) if c != " "]
            length = IBAN_LENGTHS.get(value[:2])
            if length and length < len(marks) and not value[marks[length - 1] : marks[length - 1] + 1].isalnum():
                yield marks[length - 1]
            yield len(value)
            if not length:
                yield from (m.start() for m in reversed(list(re.finditer(" ", value))) if sum(x <= m.start() for x in marks) >= 15)
            return
        yield len(value)
        if kind == "card":
            for n, gap in reversed(list(enumerate(re.finditer("[ -]", value), 1))):
                if n <= CARD_GROUPS and gap.start() - n + 1 >= 13:
                    yield gap.start()

    def _found(self, text: str, at: int = 0, run: int = 0) -> list[tuple[str, int, int, bool, int]]:
        """(kind, start, end, tangled, run) of each value from `at` on.

        Where a match fails its check, its shorter and later groups are tried in turn.
        A value is tangled if a failed match overlaps it; run is the end of the last digit run
        that began as no card, in which a phone number must have its prefix and reach the end.
        """
        found, reach = [], 0
        while m := self.FOUND.search(text, at):
            kind, start, at = next(k for k in PATTERNS if m[k] is not None), m.start(), m.end()
            if m["number"] is not None:
                start = m.start("number")
            if kind == "phone" and start < run:
                end = None
            else:
                end = next((start + n for n in self._ends(kind, text[start:at]) if self._passes(kind, text[start : start + n])), None)
            if end is None and kind == "card" and start >= run:
                run = self.RUN.match(text, start).end()
            if end is None and start < run and (trunk := self.TRUNK.fullmatch(text, start, run)) and self._passes("phone", trunk[0]):
                kind, end = "phone", run
            if end is None:
                reach = max(reach, at)
                if kind in ("iban", "card") or start < run:
                    at = start + 1
            else:
                found.append((kind, start, end, start < reach or end != m.end(), run))
                reach, at = max(reach, m.end()), end
        return found

    def _replaced(self, text: str, found: list[tuple[str, int, int, bool, int]]) -> str:
        """text with its values replaced so that they are found again in the same places.

        A tangled value is permuted on until no failed match that overlaps it passes. The values'
        order is turned round on the way back, so that each is judged among the same neighbours.
        """
        values = [text[start:end] for _, start, end, _, _ in found]
        edges = [0, *(x for f in found for x in f[1:3]), len(text)]
        gaps = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]

        def same(i: int, value: str) -> bool:
            first = i
            while first and found[first][1] - found[first - 1][2] < REACH and found[i][1] - found[first - 1][2] < REACH:
                first -= 1
            window, spans, after = gaps[first][-REACH:], [], i + 1
            at = max(0, len(window) - REACH + 2) if first == 0 or len(gaps[first]) >= REACH else 0
            shift = found[first][1] - len(window)
            for j in range(first, i + 1):
                window += gaps[j] if j > first else ""
                spans.append((found[j][0], len(window), len(window) + len(value if j == i else values[j])))
                window += value if j == i else values[j]
            stop, tail = len(window), gaps[i + 1]
            while len(tail) < REACH and after < len(found):
                tail += values[after] + gaps[after + 1]
                after += 1
            seen = self._found(window + tail[:REACH], at, max(0, found[first][4] - shift) if found[first][4] > found[first][1] else 0)
            return [f[:3] for f in seen if f[1] < stop] == spans

        for i in range(len(found))[:: -1 if self.back else 1]:
            make: Callable[[str], str] = getattr(self, found[i][0])
            new = make(values[i])
            if found[i][3] and same(i, values[i]):
                for _ in range(MOST_WALKS):
                    if same(i, new):
                        break
                    new = make(new)
            values[i] = new
        return "".join(x for pair in zip(gaps, [*values, ""], strict=True) for x in pair)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with text pseudonymised and found: the kind, start and end of each value in the input text.

    key: at least 16 bytes, from a secret store; who holds it can undo the pseudonyms.
    docs needs text; all columns stay, and one named found is replaced. Values that fail
    their check, and hold no shorter or later value that passes, stay as they are: octets above 255, days of no calendar, wrong IBAN
    check numbers, card numbers with a wrong Luhn digit. Null text stays null with nothing found; empty and clean
    texts stay. Equal values become equal pseudonyms in all rows. back=True with the same
    key restores the texts. Empty tables give empty results; nothing is shuffled.
    """
    if not isinstance(key, bytes) or len(key) < LEAST_KEY:
        raise ValueError(f"a key of at least {LEAST_KEY} bytes is needed")
    keep = [c for c in docs.columns if c not in ("text", "found")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])
    df = docs.select(row.alias("row"), F.col("text").cast("binary").alias("body"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key, back)
        for piece in pieces(batches):
            texts, spans = [], []
            for body in piece.column("body").to_pylist():
                text, found = (None, []) if body is None else replace(body.decode())
                texts.append(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["row", "text", "found"])

    out = df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, text string, found {SPANS}")
    return out.select(*[F.col(f"row.`{c}`") if c in keep else F.col(c) for c in docs.columns if c != "found"], "found")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return moved.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, "text")
