"""User formulas over bars: text in the syntax of Python expressions, compiled to columns.

Python's own parser reads the text; names, calls and operators become columns over the
rolling functions, so that Spark plans them like any other expression. Every function looks
back only. A function's column arguments are columns of their own, as windows don't nest.
"""

import ast
import inspect
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import rolling as R
from tidewell.functions.definitions import checksum, period

from . import backtest as B
from . import indicators as I

# Names of the bars' columns and constants, and the sizes that a formula may have.
SERIES = ("open", "high", "low", "close", "volume")
CONSTANTS = {"True": True, "False": False, "pi": math.pi}
MOST_CHARACTERS, MOST_NODES, MOST_POWER = 2000, 400, 10


class FormulaError(ValueError):
    """A formula that is no formula; the message says why."""


@dataclass
class Frame:
    """Bars that gain a column for every part of a formula that must be one."""

    df: DataFrame
    parameters: dict[str, float] = field(default_factory=dict)
    made: int = 0

    def name(self) -> str:
        self.made += 1
        return f"_part{self.made}"

    def put(self, value: Column) -> Column:
        name = self.name()
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def named(self, x: Column) -> str:
        name = self.name()
        self.df = self.df.withColumn(name, x)
        return name


# Functions by name: parameters are annotated "series", "any" (a series or a number), "flag", "number" or a least period.
def _sma(f, x: "series", n: 1): return R.sma(x, n)
def _std(f, x: "series", n: 2): return R.std(x, n)
def _highest(f, x: "series", n: 1): return R.highest(x, n)
def _lowest(f, x: "series", n: 1): return R.lowest(x, n)
def _sum(f, x: "series", n: 1): return R.total(x, n)
def _shift(f, x: "series", n: 1 = 1): return R.shift(x, n)
def _change(f, x: "series", n: 1 = 1): return R.change(x, n)
def _pct_change(f, x: "series", n: 1 = 1): return R.pct_change(x, n)
def _zscore(f, x: "series", n: 2 = 20): return R.zscore(x, n)
def _normalize(f, x: "series", n: 2 = 20): return R.normalize(x, n)
def _rank(f, x: "series", n: 2 = 20): return R.rank(x, n)
def _crossover(f, a: "any", b: "any"): return R.crossover(a, b)
def _crossunder(f, a: "any", b: "any"): return R.crossunder(a, b)
def _where(f, condition: "flag", a: "any", b: "any"): return F.when(condition, a).otherwise(b)
def _abs(f, x: "any"): return F.abs(x)
def _log(f, x: "any"): return R.safe_log(x)
def _sqrt(f, x: "any"): return R.safe_sqrt(x)
def _sign(f, x: "any"): return F.signum(x)
def _clip(f, x: "any", low: "number", high: "number"): return R.clip(x, low, high)
def _max(f, a: "any", b: "any"): return R.both_max(a, b)
def _min(f, a: "any", b: "any"): return R.both_min(a, b)
def _nz(f, x: "any", value: "number" = 0.0): return F.coalesce(x, F.lit(value))
def _typical(f): return R.typical()
def _vwap(f, n: 1 = 20): return R.vwap(n)
def _obv(f): return F.sum(F.coalesce(F.signum(f.put(R.change("close"))), F.lit(0.0)) * F.col("volume")).over(R.so_far())
def _bb_mid(f, x: "series", n: 2 = 20, k: "number" = 2.0): return R.sma(x, n)
def _bb_upper(f, x: "series", n: 2 = 20, k: "number" = 2.0): return R.sma(x, n) + k * R.std(x, n)
def _bb_lower(f, x: "series", n: 2 = 20, k: "number" = 2.0): return R.sma(x, n) - k * R.std(x, n)


def _barssince(f, condition: "flag"):
    bar = f.put(F.row_number().over(R.order()))
    return bar - F.last(F.when(condition, bar), ignorenulls=True).over(R.so_far())


def _ema(f, x: "series", n: 1):
    source, out = f.named(x), f.name()
    f.df = I.ema(f.df, {out: n}, source)
    return F.col(out)


def _rsi(f, x: "series", n: 2 = 14):
    source, out = f.named(x), f.name()
    f.df = I.rsi(f.df, n, source, out)
    return F.col(out)


def _atr(f, n: 1 = 14):
    out = f.name()
    f.df = I.atr(f.df, n, out)
    return F.col(out)


def _macd_part(part: str):
    def made(f, x: "series", fast: 1 = 12, slow: 1 = 26, signal: 1 = 9):
        source, out = f.named(x), f.name()
        kept = f.df.columns
        f.df = I.macd(f.df, fast, slow, signal, source).select(*kept, F.col(part).alias(out))
        return F.col(out)

    return made


FUNCTIONS = {name[1:]: made for name, made in list(globals().items()) if inspect.isfunction(made) and made.__module__ == __name__ and "f" in inspect.signature(made).parameters}
FUNCTIONS |= {"mean": _sma, "macd": _macd_part("macd"), "macd_signal": _macd_part("macd_signal"), "macd_hist": _macd_part("macd_hist")}
#: Functions whose column is a flag, and those that stay within a row and so need no column of their own.
FLAGS, PLAIN = {"crossover", "crossunder"}, {"abs", "log", "sqrt", "sign", "clip", "max", "min", "nz", "where", "typical"}


def parse(text: str) -> ast.expr:
    """The expression of a formula's text; what no formula may hold is an error."""
    if not isinstance(text, str) or not text.strip():
        raise FormulaError("the formula is empty")
    if len(text) > MOST_CHARACTERS:
        raise FormulaError(f"the formula has more than {MOST_CHARACTERS} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaError(f"no formula: {e}") from e
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise FormulaError("the formula is too long")
    for node in ast.walk(tree):
        match node:
            case ast.Constant(value=v) if isinstance(v, (bool, int, float)):
                pass
            case ast.Constant():
                raise FormulaError("constants are numbers")
            case ast.Name(id=name) if name.startswith("_"):
                raise FormulaError("names do not begin with an underscore")
            case ast.Call(func=ast.Name(id=name), args=args) if all(not isinstance(a, ast.Starred) for a in args):
                _literal_periods(name, node)
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Mod() | ast.Pow() | ast.BitAnd() | ast.BitOr()) | ast.UnaryOp() | ast.BoolOp() | ast.Name() | ast.keyword(arg=str()):
                pass
            case ast.Compare(ops=ops) if all(isinstance(o, (ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.Eq, ast.NotEq)) for o in ops):
                pass
            case ast.operator() | ast.unaryop() | ast.boolop() | ast.cmpop() | ast.expr_context():
                pass
            case _:
                raise FormulaError(f"a formula holds no {type(node).__name__}")
    return tree


def _literal_periods(name: str, call: ast.Call) -> None:
    """A literal period below the function's least one is found before any data is seen: shift(close, 0) would look ahead."""
    if name not in FUNCTIONS:
        return
    wanted = list(inspect.signature(FUNCTIONS[name]).parameters.values())[1:]
    given = list(zip(wanted, call.args)) + [(p, k.value) for k in call.keywords for p in wanted if p.name == k.arg]
    for p, node in given:
        if isinstance(p.annotation, int):
            try:
                value = ast.literal_eval(node)
            except ValueError:
                continue
            _period(name, value, p.annotation)


def _period(name: str, value, least: int) -> int:
    try:
        return period(value, least)
    except (TypeError, ValueError) as e:
        raise FormulaError(f"{name}: {e}") from e


def references(text: str) -> tuple[set[str], set[str]]:
    """(names, functions) that a formula uses."""
    nodes = list(ast.walk(parse(text)))
    functions = {n.func.id for n in nodes if isinstance(n, ast.Call)}
    return {n.id for n in nodes if isinstance(n, ast.Name)} - functions, functions


def validate(indicator: str, buy: str | None = None, sell: str | None = None, parameters: dict | None = None) -> dict:
    """Names, functions, warnings and checksum of a definition; an error where a name is unknown or reserved."""
    parameters, names, functions, warnings = parameters or {}, set(), set(), []
    for name, value in parameters.items():
        if not isinstance(name, str) or not name.isidentifier() or name.startswith("_") or name in (*SERIES, *FUNCTIONS, *CONSTANTS):
            raise FormulaError(f"no name for a parameter: {name}")
        try:
            float(value)
        except (TypeError, ValueError) as e:
            raise FormulaError(f"parameter {name} is no number") from e
    for side, text in (("indicator", indicator), ("buy", buy), ("sell", sell)):
        if not (text or "").strip():
            if side == "indicator":
                raise FormulaError("an indicator is needed")
            continue
        used, called = references(text)
        unknown = sorted(called - set(FUNCTIONS)) + sorted(used - set(SERIES) - set(parameters) - set(CONSTANTS))
        if unknown:
            raise FormulaError(f"{side}: unknown {unknown}")
        names, functions = names | used, functions | called
    if not (buy or "").strip():
        warnings.append("without a buy formula only the indicator is computed")
    elif not (sell or "").strip():
        warnings.append("without a sell formula a position ends when its buy formula does")
    definition = {"indicator": indicator.strip(), "buy": (buy or "").strip(), "sell": (sell or "").strip(), **{f"parameter {k}": float(v) for k, v in parameters.items()}}
    return {"names": sorted(names), "functions": sorted(functions), "warnings": warnings, "checksum": checksum(definition)}


def _number(v) -> bool:
    return isinstance(v, (bool, int, float))


def _series(v) -> Column:
    if _number(v):
        return F.lit(None if math.isnan(v) else float(v)).cast("double")
    return v[0].cast("double") if v[1] else v[0]


def _flag(v) -> Column:
    """Whether a value holds: numbers other than 0 do, and missing ones."""
    return F.lit(bool(v)) if _number(v) else v[0] if v[1] else F.coalesce(v[0] != 0, F.lit(True))


def _arithmetic(op: ast.operator, a, b):
    if isinstance(op, (ast.BitAnd, ast.BitOr)):
        both = _flag(a) & _flag(b) if isinstance(op, ast.BitAnd) else _flag(a) | _flag(b)
        return both, True
    if isinstance(op, ast.Pow) and not (_number(b) and abs(b) <= MOST_POWER):
        raise FormulaError(f"an exponent is a number up to {MOST_POWER}")
    if _number(a) and _number(b):
        try:
            return {ast.Add: float.__add__, ast.Sub: float.__sub__, ast.Mult: float.__mul__, ast.Div: float.__truediv__, ast.Mod: float.__mod__, ast.Pow: float.__pow__}[type(op)](float(a), float(b))
        except (ZeroDivisionError, OverflowError):
            return math.nan
    x, y = _series(a), _series(b)
    safe = F.nullif(y, F.lit(0.0))
    return {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: x / safe, ast.Mod: lambda: x - safe * F.floor(x / safe), ast.Pow: lambda: F.pow(x, y)}[type(op)](), False


def _compared(op: ast.cmpop, a, b) -> Column:
    """A comparison with a missing value fails, but for unequal."""
    x, y = _series(a), _series(b)
    made = {ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y, ast.Eq: lambda: x == y, ast.NotEq: lambda: x != y}[type(op)]()
    return F.coalesce(made, F.lit(isinstance(op, ast.NotEq)))


def _value(f: Frame, node: ast.expr):
    """A number, or (column, whether it is a flag)."""
    match node:
        case ast.Constant(value=v):
            return v
        case ast.Name(id=name):
            if name in SERIES:
                return F.col(name).cast("double"), False
            if name in f.parameters or name in CONSTANTS:
                return f.parameters.get(name, CONSTANTS.get(name))
            raise FormulaError(f"unknown name {name}")
        case ast.UnaryOp(op=op, operand=operand):
            v = _value(f, operand)
            if isinstance(op, (ast.Not, ast.Invert)):
                return (not v) if _number(v) else (~_flag(v), True)
            sign = -1 if isinstance(op, ast.USub) else 1
            return sign * v if _number(v) else (sign * _series(v), False)
        case ast.BinOp(left=left, op=op, right=right):
            return _arithmetic(op, _value(f, left), _value(f, right))
        case ast.BoolOp(op=op, values=values):
            flags = [_flag(_value(f, v)) for v in values]
            out = flags[0]
            for x in flags[1:]:
                out = out & x if isinstance(op, ast.And) else out | x
            return out, True
        case ast.Compare(left=left, ops=ops, comparators=others):
            values = [_value(f, x) for x in (left, *others)]
            out = F.lit(True)
            for op, a, b in zip(ops, values[:-1], values[1:], strict=True):
                out = out & _compared(op, a, b)
            return out, True
        case ast.Call(func=ast.Name(id=name)):
            return _called(f, name, node)
    raise FormulaError(f"a formula holds no {type(node).__name__}")


def _constant(f: Frame, node: ast.expr) -> float:
    value = _value(f, node)
    if not _number(value):
        raise FormulaError("a number is wanted, not a series")
    return value


def _called(f: Frame, name: str, call: ast.Call):
    if name not in FUNCTIONS:
        raise FormulaError(f"unknown function {name}")
    made = FUNCTIONS[name]
    try:
        given = inspect.signature(made).bind(f, *call.args, **{k.arg: k.value for k in call.keywords}).arguments
    except TypeError as e:
        raise FormulaError(f"{name}: {e}") from e
    arguments = {}
    for p in list(inspect.signature(made).parameters.values())[1:]:
        if p.name not in given:
            continue
        node, kind = given[p.name], p.annotation
        if isinstance(kind, int):
            arguments[p.name] = _period(name, _constant(f, node), kind)
        elif kind == "number":
            arguments[p.name] = float(_constant(f, node))
        else:
            value = _value(f, node)
            if kind == "series" and _number(value):
                raise FormulaError(f"{name}: the first argument is a series")
            column = _flag(value) if kind == "flag" else _series(value)
            arguments[p.name] = column if name in PLAIN else f.put(column)
    out = made(f, **arguments)
    return (out if name in PLAIN else f.put(out)), name in FLAGS


def with_formula(bars: DataFrame, text: str, out: str = "indicator", parameters: dict[str, float] | None = None) -> DataFrame:
    """bars with a formula's value as a column: a double, or a boolean where the formula is a condition."""
    frame = Frame(bars, {k: float(v) for k, v in (parameters or {}).items()})
    value = _value(frame, parse(text))
    column = _series(value) if _number(value) else value[0]
    return frame.df.withColumn(out, column).select(*bars.columns, out)


def run(bars: DataFrame, indicator: str, buy: str | None = None, sell: str | None = None, parameters: dict[str, float] | None = None) -> DataFrame:
    """bars with indicator and, with a buy formula, position: a buy wins over a sell; without a sell formula what is no buy sells."""
    validate(indicator, buy, sell, parameters)
    df = with_formula(bars, indicator, "indicator", parameters)
    if not (buy or "").strip():
        return df
    df = with_formula(df, f"nz({buy}) != 0", "_buy", parameters)
    df = with_formula(df, f"nz({sell}) != 0" if (sell or "").strip() else f"not nz({buy})", "_sell", parameters)
    return B.staged_regime(df, F.col("_buy"), F.col("_sell"), entry_wins=True).drop("_buy", "_sell")


# Forms of the functions in the charting language, by the names of their parameters.
CHART = {
    "sma": "ta.sma({x}, {n})", "mean": "ta.sma({x}, {n})", "ema": "ta.ema({x}, {n})", "rsi": "ta.rsi({x}, {n})", "std": "ta.stdev({x}, {n})", "highest": "ta.highest({x}, {n})", "lowest": "ta.lowest({x}, {n})", "sum": "math.sum({x}, {n})",
    "shift": "{x}[{n}]", "change": "ta.change({x}, {n})", "pct_change": "({x} / {x}[{n}] - 1)", "crossover": "ta.crossover({a}, {b})", "crossunder": "ta.crossunder({a}, {b})", "barssince": "ta.barssince({condition})", "atr": "ta.atr({n})", "obv": "ta.obv",
    "typical": "hlc3", "vwap": "(math.sum(hlc3 * volume, {n}) / math.sum(volume, {n}))", "abs": "math.abs({x})", "log": "math.log({x})", "sqrt": "math.sqrt({x})", "sign": "math.sign({x})", "max": "math.max({a}, {b})", "min": "math.min({a}, {b})",
    "clip": "math.max(math.min({x}, {high}), {low})", "nz": "nz({x}, {value})", "where": "({condition} ? {a} : {b})", "zscore": "(({x} - ta.sma({x}, {n})) / ta.stdev({x}, {n}))", "normalize": "(({x} - ta.lowest({x}, {n})) / (ta.highest({x}, {n}) - ta.lowest({x}, {n})))",
    "rank": "(ta.percentrank({x}, {n}) / 100)", "bb_mid": "ta.sma({x}, {n})", "bb_upper": "(ta.sma({x}, {n}) + {k} * ta.stdev({x}, {n}))", "bb_lower": "(ta.sma({x}, {n}) - {k} * ta.stdev({x}, {n}))", "macd": "(ta.ema({x}, {fast}) - ta.ema({x}, {slow}))",
    "macd_signal": "ta.ema(ta.ema({x}, {fast}) - ta.ema({x}, {slow}), {signal})",
}
CHART["macd_hist"] = f"({CHART['macd']} - {CHART['macd_signal']})"


def _charted(node: ast.expr) -> str:
    """An expression in the charting language, with every default written out; a function without a form in it is an error."""
    c = _charted
    match node:
        case ast.Call(func=ast.Name(id=name), args=args):
            if name not in CHART:
                raise FormulaError(f"{name} has no form in the charting language")
            bound = inspect.signature(FUNCTIONS[name]).bind(None, *map(c, args), **{k.arg: c(k.value) for k in node.keywords})
            bound.apply_defaults()
            return CHART[name].format(**{k: v if isinstance(v, str) else f"{v:g}" for k, v in bound.arguments.items() if k != "f"})
        case ast.BinOp(left=left, op=ast.Pow(), right=right):
            return f"math.pow({c(left)}, {c(right)})"
        case ast.BinOp(left=left, op=op, right=right):
            sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.BitAnd: "and", ast.BitOr: "or"}[type(op)]
            return f"({c(left)} {sign} {c(right)})"
        case ast.BoolOp(op=op, values=values):
            return "(" + (" and " if isinstance(op, ast.And) else " or ").join(map(c, values)) + ")"
        case ast.UnaryOp(op=op, operand=operand):
            return f"({'not ' if isinstance(op, (ast.Not, ast.Invert)) else '-' if isinstance(op, ast.USub) else ''}{c(operand)})"
        case ast.Compare(left=left, ops=ops, comparators=others):
            signs = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
            terms = [c(x) for x in (left, *others)]
            return "(" + " and ".join(f"{a} {signs[type(o)]} {b}" for a, o, b in zip(terms[:-1], ops, terms[1:], strict=True)) + ")"
        case ast.Constant(value=bool(v)):
            return str(v).lower()
        case _:
            return ast.unparse(node)


def to_chart(name: str, indicator: str, buy: str | None = None, sell: str | None = None, parameters: dict | None = None) -> str:
    """A definition as a script of the charting language; what it cannot say is an error."""
    validate(indicator, buy, sell, parameters)
    lines = ["//@version=5", f"indicator({json.dumps(name, ensure_ascii=False)}, overlay=false)"]
    lines += [f'{k} = input.float({float(v)}, "{k}")' for k, v in (parameters or {}).items()]
    lines += [f"value = {_charted(parse(indicator))}", 'plot(value, title="value", linewidth=2)']
    for side, text in (("buy", buy), ("sell", sell)):
        if (text or "").strip():
            lines += [f"{side} = {_charted(parse(text))}", f'plotchar({side}, title="{side}", char="{side[0].upper()}", location=location.{"bottom" if side == "buy" else "top"})']
    return "\n".join(lines)


def to_python(name: str, indicator: str, buy: str | None = None, sell: str | None = None, parameters: dict | None = None) -> str:
    """A definition as a script that runs it on bars; every text in it is a literal."""
    return f"from tidewell.operators.formula import run\n\nNAME = {name!r}\nDEFINITION = {dict(indicator=indicator, buy=buy, sell=sell, parameters=parameters or {})!r}\n\nresult = run(bars, **DEFINITION)  # bars: symbol, time, open, high, low, close, volume\n"
