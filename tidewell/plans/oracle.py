"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY time"


def frame(a: int, b: int = 0) -> str:
    """Rows from a before to b before the current one."""
    return f"({W} ROWS BETWEEN {a} PRECEDING AND {f'{b} PRECEDING' if b else 'CURRENT ROW'})"


def roll(f: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n - 1)} = {n} THEN {f}({x}) OVER {frame(n - 1)} END)"


def prior(f: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n, 1)} = {n} THEN {f}({x}) OVER {frame(n, 1)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def ewm(source: str, name: str, x: str, alpha: str, out: str) -> str:
    """A subquery `name`: source with its exponential mean `out`; rows before the first value have null."""
    return f"""
{name}_list AS (
  SELECT symbol, list(time ORDER BY time) AS ts, list_transform(list({x} ORDER BY time), lambda v: [v::DOUBLE]) AS xs FROM {source} WHERE {x} IS NOT NULL GROUP BY symbol),
{name}_y AS (SELECT symbol, unnest(ts) AS time, unnest(list_reduce(xs, lambda acc, v: list_append(acc, (1 - {alpha}) * acc[-1] + {alpha} * v[1]))) AS {out} FROM {name}_list),
{name} AS (SELECT s.*, y.{out} FROM {source} s LEFT JOIN {name}_y y USING (symbol, time))"""


def span(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def macd(source: str, name: str = "mc") -> str:
    a = ewm(source, f"{name}1", "close", span(12), "e12")
    b = ewm(f"{name}1", f"{name}2", "close", span(26), "e26")
    c = ewm(f"{name}3", f"{name}4", "macd", span(9), "macd_signal")
    return f"{a},{b},\n{name}3 AS (SELECT *, e12 - e26 AS macd FROM {name}2),{c},\n{name} AS (SELECT *, macd - macd_signal AS macd_hist FROM {name}4)"


def moves(source: str, name: str) -> str:
    d = f"close - {lag('close')}"
    return f"{name} AS (SELECT *, CASE WHEN {d} IS NOT NULL THEN greatest({d}, 0) END AS gain, CASE WHEN {d} IS NOT NULL THEN greatest(-({d}), 0) END AS loss FROM {source})"


def rsi(source: str, name: str, n: int = 14) -> str:
    return f"{moves(source, name + '_m')},\n{name} AS (SELECT *, 100 - 100 / (1 + {roll('avg', 'gain', n)} / nullif({roll('avg', 'loss', n)}, 0)) AS rsi FROM {name}_m)"


def rsi_wilder(source: str, name: str, n: int = 14) -> str:
    a = f"(1.0::DOUBLE / {n})"
    return f"{moves(source, name + '_m')},{ewm(name + '_m', name + '_g', 'gain', a, 'ag')},{ewm(name + '_g', name + '_l', 'loss', a, 'al')},\n{name} AS (SELECT *, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi FROM {name}_l)"


def bollinger(source: str, name: str, n: int = 20, k: int = 2, sd: str = "stddev_samp") -> str:
    m, s = roll("avg", "close", n), roll(sd, "close", n)
    return f"{name} AS (SELECT *, {m} AS bb_mid, {m} + {k} * {s} AS bb_upper, {m} - {k} * {s} AS bb_lower FROM {source})"


def atr(source: str, name: str, n: int = 14, out: str = "atr") -> str:
    b = lag("close")
    return f"{name}_tr AS (SELECT *, greatest(high - low, abs(high - {b}), abs(low - {b})) AS tr_ FROM {source}),\n{name} AS (SELECT * EXCLUDE (tr_), {roll('avg', 'tr_', n)} AS {out} FROM {name}_tr)"


def research(source: str, name: str) -> str:
    return f"{rsi_wilder(source, 'rw')},{macd('rw')},\n{bollinger('mc', 'bo')},\n{name} AS (SELECT *, {roll('avg', 'close', 5)} AS ma5, {roll('avg', 'close', 20)} AS ma20, {roll('avg', 'close', 60)} AS ma60, {roll('avg', 'volume', 20)} AS volume_ma20 FROM bo)"


def features(source: str, name: str) -> str:
    w = "nullif(bb_upper - bb_lower, 0)"
    return f"""{macd(source)},
{rsi('mc', 'rs')},
{atr('rs', 'ar')},
{bollinger('ar', 'bo')},
{name}_all AS (
  SELECT *, close / {lag('close')} - 1 AS ret_1, close / {lag('close', 5)} - 1 AS ret_5, close / {lag('close', 20)} - 1 AS ret_20,
    close / {roll('avg', 'close', 5)} AS ma5_ratio, close / {roll('avg', 'close', 20)} AS ma20_ratio, {w} / nullif(bb_mid, 0) AS bb_width,
    (close - bb_lower) / {w} AS bb_pos, volume / nullif({roll('avg', 'volume', 20)}, 0) AS vol_ratio,
    CASE WHEN lead(close, 5) OVER ({W}) / close - 1 > 0.02::DOUBLE THEN 1 WHEN lead(close, 5) OVER ({W}) / close - 1 < -0.02::DOUBLE THEN -1 ELSE 0 END AS target
  FROM bo),
{name} AS (SELECT * FROM {name}_all WHERE ret_1 + ret_5 + ret_20 + ma5_ratio + ma20_ratio + rsi + macd + macd_hist + bb_width + bb_pos + vol_ratio + atr IS NOT NULL)"""


def last_bar(source: str, n: int = 1) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= {n}"


def regime(enter: str, leave: str, entry_wins: bool = False) -> str:
    first = f"WHEN {enter} THEN 1 WHEN {leave} THEN 0" if entry_wins else f"WHEN {leave} THEN 0 WHEN {enter} THEN 1"
    return f"coalesce(last_value(CASE {first} END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


def r(x: str, out: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {out}"
