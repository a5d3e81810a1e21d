"""Runs registered queries against their oracle: python tests/compare.py SF_DIR [PREFIX...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _value(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "item"):
        return _value(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if isinstance(x, int):
        return float(x)
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x).replace("+00:00", "").removesuffix(" 00:00:00")


def rows(columns: list[str], data) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in at) for r in data), key=repr)


def _near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


def difference(spark, connection, function, sql: str, sf_dir: str) -> str | None:
    df = function(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    other = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(other):
        return f"{len(mine)} rows and {len(other)}"
    if not mine:
        return "no rows"
    wrong = [(x, y) for x, y in zip(mine, other, strict=True) if len(x) != len(y) or not all(map(_near, x, y))]
    return f"{len(wrong)} of {len(mine)} rows, as {sorted(names)} {wrong[0]}" if wrong else None


def main() -> None:
    import __spark_entry__
    from tidewell.session import session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = session("local[4]", 4)
    spark.sparkContext.setLogLevel("OFF")
    functions, oracles, connection = __spark_entry__.queries(), __spark_entry__.oracle_sql(), views(sf_dir)
    for name in functions:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                said = difference(spark, connection, functions[name], oracles[name], sf_dir) or "equal"
            else:
                said = f"rows only: {functions[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - reported, and the next query runs
            said = "error " + str(e).strip()[:900]
        print(f"{name} {time.time() - start:.1f}s {said}", flush=True)


if __name__ == "__main__":
    main()
