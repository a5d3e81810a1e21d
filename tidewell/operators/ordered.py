"""Ordered folds: work on the rows of each key in order, with a state carried along.

For recurrences that no window frame can express. Rows are partitioned by key and
sorted, by a window that spills; a task then streams them in Arrow batches and keeps one
state, so a key of any length needs the memory of one batch. A key is worked through by one task, as its
recurrence asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Segment = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


class RowStep:
    """A step for each row; a batch of many short keys is walked through once, without a frame for each key."""

    def __init__(self, step: Callable[[Any, Any], tuple[Any, tuple]], names: list[str]):
        self.step, self.names = step, names

    def walk(self, last: Any, state: Any, keys: list, rows: pd.DataFrame) -> tuple[Any, Any, list[tuple]]:
        out = []
        for key, row in zip(keys, rows.itertuples(index=False), strict=True):
            if key != last:
                last, state = key, None
            state, values = self.step(state, row)
            out.append(values)
        return last, state, out


def fold(df: DataFrame, keys: list[str], order: list[str], added: str, segment: Segment | RowStep) -> DataFrame:
    """df with the columns `added` (a DDL string).

    segment(state, rows) gets consecutive rows of one key, the state it returned for the
    rows before (None at a key's start), and returns the new state and the rows with the
    columns added. Rows with null keys are one key.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for rows in batches:
            if rows.empty:
                continue
            rows = rows.drop(columns="_nth")
            values = list(zip(*(rows[k].astype(object).where(rows[k].notna(), None) for k in keys), strict=True))
            if isinstance(segment, RowStep):
                last, state, added_values = segment.walk(last, state, values, rows)
                yield rows.assign(**{n: pd.Series([v[i] for v in added_values], index=rows.index, dtype=object) for i, n in enumerate(segment.names)})[names]
                continue
            starts = [0] + [i for i in range(1, len(values)) if values[i] != values[i - 1]] + [len(values)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if values[a] != last:
                    last, state = values[a], None
                state, out = segment(state, rows.iloc[a:b])
                yield out[names]

    # The number within the key is not used; its window keeps a key's rows in one task. A repartition does not: Spark drops it where the rows
    # are dealt by the keys already, and adaptive execution, which knows of no demand then, merges the partitions of a union's sides apart.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).mapInPandas(run, schema)


def ewm(df: DataFrame, smooth: dict[str, tuple[str, float] | Callable[[pd.DataFrame], pd.Series]], keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Exponential means: for each (output, (input, alpha)), y = (1 - alpha) * y_before + alpha * x.

    The first value of a key is its own mean; nulls before it give null, a later null
    keeps the mean. An output may be an input of later ones, and a function of the rows in
    between makes a column from them, so that chains need one pass and one shuffle.
    """

    def segment(state, rows):
        state, rows = dict(state or {}), rows.copy()
        for name, how in smooth.items():
            if callable(how):
                rows[name] = how(rows)
                continue
            source, alpha = how
            x = pd.to_numeric(rows[source], errors="coerce").astype("float64")
            before = state.get(name)
            y = (pd.concat([pd.Series([before]), x]) if before is not None else x).ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
            rows[name] = y.iloc[1:].to_numpy() if before is not None else y.to_numpy()
            if len(rows) and not np.isnan(rows[name].iloc[-1]):
                state[name] = float(rows[name].iloc[-1])
        return state, rows

    return fold(df, list(keys), list(order), ", ".join(f"{n} double" for n in smooth), segment)


def by_row(step: Callable[[Any, Any], tuple[Any, tuple]], names: list[str]) -> RowStep:
    """A fold from step(state, row) -> (state, values of the added columns)."""
    return RowStep(step, names)
