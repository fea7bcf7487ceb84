"""Running medians of whole series. Spark gathers and sorts a sliding frame anew for every row; here a series meets in one
task, once for all medians wanted of it, and the window's values stay in order while days come and go, which
takes the logarithm of the window for each day. A task holds one series: some thousand days."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import KEYS, dealt


@dataclass(frozen=True)
class Running:
    """A centred median of `value`, null under `least` known values. The window holds `width` calendar days, or, where
    `rows` is set, so many known values whatever their days, and at most `span` days from its first to its last. Gaps between
    known medians of days are filled on their first `bridge` days by the line from one side to the other."""

    name: str
    value: str
    width: int
    least: int
    rows: bool = False
    span: int | None = None
    bridge: int | None = None

    def of(self, day: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of each row in order of days; NaN is unknown. Windows of rows have a median on rows with a value alone."""
        half = self.width // 2
        if not self.rows:
            got = _medians(values, np.searchsorted(day, day - half), np.searchsorted(day, day + half, "right"), self.least)
            return got if self.bridge is None else _bridged(day, got, self.bridge)
        known = np.flatnonzero(~np.isnan(values))
        at, n, out = np.arange(len(known)), len(known), np.full(len(values), np.nan)
        first, end = np.maximum(at - half, 0), np.minimum(at + half + 1, n)
        got = _medians(values[known], first, end, self.least)
        if self.span is not None and n:
            got[day[known[end - 1]] - day[known[first]] > self.span] = np.nan
        out[known] = got
        return out


class _Bounds(BaseIndexer):
    """Windows from their bounds, both of which only rise."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first.astype(np.int64), self.end.astype(np.int64)


def _medians(values: np.ndarray, first: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    if not len(values):
        return np.full(0, np.nan)
    return pd.Series(values).rolling(_Bounds(first=first, end=end), min_periods=least).median().to_numpy(copy=True)


def _bridged(day: np.ndarray, values: np.ndarray, days: int) -> np.ndarray:
    known, at = np.flatnonzero(~np.isnan(values)), np.flatnonzero(np.isnan(values))
    after = np.searchsorted(known, at)
    inner = (after > 0) & (after < len(known))
    at, p, q = at[inner], known[after[inner] - 1], known[after[inner]]
    near = day[at] - day[p] <= days
    at, p, q = at[near], p[near], q[near]
    values[at] = values[p] + (values[q] - values[p]) * ((day[at] - day[p]) / (day[q] - day[p]))
    return values


def with_running_medians(df: DataFrame, wanted: list[Running], keys=KEYS, rows: int | None = None) -> DataFrame:
    """df with a column for each of `wanted`, in one pass over each series (keys, date); every other column goes through as
    it is. Rows of one day are in each other's windows of days. A series of no rows has none; NaN and infinite values count as unknown. Where
    the number of `rows` is told, the result is dealt out by it, as Spark would else deal it in its own number of parts for what follows."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(w.name, T.DoubleType()) for w in wanted)])

    def work(table: pa.Table) -> pa.Table:
        day = table.column("date").cast(pa.int32()).to_numpy().astype(np.int64)
        order = np.argsort(day, kind="stable")
        table, day = table.take(pa.array(order)), day[order]
        for w in wanted:
            values = table.column(w.value).to_numpy().astype(float)
            got = w.of(day, np.where(np.isfinite(values), values, np.nan))
            table = table.append_column(w.name, pa.array(got, pa.float64(), from_pandas=True))
        return table

    if not rows:
        return df.groupBy(*keys).applyInArrow(work, schema)
    return dealt(dealt(df, keys, rows).groupBy(*keys).applyInArrow(work, schema), keys, rows)
