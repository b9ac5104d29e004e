"""Exact statistics of the last n rows of a series, for windows of any width.

Spark makes a frame's aggregates anew for each row, row by row. For wide windows
they are made here from whole blocks of windows at once: rows stream through in
Arrow batches, and a series keeps its last n - 1 rows from batch to batch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import by_time, last_rows, schema_of

#: Windows of at most so many rows stay Spark's.
NARROW = 24
#: Numbers of windows that are held at a time.
_HELD = 1 << 17


class Window:
    """The values of the last n rows, sorted, for rows that come one by one. Nulls and nans take a row's place but are no values."""

    def __init__(self, n: int, q: float):
        self.n, self.q = n, q
        self.rows: deque = deque()
        self.held: list[float] = []

    def push(self, x: float | None) -> float | None:
        """Takes a row in and gives the quantile, interpolated between the two nearest values; None without values."""
        if x is not None and x != x:
            x = None
        if len(self.rows) == self.n:
            old = self.rows.popleft()
            if old is not None:
                del self.held[bisect_left(self.held, old)]
        self.rows.append(x)
        if x is not None:
            insort(self.held, x)
        if not self.held:
            return None
        place = (len(self.held) - 1) * self.q
        low = int(place)
        a = self.held[low]
        if low == place:
            return a
        b = self.held[low + 1]
        return a if a == b else (low + 1 - place) * a + (place - low) * b


def _quantile(w: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    w = np.sort(w, axis=1)  # nans last
    place = np.maximum(count - 1, 0) * q
    low = place.astype(np.int64)
    every = np.arange(len(w))
    a, b = w[every, low], w[every, np.minimum(low + 1, w.shape[1] - 1)]
    return np.where((low == place) | (a == b), a, (low + 1 - place) * a + (place - low) * b)


def _of(w: np.ndarray, kind: str, q: float, whole: bool = False) -> np.ndarray:
    """A statistic of each row of w, nans left out; nan where it cannot be told. whole: there are no nans, and more than one column."""
    if whole:
        if kind == "quantile":
            return _quantile(w, np.full(len(w), w.shape[1]), q)
        if kind in ("var_samp", "stddev_pop"):
            d = w - w.mean(axis=1)[:, None]
            squares = np.einsum("ij,ij->i", d, d)
            return squares / (w.shape[1] - 1) if kind == "var_samp" else np.sqrt(squares / w.shape[1])
        return {"min": np.min, "max": np.max, "sum": np.sum, "avg": np.mean}[kind](w, axis=1)
    good = ~np.isnan(w)
    count = good.sum(axis=1)
    if kind == "quantile":
        return np.where(count > 0, _quantile(w, count, q), np.nan)
    if kind in ("min", "max"):
        x = np.where(good, w, np.inf if kind == "min" else -np.inf)
        return np.where(count > 0, x.min(axis=1) if kind == "min" else x.max(axis=1), np.nan)
    some = np.maximum(count, 1)
    total = np.where(good, w, 0.0).sum(axis=1)
    if kind == "sum":
        return np.where(count > 0, total, np.nan)
    mean = total / some
    if kind == "avg":
        return np.where(count > 0, mean, np.nan)
    squares = (np.where(good, w - mean[:, None], 0.0) ** 2).sum(axis=1)
    if kind == "var_samp":
        return np.where(count > 1, squares / np.maximum(count - 1, 1), np.nan)
    return np.where(count > 0, np.sqrt(squares / some), np.nan)


_SPARK = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "var_samp": F.var_samp, "stddev_pop": F.stddev_pop}


def rolled(x: np.ndarray, n: int, kind: str, q: float = 0.5) -> np.ndarray:
    """The statistic of each n consecutive numbers of x, in the order of the last of them."""
    if len(x) < n:
        return np.empty(0)
    windows, step = sliding_window_view(x, n), max(_HELD // n, 1)
    lacks = np.flatnonzero(np.isnan(x))
    begin = int(lacks[-1]) + 1 if len(lacks) else 0  # windows from here on are whole
    cuts = sorted({min(begin, len(windows)), *range(0, len(windows), step), len(windows)})
    return np.concatenate([_of(windows[a:b], kind, q, a >= begin and n > 1) for a, b in zip([0, *cuts[1:-1]], cuts[1:], strict=True)])


def _run(wanted: list[tuple], columns: int):
    widest = max(n for _, n, *_ in wanted)
    names = list(dict.fromkeys(c for c, *_ in wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(batch.column(columns).to_numpy(zero_copy_only=False))
            if tail is None and (not len(starts) or starts[0]):
                raise ValueError("a series is cut between tasks")
            edges = np.unique(np.concatenate(([0], starts, [batch.num_rows])))
            values = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names}
            parts: list[list] = [[] for _ in wanted]
            fresh = {c: np.full(widest - 1, np.nan) for c in names}
            new = set(starts.tolist())
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                before = fresh if a in new else tail
                own = {c: np.concatenate((before[c], values[c][a:b])) for c in names}
                for out, (c, n, kind, q) in zip(parts, wanted, strict=True):
                    out.append(rolled(own[c][widest - n :], n, kind, q))
                tail = {c: own[c][len(own[c]) - widest + 1 :] for c in names}
            out = [pa.array(np.concatenate(p), from_pandas=True) for p in parts]
            yield pa.record_batch([*batch.columns[:columns], *out], names=[*batch.schema.names[:columns], *[f"q{k}" for k in range(len(out))]])

    return run


def with_rolling(df: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """df with, for each name, a statistic of a double column's last n rows of the symbol: (column, n, kind), or (column, n, 'quantile', q).

    Kinds are avg, sum, min, max, var_samp, stddev_pop and quantile, each of the
    values that are not null (wide windows leave nans out too). Wide windows share
    one pass, which takes the rows as the sort by symbol and time leaves them.
    """
    wanted = {k: (*x, 0.5)[:4] for k, x in wanted.items()}
    wide = {k: x for k, x in wanted.items() if x[1] > NARROW}
    narrow = {k: (F.percentile(c, q) if kind == "quantile" else _SPARK[kind](c)).over(last_rows(n)) for k, (c, n, kind, q) in wanted.items() if n <= NARROW}
    df = df.withColumns(narrow) if narrow else df
    if wide:
        rows = df.withColumn("__first", F.row_number().over(by_time()) == 1).sortWithinPartitions("symbol", "ts")
        df = rows.mapInArrow(_run(list(wide.values()), len(df.columns)), schema_of(df, **dict.fromkeys(wide, "double")))
    return df


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str, int, float]]) -> DataFrame:
    """df with, for each name, the quantile q of a double column's last n rows of the symbol, given as (column, n, q)."""
    return with_rolling(df, {k: (c, n, "quantile", q) for k, (c, n, q) in wanted.items()})
