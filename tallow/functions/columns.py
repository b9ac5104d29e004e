"""Column helpers: guarded division, time-ordered windows, full-window guards. Times are epoch microseconds in column ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return by_time().rowsBetween(-(n - 1), 0)


def full(x: Column, value: Column, n: int, window: WindowSpec | None = None) -> Column:
    """value where the window of n rows holds n values of x, else null."""
    return F.when(F.count(x).over(window if window is not None else last_rows(n)) >= n, value)


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns packed into symbol: every operator that works by symbol then works by all of them."""
    return df.withColumn("symbol", F.struct(*names)).drop(*[c for c in names if c != "symbol"])


def unkeyed(df: DataFrame) -> DataFrame:
    """What keyed has packed, as columns again, first."""
    return df.select("symbol.*", *[c for c in df.columns if c != "symbol"])


def schema_of(df: DataFrame, *columns: str, **more: T.DataType | str) -> T.StructType:
    """The schema of df's named columns (all, if none is named) and of more: what a task function that passes df's columns on returns."""
    fields = [f for f in df.schema.fields if not columns or f.name in columns]
    return T.StructType([*fields, *[T.StructField(k, T.DataType.fromDDL(t) if isinstance(t, str) else t) for k, t in more.items()]])
