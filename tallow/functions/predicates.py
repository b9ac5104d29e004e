"""Candle predicates: each adds a boolean column, false wherever it cannot be told."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import by_time, full, last_rows, ratio

Predicate = Callable[..., DataFrame]
_REGISTRY: dict[str, Predicate] = {}
#: Predicates that read rows later than the one they judge.
LOOKAHEAD = {"PIVOT_HIGH", "PIVOT_LOW", "ROUND_LEVEL_PROXIMITY"}


def register(name: str, fn: Predicate) -> None:
    if name in _REGISTRY:
        raise KeyError(f"predicate {name} is registered already")
    _REGISTRY[name] = fn


def get(name: str) -> Predicate:
    if name not in _REGISTRY:
        raise KeyError(f"no predicate {name}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def with_fields(df: DataFrame) -> DataFrame:
    """Adds body, upper_wick, lower_wick, true_range and clv (null where the range is 0) unless there."""
    if "body" in df.columns:
        return df
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.withColumns({"body": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - lo, "true_range": h - lo, "clv": ratio(c - lo, h - lo)})


def per_atr(df: DataFrame, column: str, out: str, window: int = 14) -> DataFrame:
    """df with column over the rolling mean range, 0 where that is 0."""
    df = with_fields(df)
    return df.withColumn(out, F.coalesce(ratio(C(column), F.avg("true_range").over(last_rows(window))), F.lit(0.0)))


def evaluate(df: DataFrame, name: str, out: str, **params) -> DataFrame:
    """df with the predicate's verdict in column out."""
    return get(name)(with_fields(df), out, **params)


def evaluate_all(df: DataFrame, specs: list[tuple[str, dict]]) -> DataFrame:
    for k, (name, params) in enumerate(specs):
        df = evaluate(df, name, f"{name}__{k}", **params)
    return df


def _simple(build: Callable[..., Column]) -> Predicate:
    return lambda df, out, **params: df.withColumn(out, F.coalesce(build(**params), F.lit(False)))


def _before(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(by_time()) if k >= 0 else F.lead(x, -k).over(by_time())


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


C = F.col


def _wick(kind: str) -> Column:
    return C(f"{kind}_wick")


def _engulf(bull: bool) -> Column:
    o, c = _before("open"), _before("close")
    turned = (c < o) & (C("close") > C("open")) if bull else (c > o) & (C("close") < C("open"))
    return turned & (F.greatest("open", "close") >= F.greatest(o, c)) & (F.least("open", "close") <= F.least(o, c))


def _volume_anomaly(window: int = 20, threshold: float = 1.0) -> Column:
    w = last_rows(window)
    z = ratio(C("volume") - F.avg("volume").over(w), F.stddev_pop("volume").over(w))
    effort = ratio(C("true_range"), full(C("true_range"), F.avg("true_range").over(w), window))
    return F.coalesce(ratio(full(C("volume"), z, window), effort), F.lit(0.0)) >= threshold


def _pivot(x: str, sign: int, left: int = 2, right: int = 2) -> Column:
    here = sign * C(x)
    return _all([here > sign * _before(x, k) for k in range(1, left + 1)] + [here >= sign * _before(x, -k) for k in range(1, right + 1)])


def _round_level(df: DataFrame, out: str, tick=None, percent=None, step=None, base=None, atr_window: int = 20, tolerance: float = 0.2) -> DataFrame:
    """The grid is tick, else percent, else step, else chosen by symbol: one percent where the median close is above 1, else the least gap between closes."""
    for x in (tick, percent, step):
        if x is not None and x <= 0:
            raise ValueError("a grid must be positive")
    close, tiny = C("close"), F.lit(1e-12)
    first = F.lit(float(base)) if base else F.greatest(F.first("close").over(by_time().rowsBetween(Window.unboundedPreceding, 0)), tiny)
    geometric = lambda p: first * F.exp(F.rint(F.ln(F.greatest(F.greatest(close, tiny) / first, tiny)) / math.log(1.0 + p)) * math.log(1.0 + p))
    linear = lambda s: F.rint(close / s) * s
    if tick is not None or percent is None and step is not None:
        level = linear(F.lit(float(tick if tick is not None else step)))
    elif percent is not None:
        level = geometric(percent)
    else:
        gap = F.nullif(close - F.lag("close").over(Window.partitionBy("symbol").orderBy("close")), F.lit(0.0))
        grids = df.select("symbol", "close", gap.alias("gap")).groupBy("symbol").agg(F.percentile("close", 0.5).alias("__median"), F.coalesce(F.min("gap"), F.lit(1e-4)).alias("__gap"))
        df = df.join(grids, "symbol", "left")  # a row for each symbol
        level = F.when(F.col("__median") > 1, geometric(0.01)).otherwise(linear(F.col("__gap")))
    atr = full(C("true_range"), F.avg("true_range").over(last_rows(atr_window)), atr_window)
    df = df.withColumn(out, F.coalesce(ratio(F.abs(close - level), atr) <= tolerance, F.lit(False)))
    return df.drop("__gap", "__median")


register("LONG_LOWER_WICK", _simple(lambda threshold=1.5, kind="lower": F.coalesce(ratio(_wick(kind), C("true_range")), F.lit(0.0)) >= threshold))
register("RANGE_COMPRESSION", _simple(lambda window=5, quantile=0.2: C("true_range") <= full(C("true_range"), F.percentile("true_range", quantile).over(last_rows(window)), window)))
register("VOLUME_SPIKE", _simple(lambda window=20, quantile=0.8: C("volume") >= full(C("volume"), F.percentile("volume", quantile).over(last_rows(window)), window)))
register("CLOSE_ABOVE_PRIOR_LOW", _simple(lambda lag=1: C("close") > _before("low", lag)))
register("BREAK_ABOVE_RANGE", _simple(lambda lookback=10, eps=0.0: C("close") >= full(C("high"), F.max("high").over(by_time().rowsBetween(-lookback, -1)), lookback, by_time().rowsBetween(-lookback, -1)) + eps))
register("BREAK_BELOW_RANGE", _simple(lambda lookback=10, eps=0.0: C("close") <= full(C("low"), F.min("low").over(by_time().rowsBetween(-lookback, -1)), lookback, by_time().rowsBetween(-lookback, -1)) - eps))
register("HIGHER_LOW", _simple(lambda depth=2: _all([_before("low", k - 1) > _before("low", k) for k in range(1, depth + 1)])))
register("INSIDE_BAR", _simple(lambda: (C("high") < _before("high")) & (C("low") > _before("low"))))
register("OUTSIDE_BAR", _simple(lambda: (C("high") > _before("high")) & (C("low") < _before("low"))))
register("BULLISH_ENGULF", _simple(lambda: _engulf(True)))
register("BEARISH_ENGULF", _simple(lambda: _engulf(False)))
register("WICK_DOMINANCE", _simple(lambda kind="upper", **p: F.coalesce(ratio(_wick(kind), C("body")), F.lit(0.0)) >= p.get("ratio", 1.5)))
register("EVR_ANOMALY", _simple(_volume_anomaly))
register("PIVOT_HIGH", _simple(lambda left=2, right=2: _pivot("high", 1, left, right)))
register("PIVOT_LOW", _simple(lambda left=2, right=2: _pivot("low", -1, left, right)))
register("ROUND_LEVEL_PROXIMITY", _round_level)
