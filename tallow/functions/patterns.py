"""The pattern language: predicates combined by AND, OR, NOT, COUNT and SEQUENCE, compiled to boolean columns.

A pattern is a name or {"name", "params", "children"}. Every node becomes a
column in a projection of its own, so windows can stand over windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates
from .columns import by_time, last_rows

#: Seed patterns, fixed values.
SEEDS = {
    "stop_run_reclaim": {"name": "AND", "children": [{"name": "LONG_LOWER_WICK", "params": {"threshold": 0.4}}, {"name": "VOLUME_SPIKE", "params": {"window": 20, "quantile": 0.8}}, {"name": "CLOSE_ABOVE_PRIOR_LOW", "params": {"lag": 1}}]},
    "trend_pullback": {"name": "AND", "children": [{"name": "HIGHER_LOW", "params": {"depth": 2}}, {"name": "RANGE_COMPRESSION", "params": {"window": 5, "quantile": 0.2}}]},
}


@dataclass(frozen=True)
class Pattern:
    name: str
    params: dict = field(default_factory=dict)
    children: tuple[Pattern, ...] = ()


def parse(spec: dict | str) -> Pattern:
    if isinstance(spec, str):
        return Pattern(spec)
    return Pattern(spec["name"], dict(spec.get("params") or {}), tuple(map(parse, spec.get("children") or ())))


#: Rows of a window that a number holds, one bit each.
_BITS = 63


def _shifted(function: str, x: Column, by: Column) -> Column:
    return F.call_function(function, x, by.cast("int"))


def _sequence(df: DataFrame, masks: list[str], name: str, window: int | None = None, tolerance: int = 0) -> tuple[DataFrame, Column]:
    """Whether the masks hold one after another within the window, each at the first place it can, at most tolerance of them left out.

    A mask's window is numbers of 63 bits: row n has bit n mod 63, a frame's bits
    are turned so that its first row has bit 0, and the next place is the lowest
    bit from the last one on. Working columns begin with name.
    """
    size, full = max(window or len(masks), len(masks)), (1 << _BITS) - 1
    df = df.withColumn(f"{name}_n", F.row_number().over(by_time()).cast("long"))
    n, starts, one = F.col(f"{name}_n"), range(0, size, _BITS), F.lit(1).cast("long")
    bits = {}
    for k, m in enumerate(masks):
        for s in starts:
            frame = by_time().rowsBetween(s - size + 1, min(s - size + _BITS, 0))
            bits[f"{name}_{k}_{s}"] = F.bit_or(F.when(F.col(m), _shifted("shiftleft", one, n % _BITS)).otherwise(F.lit(0).cast("long"))).over(frame)
    df = df.withColumns(bits)
    turned = {}
    for k in range(len(masks)):
        for s in starts:
            x, by = F.coalesce(f"{name}_{k}_{s}", F.lit(0).cast("long")), F.pmod(n + (s - size + 1), F.lit(_BITS))
            turned[f"{name}_{k}_{s}"] = _shifted("shiftrightunsigned", x, by).bitwiseOR(_shifted("shiftleft", x, _BITS - by).bitwiseAND(full))
    df = df.withColumns(turned).withColumn(f"{name}_at", F.lit(0))
    at, missed = F.col(f"{name}_at"), F.lit(0)
    for k in range(len(masks)):
        places = []
        for s in starts:
            skip = F.when(at <= s, F.lit(full)).when(at >= s + _BITS, F.lit(0).cast("long")).otherwise(_shifted("shiftleft", F.lit(full), at - s).bitwiseAND(full))
            left = F.col(f"{name}_{k}_{s}").bitwiseAND(skip)
            lowest = left.bitwiseAND(F.bitwise_not(left - 1))
            places.append(F.when(left != 0, s + F.bit_count(lowest - 1)))
        df = df.withColumn(f"{name}_f{k}", F.coalesce(*places))
        found = F.col(f"{name}_f{k}")
        missed = missed + F.when(found.isNull(), 1).otherwise(0)
        df = df.withColumn(f"{name}_at{k}", F.coalesce(found + 1, at).cast("int"))
        at = F.col(f"{name}_at{k}")
    return df, missed <= max(tolerance, 0)


def evaluate(df: DataFrame, pattern: Pattern | dict | str, out: str, context: dict[str, str] | None = None) -> DataFrame:
    """df with the pattern's verdict in column out. context: names that stand for boolean columns of df."""
    steps, keep = count(), predicates.with_fields(df).columns

    def add(df: DataFrame, p: Pattern) -> tuple[DataFrame, str]:
        col = f"__p{next(steps)}"
        if context and p.name in context:
            return df.withColumn(col, F.coalesce(F.col(context[p.name]), F.lit(False))), col
        if p.name not in ("AND", "OR", "NOT", "SEQUENCE", "COUNT"):
            return predicates.evaluate(df, p.name, col, **p.params), col
        if not p.children:
            raise ValueError(f"{p.name} needs a child")
        masks = []
        for child in p.children:
            df, mask = add(df, child)
            masks.append(mask)
        cols = [F.col(m) for m in masks]
        if p.name == "AND":
            value = reduce(lambda a, b: a & b, cols)
        elif p.name == "OR":
            value = reduce(lambda a, b: a | b, cols)
        elif p.name == "NOT":
            value = ~cols[0]
        elif p.name == "COUNT":
            value = F.sum(cols[0].cast("int")).over(last_rows(p.params.get("window", 3))) >= p.params.get("threshold", 1)
        else:
            df, value = _sequence(df, masks, col, p.params.get("window"), p.params.get("tolerance", 0))
        return df.withColumn(col, value), col

    df, col = add(predicates.with_fields(df), pattern if isinstance(pattern, Pattern) else parse(pattern))
    return df.select(*[c for c in keep if c != out], F.col(col).alias(out))
