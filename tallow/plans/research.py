"""The research plan: candles to decision bars, labels, and features of each bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import bars, features, labels


@dataclass(frozen=True)
class ResearchPlan:
    bars: DataFrame
    mapping: DataFrame
    labels: DataFrame
    features: DataFrame


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], **defaults: object) -> DataFrame:
    """rows with table's other columns by a left join; what is not found takes the column's default, if one is named."""
    out = rows.join(table, on, "left")
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(x)) for c, x in defaults.items()})


def with_columns_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns; those it lacks are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def as_of_forward(left: DataFrame, right: DataFrame, value: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """left with value of the first row of right at or after each row's time: one sort of both together, no range join."""
    a = left.select("*", F.lit(0).alias("__r"), F.lit(None).cast(right.schema[value].dataType).alias(f"__{value}"))
    b = right.select(key, ts, F.lit(1).alias("__r"), F.col(value).alias(f"__{value}"))
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(f"__{value}", ignorenulls=True).over(w))
    return both.where("__r = 0").drop("__r", f"__{value}")


def bar_features(candles: DataFrame, decision: DataFrame, mapping: DataFrame, windows: tuple[int, ...] = (60, 120, 240, 360), bar_windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """A row for each bar: its candles' morphology rolled up, its time, its own morphology, and seed_{pattern} 0 or 1 of each seed pattern."""
    rolled = features.rollup(features.morphology(candles, windows), mapping)
    out = looked_up(rolled, decision.select("symbol", "bar_id", "ts"), ["symbol", "bar_id"])
    out = looked_up(out, features.morphology(decision, bar_windows), ["symbol", "ts"])
    seeds, names = decision, []
    for name, spec in patterns.SEEDS.items():
        seeds = patterns.evaluate(seeds, spec, f"seed_{name}")
        names.append(f"seed_{name}")
    seeds = seeds.select("symbol", "bar_id", *[F.col(c).cast("double").alias(c) for c in names])
    return looked_up(out, seeds, ["symbol", "bar_id"], **dict.fromkeys(names, 0.0))


def research(candles: DataFrame, method: str | None = "time", target_seconds: int = 14_400, windows: tuple[int, ...] = (60, 120, 240, 360), up: float = 2.0, down: float = 2.0) -> ResearchPlan:
    """All of it, lazily; method None chooses each symbol's bars by their median gap."""
    if method == "time":
        decision = bars.time_bars(candles, target_seconds)
        mapping = bars.time_mapping(candles, decision, target_seconds)
    elif method is None:
        decision = bars.chosen_bars(candles, target_seconds)
        mapping = as_of_forward(candles.select("symbol", F.col("ts")), decision.select("symbol", "ts", "bar_id"), "bar_id").where("bar_id is not null").withColumnRenamed("ts", "timestamp")
    else:
        decision = bars.event_bars(candles, method, target_seconds=target_seconds)
        mapping = bars.event_mapping(candles, method, target_seconds=target_seconds)
    labelled = labels.triple_barrier(labels.volatility(decision), up=up, down=down)
    labelled = labelled.withColumn("gross_return", F.col("realized_return"))
    return ResearchPlan(decision, mapping, labelled, bar_features(candles, decision, mapping, windows))


def supervised(plan: ResearchPlan) -> DataFrame:
    """features joined with the labels of the same bar time: (symbol, ts, features .., y, realized_return)."""
    return plan.features.join(plan.labels.select("symbol", "ts", "y", "realized_return"), ["symbol", "ts"])
