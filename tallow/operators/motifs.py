"""Frequent sets of predicates with support, purity and lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates


def _grown(sets: Column, items: Column) -> Column:
    """The sets of one item more: each with every later item."""
    return F.flatten(F.transform(sets, lambda s: F.transform(F.filter(items, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))


def mine(rows: DataFrame, items: list[str], label: str = "y", min_support: float = 0.01, min_lift: float = 1.1, max_size: int = 3, by: str | None = None) -> DataFrame:
    """(by.., name, items, direction, support, lift, purity) of the sets of boolean columns items that hold in min_support of the rows, of each key of column by if given.

    Rows are first counted by what holds in them, so that sets are made once for
    each combination of a key, not for each row, and only of items that are
    frequent for the key. All of it is one plan.
    """
    names, c = sorted(items), F.col
    held = F.array_compact(F.array(*[F.when(F.coalesce(c(f"`{x}`").cast("boolean"), F.lit(False)), k) for k, x in enumerate(names)]))
    counts = [F.sum(x).alias(x) for x in ("n", "up", "down")]
    kinds = rows.groupBy((c(f"`{by}`") if by else F.lit("")).alias("key"), held.alias("held")).agg(F.count("*").alias("n"), F.count_if(c(label) == 1).alias("up"), F.count_if(c(label) == -1).alias("down"))
    total = kinds.groupBy("key").agg(F.sum("n").alias("all_n"), F.sum("up").alias("all_up"), F.sum("down").alias("all_down"))  # a row for each key
    single = kinds.select("key", F.explode("held").alias("item"), "n").groupBy("key", "item").agg(F.sum("n").alias("n"))
    able = single.join(total, "key").where(c("n") / c("all_n") >= min_support).groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("able"))  # as many as items
    kinds = kinds.join(able, "key").withColumn("held", F.array_intersect("held", "able"))
    sets = [F.transform("held", lambda x: F.array(x))]
    for _ in range(1, max_size):
        sets.append(_grown(sets[-1], c("held")))
    found = kinds.select("key", F.explode(F.concat(*sets)).alias("set"), "n", "up", "down").groupBy("key", "set").agg(*counts).join(total, "key")
    found = found.withColumn("support", c("n") / c("all_n")).where(c("support") >= min_support)
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), c(good).alias("good"), F.when(c(f"all_{good}") > 0, c(f"all_{good}") / c("all_n")).otherwise(1e-6).alias("base")) for d, good in ((1, "up"), (-1, "down"))])
    found = found.select("key", "set", "support", "n", F.explode(sides).alias("x")).select("key", "set", "support", (c("x.good") / c("n")).alias("purity"), "x.direction", "x.base")
    found = found.withColumn("lift", c("purity") / c("base")).where((c("purity") > 0) & (c("lift") >= min_lift))
    named = F.transform("set", lambda k: F.get(F.array(*map(F.lit, names)), k))
    out = found.select("key", named.alias("items"), "direction", "support", "lift", "purity")
    out = out.select("key", F.concat(F.array_join("items", "_"), F.when(c("direction") > 0, "__LONG").otherwise("__SHORT")).alias("name"), "items", "direction", "support", "lift", "purity")
    return out.withColumnRenamed("key", by) if by else out.drop("key")


#: Predicates that motifs are made of unless others are named, fixed values.
DEFAULT_SPECS: list[tuple[str, dict]] = [
    ("LONG_LOWER_WICK", {"kind": "lower", "threshold": 0.3}),
    ("WICK_DOMINANCE", {"kind": "upper", "ratio": 1.5}),
    ("RANGE_COMPRESSION", {"window": 5, "quantile": 0.2}),
    ("VOLUME_SPIKE", {"window": 20, "quantile": 0.8}),
    ("BREAK_ABOVE_RANGE", {"lookback": 10, "eps": 0.0}),
    ("BREAK_BELOW_RANGE", {"lookback": 10, "eps": 0.0}),
    ("INSIDE_BAR", {}),
    ("OUTSIDE_BAR", {}),
    ("BULLISH_ENGULF", {}),
    ("BEARISH_ENGULF", {}),
    ("EVR_ANOMALY", {"window": 20, "threshold": 1.0}),
    ("ROUND_LEVEL_PROXIMITY", {"step": 0.01, "tolerance": 0.25}),
    ("PIVOT_HIGH", {"left": 2, "right": 2}),
    ("PIVOT_LOW", {"left": 2, "right": 2}),
]


def parsed_specs(document: dict | list | None) -> list[tuple[str, dict]]:
    """(name, params) of a configuration: the list under default, or the list itself; an entry is a name or {name, params}."""
    entries = document.get("default", document) if isinstance(document, dict) else document
    if entries is None:
        return DEFAULT_SPECS
    return [(e, {}) if isinstance(e, str) else (e["name"], dict(e.get("params") or {})) for e in entries]


def mine_bars(bars: DataFrame, labels: DataFrame, specs: list[tuple[str, dict]] | None = None, by: str | None = "symbol", on: str = "ts", masks_path: str | None = None, **options) -> DataFrame:
    """Motifs of the predicates' verdicts on bars, with labels (symbol, on, y) joined and 0 where a bar has none.

    The verdicts are windows; with masks_path they are written there once, so
    that a level of the mining reads booleans.
    """
    specs = DEFAULT_SPECS if specs is None else specs
    names = [f"{name}__{k}" for k, (name, _) in enumerate(specs)]
    rows = predicates.evaluate_all(bars, specs).select("symbol", on, *names)
    rows = rows.join(labels.select("symbol", on, F.col("y").alias("__y")), ["symbol", on], "left").withColumn("__y", F.coalesce("__y", F.lit(0)))
    if masks_path:
        rows.write.mode("overwrite").parquet(masks_path)
        rows = rows.sparkSession.read.parquet(masks_path)
    return mine(rows, names, "__y", by=by, **options)
