"""Guardrails against chance: rules judged on real prices and on random walks, all in one plan.

A walk is a series of its own beside its symbol's real one: symbol and run are
packed into the key, run 0 is real, and bars, features, labels, signals and
evaluation work over all of them together. Walks come from hashes of symbol, run
and place, so any engine can repeat them, and rows may be made anew anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import keyed, unkeyed
from ..operators import population
from . import research

START_US = 946_684_800_000_000


@dataclass(frozen=True)
class GuardRules:
    runs: int = 5
    min_trades: int = 30
    #: A run counts against a rule from this fitness on, and from this share of the real one.
    threshold: float = 0.3
    ratio: float = 0.75
    #: It may have so many times the real trades.
    trade_ratio: float = 2.0
    #: So many runs against a rule of this real fitness are a leak.
    hits: int = 2
    least_fit: float = 0.5
    turnover_weight: float = 0.5
    breadth_weight: float = 1.0
    splits: int = 3
    #: Trials that the deflated ratio allows for; the number of folds if none.
    trials: int | None = 64


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from the md5 of the parts, joined by '|'."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("a")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def walks(candles: DataFrame, runs: int, step: int = 60_000_000, start: float = 100.0) -> DataFrame:
    """(symbol, run, ts, open .. volume): for each symbol so many geometric random walks, as long as its series (10 at least); runs from 1 on."""
    jobs = candles.groupBy("symbol").agg(F.greatest(F.count("*"), F.lit(10)).alias("n"))
    jobs = jobs.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).repartition("symbol", "run")
    rows = jobs.select("symbol", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    own, w = (F.col("symbol"), F.col("run"), F.col("k")), Window.partitionBy("symbol", "run").orderBy("k")
    rows = rows.withColumn("close", start * F.exp(F.sum(normal(F.lit("r"), *own) * 0.01).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(start)))
    high, low = F.greatest("open", "close") * (1 + 0.005 * uniform(F.lit("h"), *own)), F.least("open", "close") * (1 - 0.005 * uniform(F.lit("l"), *own))
    return rows.select("symbol", "run", (START_US + F.col("k") * step).alias("ts"), "open", high.alias("high"), low.alias("low"), "close", F.exp(normal(F.lit("v"), *own) * 0.1).alias("volume"))


def assessed(candles: DataFrame, expressions: list[str], rules: GuardRules = GuardRules(), step: int = 60_000_000, **plan) -> DataFrame:
    """(symbol, run, rule, expression, metrics .., fitness): each rule over each symbol's real series (run 0) and its walks. plan: options of research.research."""
    real = candles.select("symbol", F.lit(0).alias("run"), "ts", "open", "high", "low", "close", "volume")
    series = keyed(real.unionByName(walks(candles, rules.runs, step)), "symbol", "run")
    made = research.research(series, **plan)
    returns = made.labels.select("symbol", "ts", F.col("realized_return").alias("ret"))
    names = [c for c in made.features.columns if c not in ("symbol", "ts", "bar_id")]
    out = population.assessed(made.features, returns, expressions, rules.turnover_weight, rules.breadth_weight, names, splits=rules.splits, min_trades=rules.min_trades, trials=rules.trials)
    return unkeyed(out)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _hit(rules: GuardRules, fit: Column, trades: Column, real_fit: Column, real_trades: Column) -> Column:
    """Whether a run does nearly as well as the real series."""
    return _finite(fit) & (trades >= rules.min_trades) & (fit >= rules.threshold) & (real_fit > 0) & (fit / real_fit >= rules.ratio) & (trades / F.greatest(real_trades, F.lit(1)) <= rules.trade_ratio)


def held_against(scored: DataFrame, rules: GuardRules = GuardRules()) -> DataFrame:
    """(symbol, rule, expression, real_fitness, real_trades, synthetic_mean, synthetic_max, hits, runs, best_run_fitness, leak) from assessed rows: each rule against its runs."""
    real = scored.where("run = 0").select("symbol", "rule", "expression", F.col("fitness").alias("real_fitness"), F.col("trade_count").alias("real_trades"))
    runs = scored.where("run > 0").select("symbol", "rule", "fitness", "trade_count").join(real, ["symbol", "rule"])
    fit, known = F.col("fitness"), _finite(F.col("fitness"))
    hit = _hit(rules, fit, F.col("trade_count"), F.col("real_fitness"), F.col("real_trades"))
    sums = runs.groupBy("symbol", "rule").agg(
        F.avg(F.when(known, fit)).alias("synthetic_mean"), F.max(F.when(known, fit)).alias("synthetic_max"), F.count_if(hit).alias("hits"), F.count_if(known).alias("runs"), F.max(F.when(hit, fit)).alias("hit_max"), F.avg(F.when(hit, fit)).alias("hit_mean"),
    )
    out = real.join(sums, ["symbol", "rule"], "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "runs": F.coalesce("runs", F.lit(0))})
    judged = _finite(F.col("real_fitness")) & (F.col("real_fitness") > 0) & (F.col("real_trades") >= rules.min_trades)
    return out.withColumn("judged", judged).withColumn("leak", judged & (F.col("hits") >= rules.hits) & (F.col("real_fitness") >= rules.least_fit))


def checks(against: DataFrame, rules: GuardRules = GuardRules()) -> DataFrame:
    """A row for each symbol of held_against rows: the best real fitness, the walks' maxima, the first rule that leaks, and whether there is one.

    synthetic_max_positive_fitness is over the rules that are judged, up to the
    first that leaks; synthetic_max_overall_fitness over all.
    """
    leak = F.struct("rule", "expression", "real_fitness", "synthetic_mean", "synthetic_max", F.col("hits").alias("hits_above_threshold"), (F.col("synthetic_max") / F.col("real_fitness")).alias("ratio_max"), "runs")
    first = against.withColumn("first", F.min(F.when(F.col("leak"), F.col("rule"))).over(Window.partitionBy("symbol")))  # a row for each rule
    upto = F.col("judged") & (F.col("rule") <= F.coalesce("first", F.col("rule")))
    out = first.groupBy("symbol").agg(
        F.max(F.when(_finite(F.col("real_fitness")), F.col("real_fitness"))).alias("real_best_fitness"), F.max(F.when(upto, F.col("synthetic_max"))).alias("synthetic_max_positive_fitness"), F.max("synthetic_max").alias("synthetic_max_overall_fitness"),
        F.min_by(leak, F.when(F.col("leak"), F.col("rule"))).alias("leak_rule"), F.coalesce(F.max("leak"), F.lit(False)).alias("flagged"),
    )
    leaks = F.when(F.col("flagged"), F.col("leak_rule"))
    return out.select("symbol", "real_best_fitness", "synthetic_max_positive_fitness", "synthetic_max_overall_fitness", F.lit(rules.runs).alias("synthetic_runs"), F.lit(rules.hits).alias("threshold_hits_required"), leaks.alias("leak_rule"), "flagged")


def rechecked(summary: DataFrame, against: DataFrame, rules: GuardRules = GuardRules(runs=50)) -> DataFrame:
    """summary rows of checks with flagged_initial, the verdict of more runs on each symbol's leaking rule, and post_guard_passed; held_against rows of those runs are joined by symbol and expression.

    A symbol that was not flagged keeps its row, with null post_guard columns; one
    whose rule has too few real trades has post_guard_error instead of a verdict.
    """
    own = against.select("symbol", "expression", "real_fitness", "real_trades", F.col("hits").alias("post_guard_hits"), F.col("hit_max").alias("post_guard_max_positive_fitness"), F.col("hit_mean").alias("post_guard_mean_positive_fitness"))
    df = summary.withColumn("expression", F.col("leak_rule.expression")).join(own, ["symbol", "expression"], "left")
    few = F.col("flagged") & (F.col("real_trades") < rules.min_trades)
    error = F.when(F.col("flagged") & F.col("real_trades").isNull(), "missing_expression").when(few, "insufficient_real_trades")
    passed = F.when(F.col("flagged") & error.isNull(), F.col("post_guard_hits") < rules.hits)
    df = df.withColumns({"flagged_initial": F.col("flagged"), "post_guard_error": error, "post_guard_passed": passed})
    df = df.withColumn("flagged", F.when(F.col("post_guard_passed").isNotNull(), ~F.col("post_guard_passed")).otherwise(F.col("flagged")))
    told = F.col("post_guard_passed").isNotNull()
    post = {c: F.when(told, F.col(c)) for c in ("post_guard_hits", "post_guard_max_positive_fitness", "post_guard_mean_positive_fitness")} | {"post_guard_real_fitness": F.when(told, F.col("real_fitness")), "post_guard_runs": F.when(told, rules.runs)}
    return df.withColumns(post).drop("expression", "real_fitness", "real_trades")


#: What the merge reads of a summary file.
_FILE = "symbol string, month string, real_best_fitness double, flagged boolean, flagged_initial boolean, post_guard_passed boolean, synthetic_max_positive_fitness double, synthetic_max_overall_fitness double, post_guard_max_positive_fitness double"


def read_checks(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Summary files, one JSON object each, as rows with path; NaN and Infinity count as null, files that do not parse are left out."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    clean = F.regexp_replace("value", r'(?<=[:\[,\s])-?(?:NaN|Infinity)(?=\s*[,}\]])', "null")
    rows = raw.withColumn("x", F.from_json(clean, f"{_FILE}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return rows.where("x is not null and x._corrupt is null").select("x.*", "path").drop("_corrupt")


def merged_checks(rows: DataFrame) -> DataFrame:
    """One row of counts and maxima over summaries: how many were flagged at first and in the end, and how the later runs ended.

    Where no summary has flagged_initial, flagged stands for it; without
    post_guard_passed at all nothing counts as pending. Maxima count nulls as 0.
    """
    top = lambda c: F.coalesce(F.max(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))
    any_initial, any_post = F.count("flagged_initial") > 0, F.count("post_guard_passed") > 0
    return rows.agg(
        F.count("*").alias("count"), F.when(any_initial, F.count_if("flagged_initial")).otherwise(F.count_if("flagged")).alias("initial_flagged"), F.count_if("flagged").alias("final_flagged"),
        F.count_if("post_guard_passed").alias("post_guard_passed"), F.count_if(~F.col("post_guard_passed")).alias("post_guard_failed"), F.when(any_post, F.count_if(F.col("post_guard_passed").isNull())).otherwise(0).alias("post_guard_pending"),
        top("synthetic_max_positive_fitness").alias("max_positive_fitness"), top("synthetic_max_overall_fitness").alias("max_overall_fitness"), top("post_guard_max_positive_fitness").alias("post_guard_max_positive_fitness"),
    )
