"""Many rules at once, rules against random walks, and the merge of their summaries."""

import hashlib
import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.functions import rules
from tallow.functions.columns import keyed, unkeyed
from tallow.operators import population, strategy
from tallow.plans import guardrail
from tallow.sources.candles import random_walk

RULES = ["a", "b * -1", "GT(a, b)", "div(a, b)", "0", "AND(a, b) * -1 + 0.5", "tanh(a + b)"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("walk") / "d")
    d = random_walk(spark, 3, 300).select("symbol", "ts", (F.col("close") - F.col("open")).alias("a"), (F.col("volume") - 1).alias("b"))
    d.withColumn("a", F.when(F.rand(1) > 0.02, F.col("a"))).write.parquet(path)
    return spark.read.parquet(path)


def test_the_normal_distribution(spark):
    z = [-40.0, -9.0, -8.2, -3.0, -1e-9, 0.0, 0.5, 1.0, 2.2, 6.0, 8.2, 9.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", strategy.normal_cdf("z").alias("c")).collect()
    assert max(abs(r.c - NormalDist().cdf(r.z)) for r in got) < 1e-14
    assert spark.range(1).select(strategy.normal_cdf(F.lit(None).cast("double"))).first()[0] is None


@pytest.mark.parametrize("test_blocks", [1, 2])
def test_a_population_is_its_rules_one_by_one(rows, test_blocks):
    ret = rows.select("symbol", "ts", (F.col("a") / 100).alias("ret"))
    options = {"splits": 4, "test_blocks": test_blocks, "min_trades": 5}
    got = population.assessed(rows, ret, RULES, 0.5, 1.0, **options)
    assert got.where("dsr is not null").count() > 5
    ranked = population.ranked(got).toPandas()
    assert (ranked.sort_values(["symbol", "place"]).groupby("symbol").fitness.diff().dropna() <= 0).all()
    got = got.toPandas()
    for k, text in enumerate(RULES):
        alone = strategy.evaluated(rules.with_signal(rows, text).select("symbol", "ts", "signal"), ret, **options)
        want = strategy.fitness(alone, 0.5, 1.0).toPandas().sort_values("symbol")
        own = got[got.rule == k].sort_values("symbol")[want.columns]
        assert own.symbol.tolist() == want.symbol.tolist()
        for c in want.columns[1:]:
            assert np.allclose(own[c].astype(float), want[c].astype(float), equal_nan=True, rtol=1e-8, atol=1e-10), (text, c)


def test_a_population_without_costs(rows):
    ret = rows.select("symbol", "ts", (F.col("a") / 100).alias("ret"))
    got = population.assessed(rows, ret, RULES, evaluator=population.unpriced).toPandas()
    for k, text in enumerate(RULES):
        alone = rules.with_signal(rows, text).select("symbol", "ts", "signal").join(ret, ["symbol", "ts"]).toPandas().sort_values(["symbol", "ts"])
        for symbol, x in alone.groupby("symbol"):
            own = got[(got.rule == k) & (got.symbol == symbol)].iloc[0]
            gain = x.signal * x.ret.fillna(0.0)
            assert own.turnover == pytest.approx(x.signal.diff().abs().mean()) and own.breadth == pytest.approx((gain > 0).mean())
            assert own.fitness == (pytest.approx(gain.mean() / gain.std(ddof=0)) if x.signal.std(ddof=0) else -math.inf)


def test_ratios_of_more_than_a_thousand_folds(spark):
    """13 blocks by 6 are 1716 folds."""
    hour, rng = 3_600_000_000, np.random.default_rng(3)
    ret = rng.normal(0.02, 0.1, 130)
    signal = np.where(np.arange(130) % 3 == 0, 0.0, 1.0)
    s = spark.createDataFrame([("S", hour * k, float(x), float(r)) for k, (x, r) in enumerate(zip(signal, ret))], "symbol string, ts long, signal double, ret double").coalesce(1)
    got = strategy.evaluated(s.select("symbol", "ts", "signal"), s.select("symbol", "ts", "ret"), splits=13, test_blocks=6, min_trades=1).first()
    assert got.dsr_z == pytest.approx(got.psr_z - NormalDist().inv_cdf(1 - 1 / 1716)) and got.dsr == pytest.approx(NormalDist().cdf(got.dsr_z))
    assert strategy.evaluated(s.select("symbol", "ts", "signal"), s.select("symbol", "ts", "ret"), trials=3200, min_trades=1).first().dsr_z == pytest.approx(got.psr_z - NormalDist().inv_cdf(1 - 1 / 3200))


def test_walks_follow_from_hashes(spark):
    candles = spark.createDataFrame([("A", k) for k in range(25)] + [("B", 0)], "symbol string, ts long")
    got = guardrail.walks(candles, 2)
    n = {(r.symbol, r.run): r.n for r in got.groupBy("symbol", "run").agg(F.count("*").alias("n")).collect()}
    assert n == {("A", 1): 25, ("A", 2): 25, ("B", 1): 10, ("B", 2): 10}
    uniform = lambda *p: (int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    normal = lambda *p: math.sqrt(-2 * math.log(uniform(*p, "a"))) * math.cos(2 * math.pi * uniform(*p, "b"))
    close = 100 * np.exp(np.cumsum([0.01 * normal("r", "A", 2, k) for k in range(25)]))
    own = got.where("symbol = 'A' and run = 2").orderBy("ts").toPandas()
    assert np.allclose(own.close, close) and np.allclose(own.open, [100, *close[:-1]]) and (own.high >= own[["open", "close"]].max(axis=1)).all() and (own.low <= own[["open", "close"]].min(axis=1)).all()
    assert own.volume.iloc[3] == pytest.approx(math.exp(0.1 * normal("v", "A", 2, 3))) and own.ts.iloc[1] - own.ts.iloc[0] == 60_000_000
    assert got.repartition(7).exceptAll(guardrail.walks(candles.repartition(3), 2)).isEmpty()


def test_keys_of_several_columns(spark):
    df = spark.createDataFrame([("A", 1, 2.0)], "symbol string, run int, x double")
    assert unkeyed(keyed(df, "symbol", "run")).collect() == df.collect()


SCORED = "symbol string, run int, rule int, expression string, fitness double, trade_count long"


def scored(spark):
    inf = -math.inf
    rows = [("A", 0, 0, "x", 0.2, 50), ("A", 0, 1, "y", 0.8, 50), ("A", 0, 2, "z", 0.9, 50), ("B", 0, 0, "x", 0.9, 10), ("C", 0, 0, "x", inf, 90), ("D", 0, 0, "x", 0.8, 40)]
    rows += [("A", r, 0, "x", 5.0, 40) for r in (1, 2)] + [("A", 1, 1, "y", 0.7, 60), ("A", 2, 1, "y", 0.65, 99), ("A", 3, 1, "y", inf, 99), ("A", 1, 2, "z", 3.0, 60), ("A", 2, 2, "z", 3.0, 60)]
    rows += [("B", r, 0, "x", 0.9, 40) for r in (1, 2)] + [("C", r, 0, "x", 0.1, 40) for r in (1, 2)] + [("D", 1, 0, "x", 0.7, 81), ("D", 2, 0, "x", 0.7, 29), ("D", 3, 0, "x", 0.7, 40)]
    return spark.createDataFrame(rows, SCORED)


def test_rules_are_held_against_runs(spark):
    against = guardrail.held_against(scored(spark))
    got = {(r.symbol, r.rule): r for r in against.collect()}
    assert {k: (r.hits, r.runs, r.leak) for k, r in got.items()} == {("A", 0): (2, 2, False), ("A", 1): (2, 2, True), ("A", 2): (2, 2, True), ("B", 0): (0, 2, False), ("C", 0): (0, 2, False), ("D", 0): (1, 3, False)}
    checks = {r.symbol: r for r in guardrail.checks(against).collect()}
    a = checks["A"]
    assert a.flagged and a.leak_rule.rule == 1 and a.leak_rule.expression == "y" and a.leak_rule.ratio_max == pytest.approx(0.7 / 0.8) and a.leak_rule.synthetic_mean == pytest.approx(0.675)
    assert (a.synthetic_max_positive_fitness, a.synthetic_max_overall_fitness, a.real_best_fitness) == (5.0, 5.0, 0.9)
    b, c = checks["B"], checks["C"]
    assert not b.flagged and b.leak_rule is None and b.synthetic_max_positive_fitness is None and b.synthetic_max_overall_fitness == 0.9 and c.real_best_fitness is None


def test_flagged_rules_are_checked_again(spark):
    summary = guardrail.checks(guardrail.held_against(scored(spark)))
    more = spark.createDataFrame([("A", 0, 0, "y", 0.8, 50), ("A", 1, 0, "y", 0.7, 60), ("A", 2, 0, "y", 0.1, 60)], SCORED)
    got = {r.symbol: r for r in guardrail.rechecked(summary, guardrail.held_against(more)).collect()}
    a = got["A"]
    assert a.flagged_initial and not a.flagged and a.post_guard_passed and a.post_guard_hits == 1 and a.post_guard_max_positive_fitness == 0.7 and a.post_guard_runs == 50
    assert got["B"].post_guard_passed is None and got["B"].post_guard_error is None and not got["B"].flagged
    few = spark.createDataFrame([("A", 0, 0, "y", 0.8, 5), ("A", 1, 0, "y", 0.7, 60)], SCORED)
    a = {r.symbol: r for r in guardrail.rechecked(summary, guardrail.held_against(few)).collect()}["A"]
    assert a.post_guard_error == "insufficient_real_trades" and a.flagged and a.post_guard_passed is None
    assert {r.symbol: r.post_guard_error for r in guardrail.rechecked(summary, guardrail.held_against(more.where("false"))).collect()}["A"] == "missing_expression"


def test_summaries_are_merged(spark, tmp_path):
    files = [
        {"symbol": "A", "month": "2024-01", "flagged": True, "flagged_initial": True, "post_guard_passed": False, "synthetic_max_positive_fitness": 0.4, "synthetic_max_overall_fitness": 0.9, "post_guard_max_positive_fitness": 0.6},
        {"symbol": "B", "month": "2024-01", "flagged": False, "flagged_initial": True, "post_guard_passed": True, "synthetic_max_positive_fitness": None, "synthetic_max_overall_fitness": -0.5},
        {"symbol": "C", "month": "2024-01", "flagged": False, "synthetic_max_positive_fitness": math.inf, "synthetic_max_overall_fitness": -math.inf, "real_best_fitness": math.nan, "leak_rule": {"runs": 5}},
    ]
    for k, x in enumerate(files):
        (tmp_path / f"s{k}" / "m").mkdir(parents=True)
        (tmp_path / f"s{k}" / "m" / f"synthetic_check_{k}.json").write_text(json.dumps(x, indent=2))
    (tmp_path / "s0" / "m" / "synthetic_check_bad.json").write_text("{no json")
    rows = guardrail.read_checks(spark, f"{tmp_path}/*/*/synthetic_check_*.json")
    assert {r.symbol: r.synthetic_max_positive_fitness for r in rows.collect()} == {"A": 0.4, "B": None, "C": None}
    want = {"count": 3, "initial_flagged": 2, "final_flagged": 1, "post_guard_passed": 1, "post_guard_failed": 1, "post_guard_pending": 1, "max_positive_fitness": 0.4, "max_overall_fitness": 0.9, "post_guard_max_positive_fitness": 0.6}
    assert guardrail.merged_checks(rows).first().asDict() == want
    plain = rows.where("symbol <> 'A'").withColumns({"flagged_initial": F.lit(None).cast("boolean"), "post_guard_passed": F.lit(None).cast("boolean")})
    got = guardrail.merged_checks(plain.withColumn("flagged", F.lit(True))).first()
    assert (got.initial_flagged, got.post_guard_pending, got.max_positive_fitness) == (2, 0, 0.0)
    none = guardrail.merged_checks(rows.where("false")).first().asDict()
    assert set(none.values()) == {0}


def test_a_guardrail_over_walks(spark):
    candles = random_walk(spark, 2, 900, seed=9)
    got = guardrail.assessed(candles, ["direction", "w3_ret_z * -1"], guardrail.GuardRules(runs=2, min_trades=3, trials=None), target_seconds=600, windows=(3,))
    assert {(r.symbol, r.run, r.rule) for r in got.select("symbol", "run", "rule").collect()} == {(s, k, j) for s in ("S0", "S1") for k in range(3) for j in range(2)}
    assert guardrail.checks(guardrail.held_against(got)).count() == 2
