import json
import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tallow.functions import patterns, predicates, rolling, rules
from tallow.functions.columns import keyed, last_rows
from tallow.operators import bars, evaluation, features, fees, labels, motifs, nulls, prototypes, strategy
from tallow.plans import research
from tallow.sources import files
from tallow.sources.candles import between, random_walk, read_klines, write_candles

MINUTE = 60_000_000


def candles(spark, closes, highs=None, lows=None, opens=None, volumes=None):
    n = len(closes)
    rows = zip(["S"] * n, [MINUTE * k for k in range(n)], opens or closes, highs or closes, lows or closes, closes, volumes or [1.0] * n, strict=True)
    return spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "symbol string, ts long, open double, high double, low double, close double, volume double")


def hits(df, column="hit"):
    return [r[column] for r in df.orderBy("ts").collect()]


def test_random_walk_is_a_candle(spark):
    df = random_walk(spark, 2, 50)
    assert df.count() == 100
    assert df.where("low > least(open, close) or high < greatest(open, close) or volume <= 0").isEmpty()


def test_klines_drop_headers_and_repeats(spark, tmp_path):
    (tmp_path / "ABC-1m-2024-01.csv").write_text("open_time,open,high,low,close,volume\n1000,1,2,0.5,1.5,10\n1000,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n2000,1.5,2,1,1.8,5\n")
    df = read_klines(spark, str(tmp_path / "*.csv"))
    assert [(r.symbol, r.ts, r.close) for r in df.orderBy("ts").collect()] == [("ABC", 1_000_000, 1.5), ("ABC", 2_000_000, 1.8)]
    assert between(df, start=1_500_000).count() == 1


def test_time_bars_close_on_the_right(spark):
    got = bars.time_bars(candles(spark, [1, 2, 3, 4]), 120).orderBy("bar_id").collect()
    assert [(r.ts, r.open, r.close, r.volume) for r in got] == [(0, 1, 1, 1), (2 * MINUTE, 2, 3, 2), (4 * MINUTE, 4, 4, 1)]


def test_event_bars_start_anew_at_the_threshold(spark):
    df = candles(spark, [1.0] * 6)
    got = bars.event_mapping(df, "dollar", target_seconds=120).orderBy("timestamp").collect()
    assert [r.bar_id for r in got] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        bars.event_mapping(df, "other")


def test_round_levels(spark):
    df = candles(spark, [100.0, 101.0, 100.5], highs=[100.5, 101.5, 101.0], lows=[99.5, 100.5, 100.0])
    assert hits(predicates.evaluate(df, "ROUND_LEVEL_PROXIMITY", "hit", percent=0.01, atr_window=1)) == [True, True, False]


def test_registry_refuses_repeats():
    assert len(predicates.names()) == 16
    with pytest.raises(KeyError):
        predicates.register("INSIDE_BAR", lambda df, out: df)
    with pytest.raises(KeyError):
        predicates.get("NONE")


def test_sequence_and_count(spark):
    df = candles(spark, [1, 2, 3, 4]).withColumn("a", F.col("close") == 2).withColumn("b", F.col("close") == 4)
    context = {"A": "a", "B": "b"}
    assert hits(patterns.evaluate(df, {"name": "SEQUENCE", "params": {"window": 3}, "children": ["A", "B"]}, "hit", context)) == [False, False, False, True]
    assert hits(patterns.evaluate(df, {"name": "SEQUENCE", "params": {"window": 2}, "children": ["A", "B"]}, "hit", context)) == [False, False, False, False]
    assert hits(patterns.evaluate(df, {"name": "COUNT", "params": {"window": 3, "threshold": 2}, "children": [{"name": "OR", "children": ["A", "B"]}]}, "hit", context))[-1]


def test_barriers(spark):
    df = candles(spark, [100, 130, 100, 60]).withColumn("ts", F.col("ts") * 120).withColumn("bar_id", (F.col("ts") / (120 * MINUTE)).cast("long")).withColumn("sigma", F.lit(0.1))
    got = labels.triple_barrier(df).orderBy("ts").collect()
    assert [(r.y, r.hit, r.exit_bar_id) for r in got] == [(1, "up", 1), (-1, "down", 2), (-1, "down", 3), (0, "time", 3)]


def test_motifs_need_support_and_lift(spark):
    rows = spark.createDataFrame([(True, True, 1), (True, True, 1), (True, False, -1), (False, False, -1)], "A boolean, B boolean, y int")
    got = {r.name: (r.support, r.purity, r.lift) for r in motifs.mine(rows, ["A", "B"], min_lift=1.2).collect()}
    assert got == {"A__LONG": (0.75, pytest.approx(2 / 3), pytest.approx(4 / 3)), "B__LONG": (0.5, 1.0, 2.0), "A_B__LONG": (0.5, 1.0, 2.0)}


def test_constant_returns_have_no_sharpe(spark):
    df = candles(spark, [1] * 60).select("symbol", "ts", F.lit(0.001).alias("ret"))
    got = evaluation.fold_sharpe(evaluation.folds(df, 4)).collect()
    assert len(got) == 4 and all(r.sharpe == 0 for r in got)
    assert evaluation.training(df, 4, 1).where("fold = 0").count() == 44


def test_fees(spark):
    row = spark.range(1).select(evaluation.Fees().cost(F.lit(False), F.lit(2.0)).alias("t"), evaluation.Fees().cost(F.lit(True), F.lit(-1.0)).alias("m")).first()
    assert (row.t, row.m) == (8.0, 1.0)


def test_flat_bars_count_in_windows(spark):
    """A bar without a range is a range of 0: it fills windows, and only divisions by it fail."""
    df = candles(spark, [10, 10, 10, 10, 10], highs=[12, 10, 13, 10, 14], lows=[10, 10, 10, 10, 10], volumes=[1, 1, 1, 1, 9])
    assert hits(predicates.evaluate(df, "RANGE_COMPRESSION", "hit", window=2, quantile=0.2)) == [False, True, False, True, False]
    assert hits(predicates.evaluate(df, "EVR_ANOMALY", "hit", window=3, threshold=0.5)) == [False, False, False, False, True]
    assert hits(predicates.evaluate(df, "ROUND_LEVEL_PROXIMITY", "hit", tick=5, atr_window=2)) == [False, True, True, True, True]
    assert hits(predicates.evaluate(df, "LONG_LOWER_WICK", "hit", threshold=0.0)) == [True] * 5
    assert hits(predicates.per_atr(df, "true_range", "x", 1), "x") == [1.0, 0.0, 1.0, 0.0, 1.0]


def test_wick_dominance_reads_ratio(spark):
    df = candles(spark, [10, 11], opens=[9, 10], highs=[13, 11.5], lows=[9, 10])
    assert hits(predicates.evaluate(df, "WICK_DOMINANCE", "hit", ratio=2)) == [True, False]


def test_round_level_grids(spark):
    df = candles(spark, [0.5, 0.75, 1.0], highs=[1, 1, 1.5], lows=[0, 0, 0.5])
    assert hits(predicates.evaluate(df, "ROUND_LEVEL_PROXIMITY", "hit", atr_window=1)) == [True] * 3  # the least gap, 0.25
    assert hits(predicates.evaluate(df, "ROUND_LEVEL_PROXIMITY", "hit", step=0.5, atr_window=1, tolerance=0.1)) == [True, False, True]
    with pytest.raises(ValueError):
        predicates.evaluate(df, "ROUND_LEVEL_PROXIMITY", "hit", step=0)


def test_sequences_may_leave_masks_out(spark):
    df = candles(spark, [1, 2, 3, 4]).withColumn("a", F.col("close") == 2).withColumn("b", F.col("close") == 9)
    spec = {"name": "SEQUENCE", "params": {"window": 2, "tolerance": 1}, "children": ["A", "B"]}
    assert hits(patterns.evaluate(df, spec, "hit", {"A": "a", "B": "b"})) == [False, True, True, False]
    spec["params"]["tolerance"] = -3
    assert not any(hits(patterns.evaluate(df, spec, "hit", {"A": "a", "B": "b"})))


def test_imbalance_signs_and_resets(spark):
    got = bars.event_mapping(candles(spark, [1, 2, 1, 1, 1, 1]), "imbalance", target_seconds=120).orderBy("timestamp").collect()
    assert [r.bar_id for r in got] == [0, 0, 1, 1, 2, 2]  # +1 +1, then -1 -1, then -1 -1
    kept = bars.event_mapping(candles(spark, [1, 1, 1]), "dollar", target_seconds=300, keep_partial=True)
    assert kept.count() == 3 and bars.event_mapping(candles(spark, [1, 1]), "dollar", target_seconds=300).isEmpty()


def test_event_bars_are_chosen_where_they_are_nearer(spark):
    df = candles(spark, [1.0] * 40).withColumn("ts", F.col("ts") * 3)
    got = bars.chosen_bars(df, target_seconds=120, tolerance=2.0)
    assert {r.method for r in got.select("method").distinct().collect()} == {"dollar"}
    assert {r.method for r in bars.chosen_bars(df, target_seconds=180, tolerance=0.1).select("method").distinct().collect()} == {"time"}


def test_volatility_is_that_of_pandas(spark):
    walk = random_walk(spark, 2, 60, seed=4)
    got = labels.volatility(walk, 10).toPandas().sort_values(["symbol", "ts"])
    for _, rows in got.groupby("symbol"):
        ret = rows.close.pct_change().fillna(0.0)
        want = ret.ewm(span=10, adjust=False).std(bias=False)
        assert np.allclose(rows.sigma.iloc[1:], want.iloc[1:])


def test_many_bars_are_labelled_in_one_sort(spark):
    walk = random_walk(spark, 1, 20_000).withColumn("bar_id", F.col("ts")).withColumn("sigma", F.lit(0.01))
    got = labels.triple_barrier(walk, min_hours=0.05, max_hours=0.5)
    assert got.count() == 20_000 and got.where("exit_bar_id < bar_id").isEmpty()
    share = labels.diagnostics(got).first()
    assert share.rows == 20_000 and share.class_up + share.class_flat + share.class_down == pytest.approx(1) and share.hit_time == share.class_flat
    with pytest.raises(ValueError):
        labels.require_balance(got.where("y = 1").union(got.where("y = 0").limit(1)))


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a - b", "[a]", "lambda: 1", "f(a, b)", "div(a)", "'x'", "a if b else a"])
def test_rules_are_a_closed_language(spark, text):
    with pytest.raises((ValueError, KeyError, SyntaxError)):
        rules.compiled(text, ["a", "b"])


def test_rule_values(spark):
    df = spark.createDataFrame([("S", 1, 4.0, 0.0), ("S", 2, -2.0, -1e-9), ("S", 3, None, 2.0), ("S", 4, float("nan"), 1.0)], "symbol string, ts long, a double, b double")
    value = lambda text: [r.x for r in df.select("ts", rules.compiled(text, ["a", "b"]).alias("x")).orderBy("ts").collect()]
    assert value("a + b * 2") == [4.0, pytest.approx(-2.0), 0.0, 0.0]
    assert value("div(b, a)")[:2] == [0.0, 5e-10] and value("div(a, b)") == [4e6, -math.inf, 0.0, 0.0]
    assert value("GT(a, b) + LE(a, b)") == [1.0, 1.0, 0.0, 0.0] and value("GT(a, 0) * GT(b, 0)") == [0.0, 0.0, 0.0, 0.0]
    assert value("AND(a, OR(b, 1)) + 0.5") == [1.5, 1.5, 0.5, 0.5]
    raw = np.array(value("a + b"))
    got = [r.signal for r in rules.with_signal(df, "a + b").orderBy("ts").collect()]
    assert got == pytest.approx(list(np.tanh(raw / raw.std())))
    assert [r.signal for r in rules.with_signal(df, "2").collect()] == pytest.approx([math.tanh(2)] * 4)


def test_ratios_of_many_trials(spark):
    row = spark.range(1).select(F.lit(0.2).alias("s"), F.lit(50).alias("n"), F.lit(-0.3).alias("k3"), F.lit(4.0).alias("k4"), F.lit(5).alias("t"))
    c = F.col
    row = row.select(strategy.psr_z(c("s"), c("n"), c("k3"), c("k4")).alias("p"), strategy.dsr_z(c("s"), c("n"), c("t"), c("k3"), c("k4"), 10).alias("d"), strategy.dsr_z(c("s"), c("n"), F.lit(1), c("k3"), c("k4"), 10).alias("one"))
    got = row.select("*", strategy.normal_cdf("p").alias("cdf")).first()
    v = 1 + 0.3 * 0.2 + 0.25 * 0.04
    assert got.p == pytest.approx(0.2 * 7 / math.sqrt(v)) and got.one == pytest.approx(got.p)
    assert got.d == pytest.approx(got.p - NormalDist().inv_cdf(0.8)) and got.cdf == pytest.approx(NormalDist().cdf(got.p))


def test_strategies(spark):
    n, hour = 20, 3_600_000_000
    signal, ret = [[0, 1, 1, -1, 0][k % 5] for k in range(n)], [[0.01, 0.02, -0.01, 0.03, 0.0][k % 5] for k in range(n)]
    s = spark.createDataFrame([("S", hour * k, float(x)) for k, x in enumerate(signal)], "symbol string, ts long, signal double")
    r = spark.createDataFrame([("S", hour * k, x) for k, x in enumerate(ret)] + [("S", -1, None)], "symbol string, ts long, ret double")
    got = strategy.evaluated(s, r, splits=2, min_trades=1).first()
    pos = np.sign(signal)
    turn = np.abs(np.diff(pos, prepend=pos[0]))
    net = pos * ret - turn * (7 + 0.5 * min(turn.mean(), 1)) / 10_000
    assert (got.n, got.trade_count, got.turnover) == (20, 4, pytest.approx(turn.mean()))
    assert got.sharpe_total == pytest.approx(net.mean() / net.std(ddof=1)) and got.skew == pytest.approx(((net - net.mean()) ** 3).mean() / net.std(ddof=1) ** 3)
    assert got.psr == pytest.approx(NormalDist().cdf(got.psr_z)) and got.breadth == (net > 0).mean()
    few = strategy.evaluated(s, r, splits=2, min_trades=10)
    assert few.first().dsr is None and few.first().pbo is None and strategy.fitness(few).first().fitness == -math.inf
    assert [x.signal for x in strategy.reindexed(s.where("ts = 3600000000"), r).orderBy("ts").collect()][:3] == [0.0, 0.0, 1.0]
    with pytest.raises(KeyError):
        strategy.returns_of(s)


def test_leaks_are_found(spark):
    real = spark.createDataFrame([("A", 0.8, 40), ("B", 0.8, 40), ("C", 0.1, 40)], "symbol string, fitness double, trade_count long")
    runs = spark.createDataFrame([("A", k, 0.7, 50) for k in range(3)] + [("B", 0, 0.7, 50), ("B", 1, 0.2, 50), ("C", 0, 0.9, 50)], "symbol string, run long, fitness double, trade_count long")
    got = strategy.guarded(real, runs)
    assert {r.symbol: r.leak for r in got.collect()} == {"A": True, "B": False, "C": False}
    assert strategy.guard_summary(got).first().asDict() == {"symbols": 3, "flagged": 1, "passed": 2, "pending": 0, "max_fitness": 0.8, "max_hits": 3}


def test_chance(spark):
    df = candles(spark, [1] * 60).select("symbol", "ts", (F.lit(0.001) * (F.col("ts") / MINUTE % 7 - 2)).alias("ret"))
    real = nulls.real_sharpe(df, 4)
    perm = nulls.permuted(df, 8, 5, 4)
    assert perm.count() == 8 and nulls.permuted(df, 8, 5, 4).exceptAll(perm).isEmpty()
    one = nulls.permuted(df, 1, 60, 4)  # one block: nothing moves
    assert one.first().sharpe == pytest.approx(real.first().real_sharpe)
    walks = {r.run: r.sharpe for r in nulls.random_walks(df, 3, 4, seed=5).collect()}
    key = __import__("zlib").crc32(b"S")
    x = np.expm1(np.random.default_rng([5, 2, key]).normal(0, 0.01, 60))
    assert walks[2] == pytest.approx(np.mean([p.mean() / p.std() * math.sqrt(31_557_600 / 60) for p in np.array_split(x, 4)]))
    p = nulls.p_values(real, perm).first()
    assert p.runs == 8 and p.p_value == (sum(r.sharpe >= p.real_sharpe for r in perm.collect()) + 1) / 9
    assert nulls.summary(df, 4, 5, 4).columns == ["symbol", "real_sharpe", "random_null_mean", "random_p", "perm_null_mean", "perm_p", "runs", "block_size"]


def test_fee_files(spark):
    document = {"venues": {"x": {"spot": {"vip0": {"maker_bps": 1, "taker": 5}, "vip2": {"taker_bps": 2, "impact": 0.1}}}}}
    strategy_file = {"default_tier": "vip0", "overrides": {"A": "vip2"}}
    assert fees.resolved(document, "x", "spot", "A", strategy=strategy_file) == (evaluation.Fees(0, 2, 0, 0.1), "vip2")
    assert fees.resolved(document, "x", "spot", "B", strategy=strategy_file)[1] == "vip0" and fees.tier_of("A", "vip9", strategy_file) == "vip9"
    with pytest.raises(KeyError):
        fees.resolved(document, "x", "spot", tier="vip9")
    rows = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert {r.symbol: (r.tier, r.fee_taker) for r in fees.with_fees(rows, document, "x", "spot", strategy_file).collect()} == {"A": ("vip2", 2.0), "B": ("vip0", 5.0)}


def test_motif_pipeline(spark):
    df = random_walk(spark, 2, 300, seed=3)
    y = df.select("symbol", "ts", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("y"))
    got = motifs.mine_bars(df, y, [("BULLISH_ENGULF", {}), ("INSIDE_BAR", {})], min_support=0.001, min_lift=1.0)
    assert {r.symbol for r in got.collect()} == {"S0", "S1"} and all(r.direction == 1 for r in got.collect() if r["items"] == ["BULLISH_ENGULF__0"])
    assert len(motifs.parsed_specs(None)) == 14 and motifs.parsed_specs({"default": ["A", {"name": "B", "params": {"x": 1}}]}) == [("A", {}), ("B", {"x": 1})]


def test_motif_clusters(spark):
    f = candles(spark, [1, 1, 1, 1, 9, 9, 9, 9]).select("symbol", "ts", "close")
    got = features.motif_clusters(f, 2, 2, seeds=2)
    assert got.count() == 7 and len({r.motif_id for r in got.orderBy("ts").collect()[:3]}) == 1
    assert features.one_hot(got, [0, 1]).where("motif_0 + motif_1 <> 1").isEmpty()
    with pytest.raises(ValueError):
        features.motif_clusters(f, 20, 2)


def test_rule_prototypes(spark):
    r = spark.createDataFrame([("p", "GT(a, b)", {"dsr": 3.0, "bad": float("nan")}), ("q", "a + c", {"dsr": 4.0})], "name string, expression string, metadata map<string,double>")
    stats = prototypes.pattern_stats(r)
    assert {x.name: (x["items"], x.metrics) for x in stats.collect()} == {"p": (["GT", "a", "b", "bad", "dsr"], {"dsr": 3.0}), "q": (["a", "c", "dsr"], {"dsr": 4.0})}
    m = {x.name: x.asDict() for x in prototypes.normalized(prototypes.feature_matrix(stats), ["dsr", "c"]).collect()}
    assert m["p"] == {"name": "p", "GT": 1.0, "a": 1.0, "b": 1.0, "bad": 1.0, "c": 0.0, "dsr": 0.6} and m["q"]["dsr"] == 0.8
    assert prototypes.jaccard_distances(stats).first().distance == pytest.approx(1 - 2 / 6)


def test_states(spark):
    rows = [(k, float(k % 10), 1.0, "upturn" if k % 10 > 4 else "downturn") for k in range(40)]
    df = spark.createDataFrame(rows, "ts long, feat_a double, feat_b double, state string")
    model = prototypes.fit_states(df, trees=5)
    got = prototypes.to_signal(prototypes.predicted(model, df))
    assert got.where("predicted <> state or signal <> case state when 'upturn' then 1 else -1 end").isEmpty()
    assert len(prototypes.predicted(model, df.drop("state")).first().probability) == 2
    other = prototypes.fit_states(df, estimator=LogisticRegression(maxIter=20))
    assert prototypes.predicted(other, df).where("predicted <> state").isEmpty()


def test_research_plan(spark):
    walk = random_walk(spark, 2, 600, seed=1)
    for method in ("time", "dollar", None):
        plan = research.research(walk, method, 3600, windows=(5,))
        rows = research.supervised(plan)
        assert rows.count() == plan.bars.count() > 0 and {"seed_trend_pullback", "w5_ret_sum_sum", "w3_ret_sum", "y"} <= set(rows.columns)
    assert research.with_columns_of(walk, ["close", "other"]).first().other is None
    left = spark.createDataFrame([("S", 1), ("S", 5), ("S", 9)], "symbol string, ts long")
    right = spark.createDataFrame([("S", 1, "a"), ("S", 6, "b")], "symbol string, ts long, v string")
    assert hits(research.as_of_forward(left, right, "v"), "v") == ["a", "b", None]


def test_stores_and_sinks(spark, tmp_path):
    walk = random_walk(spark, 2, 50)
    write_candles(walk, f"{tmp_path}/store")
    store = files.CandleStore.of(f"{tmp_path}/store", ["S0", "S1"])
    assert store.missing(spark) == [] and files.CandleStore.of(f"{tmp_path}/store", ["S9"]).missing(spark) == ["S9: no files"]
    assert store.load(spark, ["S0"], start=946_684_800_000_000 + MINUTE * 10).count() == 40 == files.CandleStore.in_memory(walk).load(spark, ["S0"], start=946_684_800_000_000 + MINUTE * 10).count()
    moved = files.CandleStore((files.CandleSpec("S0", f"{tmp_path}/store"), files.CandleSpec("X", f"{tmp_path}/store", lambda root, _: f"{root}/symbol=S1")))
    assert {r.symbol: r.n for r in moved.load(spark).groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"S0": 50, "X": 50}
    assert len(store.load(spark).inputFiles()) >= 2 and store.load(spark)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    (tmp_path / "raw/ABC/1m").mkdir(parents=True)
    (tmp_path / "raw/ABD/1m").mkdir(parents=True)
    (tmp_path / "raw/ABC/1m/ABC-1m-2024-02.csv").write_text("1000,1,2,0.5,1.5,10\n")
    assert files.month_range("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    found = files.month_files(spark, f"{tmp_path}/raw", files.month_range("2024-01", "2024-03"))
    assert [f.rsplit("/", 1)[1] for f in found] == ["ABC-1m-2024-02.csv"]
    (tmp_path / "raw/ABD/1m/ABD-1m-2024-01.csv").touch()
    (tmp_path / "raw/ABD/1m/OTHER-1m-2024-01.csv").touch()
    every = files.month_range("2024-01", "2024-03")
    assert [f.rsplit("/", 1)[1] for f in files.month_files(spark, f"{tmp_path}/raw", every)] == ["ABC-1m-2024-02.csv", "ABD-1m-2024-01.csv"]
    assert files.month_files(spark, f"{tmp_path}/raw", every, limit=1) == found == files.month_files(spark, f"{tmp_path}/raw", every, ["ABC", "ZZ"])
    files.csv_to_parquet(spark, found, f"{tmp_path}/month")
    assert spark.read.parquet(f"{tmp_path}/month").first().symbol == "ABC"
    with pytest.raises(FileNotFoundError):
        files.require_root(spark, f"{tmp_path}/none")

    pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-01"]), "side": ["buy"], "price": [1.0], "quantity": [2.0]}).to_csv(f"{tmp_path}/orders.csv", index=False)
    assert files.read_orders(spark, f"{tmp_path}/orders.csv").first().asDict() | {"timestamp": 0} == {"timestamp": 0, "side": "buy", "price": 1.0, "quantity": 2.0, "maker": False, "participation": 0.0, "ts": 1_704_067_200_000_000}
    with pytest.raises(ValueError):
        files.read_table(spark, "x.txt")
    spark.createDataFrame([(1, 0.5)], "ts long, returns double").toPandas().to_parquet(f"{tmp_path}/BTC_returns.parquet")
    assert files.read_returns(spark, f"{tmp_path}/*_returns.parquet").first().asDict() == {"symbol": "BTC", "ts": 1, "ret": 0.5}

    (tmp_path / "rules.json").write_text(json.dumps([{"name": "a", "expression": "x", "fitness": 0.5, "metadata": {"d": 1.0}}, {"name": "b", "expression": "y", "fitness": 0.9}, {"name": "c", "expression": "z", "fitness": None}]))
    r = files.read_rules(spark, f"{tmp_path}/rules.json")
    assert files.best_rule(r).first().name == "b" and r.count() == 3
    assert files.read_config(spark, f"{tmp_path}/rules.json")[0]["name"] == "a"
    files.write_json(r.withColumn("fitness", F.lit(float("inf"))), f"{tmp_path}/out.json")
    assert spark.read.json(f"{tmp_path}/out.json").where("fitness is null").count() == 3
    done = spark.createDataFrame([("A", "2024-01", ["x", "y"])], "symbol string, month string, items array<string>")
    for _ in range(2):
        files.append_csv(done, f"{tmp_path}/out.csv")
    assert [x["items"] for x in files.merged_csv(spark, f"{tmp_path}/out.csv", "symbol string, month string, items string").collect()] == ["x,y", "x,y"]
    done.write.partitionBy("symbol", "month").parquet(f"{tmp_path}/done")  # files, but no mark
    keys = spark.createDataFrame([("A", "2024-01"), ("B", "2024-01")], "symbol string, month string")
    assert files.undone(spark, keys, f"{tmp_path}/done").count() == 2
    (tmp_path / "done/symbol=A/month=2024-01/_SUCCESS").touch()
    assert [x.symbol for x in files.undone(spark, keys, f"{tmp_path}/done").collect()] == ["B"] and files.undone(spark, keys, f"{tmp_path}/done", force=True).count() == 2
    assert files.merged([done, keys]).count() == 3


def test_labels_are_read(spark, tmp_path):
    pd.DataFrame({"ts": ["2024-01-01 00:00:00", "2024-01-01 00:01:00"], "y": [1, -1]}).to_csv(f"{tmp_path}/labels.csv", index=False)
    want = [(1_704_067_200_000_000, 1), (1_704_067_260_000_000, -1)]
    for schema in (None, "ts timestamp, y int"):
        assert sorted(map(tuple, files.read_labels(spark, f"{tmp_path}/labels.csv", schema=schema).collect())) == want
    spark.createDataFrame(want, "timestamp long, side long").toPandas().to_parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, files.read_labels(spark, f"{tmp_path}/labels.parquet", "side").collect())) == want


def test_a_lost_run_is_done_again(spark, tmp_path):
    """A run that dies before its marks leaves its months undone; the next one's result is a clean run's."""
    root, month = f"{tmp_path}/out", lambda s, m, n: [(s, m, k, float(n)) for k in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, month string, ts long, x double")
    keys = spark.createDataFrame([("A", "2024-01"), ("A", "2024-02"), ("B", "2024-01"), ("C", "2024-01")], "symbol string, month string")
    files.write_months(frame(month("A", "2024-01", 3)), root)
    frame(month("A", "2024-02", 9)).write.mode("append").partitionBy("symbol", "month").parquet(root)  # what a lost run may leave
    left = files.undone(spark, keys, root)
    assert sorted(map(tuple, left.collect())) == [("A", "2024-02"), ("B", "2024-01"), ("C", "2024-01")]
    files.write_months(frame(month("A", "2024-02", 2) + month("B", "2024-01", 4)), root, left)
    got = spark.read.parquet(root)
    assert Counter((r.symbol, str(r.month)) for r in got.collect()) == {("A", "2024-01"): 3, ("A", "2024-02"): 2, ("B", "2024-01"): 4}
    assert files.undone(spark, keys, root).isEmpty() and files.undone(spark, keys, root, force=True).count() == 4


def test_wide_quantiles_are_those_of_percentile(spark, tmp_path):
    """Random and tied values, nulls, several symbols; the key may be several columns."""
    df = random_walk(spark, 3, 700).withColumn("x", F.when(F.rand(1) > 0.1, F.round(F.rand(2) * 9))).withColumn("run", F.lit(1))
    df.write.parquet(f"{tmp_path}/d")
    df = keyed(spark.read.parquet(f"{tmp_path}/d"), "symbol", "run")
    for q in (0.2, 0.5, 0.77):
        got = rolling.with_quantiles(df, {"a": ("x", 60, q), "b": ("close", 360, q), "c": ("x", 5, q)})
        want = got.withColumn("a1", F.percentile("x", q).over(last_rows(60))).withColumn("b1", F.percentile("close", q).over(last_rows(360))).withColumn("c1", F.percentile("x", q).over(last_rows(5)))
        assert want.where("not (a <=> a1) or not (b <=> b1) or not (c <=> c1)").isEmpty() and want.count() == 2100


def test_wide_statistics_are_those_of_frames(spark, tmp_path):
    """Values, nulls and ties in windows wider than batches, for several series."""
    df = random_walk(spark, 3, 500).withColumn("x", F.when(F.rand(1) > 0.3, F.round(F.rand(2) * 9))).withColumn("y", F.when(F.col("ts") % 7 == 0, F.lit(None)).otherwise(F.col("close")))
    df.write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    kinds = ("avg", "sum", "min", "max", "var_samp", "stddev_pop")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = rolling.with_rolling(df, {f"{x}_{k}_{n}": (x, n, k) for x in "xy" for k in kinds for n in (25, 90)} | {"one_var": ("x", 30, "var_samp")})
        want = got.withColumns({f"{x}_{k}_{n}_w": getattr(F, k)(x).over(last_rows(n)) for x in "xy" for k in kinds for n in (25, 90)}).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in want.columns:
        if c.endswith("_w"):
            assert np.allclose(want[c[:-2]], want[c], equal_nan=True, rtol=1e-9, atol=1e-9), c
    assert len(want) == 1500


def test_first_places_are_those_of_a_scan():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 200):
        x = np.round(rng.normal(0, 1, n), 1)
        x[rng.random(n) < 0.1] = np.nan
        low, high = -np.abs(np.round(rng.normal(0, 1.5, n), 1)), np.abs(np.round(rng.normal(0, 1.5, n), 1))
        begin = np.minimum(np.arange(n) + rng.integers(0, 5, n), n)
        end = np.minimum(begin + rng.integers(0, n + 1, n), n)
        want = [next((j for j in range(b, e) if x[j] >= h or x[j] <= lo), e) for b, e, lo, h in zip(begin, end, low, high)]
        assert labels.first_at(low, high, x, begin, end).tolist() == want


@pytest.mark.parametrize("spans", [1, 3, 1000])
def test_barriers_are_those_of_a_scan(spark, spans):
    rng = np.random.default_rng(6)
    rows = []
    for s in "AB":
        ts = np.cumsum(rng.choice([1, 1, 2, 9], 150)) * 60_000_000
        rows += [(s, int(t), k, float(c)) for k, (t, c) in enumerate(zip(ts, np.round(100 + np.cumsum(rng.normal(0, 1, 150)), 2)))]
    df = spark.createDataFrame(rows, "symbol string, ts long, bar_id long, close double").withColumn("sigma", F.lit(0.01))
    least, most = 3 * 60_000_000, 30 * 60_000_000
    want = {}
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        for k, (_, t, i, c) in enumerate(own):
            expiry, hit = min(t + most, own[-1][1]), None
            later = [r for r in own[k + 1 :] if r[1] <= t + most]
            after = next((r for r in own if r[1] >= t + most), own[-1])
            for r in [*later, after]:
                if (r[1] - t >= least or r[2] == own[-1][2]) and (r[3] >= c * 1.02 or r[3] <= c * 0.98):
                    hit = r
                    break
            want[s, i] = (hit[1] if hit else expiry, (hit or after)[2], "time" if not hit else "up" if hit[3] >= c * 1.02 else "down")
    got = labels.triple_barrier(df, min_hours=0.05, max_hours=0.5, spans=spans).collect()
    assert {(r.symbol, r.bar_id): (r.t1, r.exit_bar_id, r.hit) for r in got} == want and {w[2] for w in want.values()} == {"up", "down", "time"}


@pytest.mark.parametrize("chunk", [18, 50, 10_000])
def test_volatility_in_chunks(spark, chunk):
    walk = random_walk(spark, 2, 180, seed=4)
    got = labels.volatility(walk, 10, chunk).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == 360
    for _, rows in got.groupby("symbol"):
        want = rows.close.pct_change().fillna(0.0).ewm(span=10, adjust=False).std(bias=False)
        assert np.allclose(rows.sigma.iloc[1:], want.iloc[1:], rtol=1e-12)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
@pytest.mark.parametrize("method", ["dollar", "imbalance"])
def test_event_bars_in_chunks(spark, tmp_path, method, chunk):
    walk = random_walk(spark, 2, 300, seed=2)
    walk.write.parquet(f"{tmp_path}/walk")
    walk = keyed(spark.read.parquet(f"{tmp_path}/walk").withColumn("run", F.lit(2)), "symbol", "run")
    whole = bars.event_mapping(walk, method, target_seconds=300)
    parts = bars.event_mapping(walk, method, target_seconds=300, chunk=chunk)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.select(F.max("bar_id")).first()[0] > 5
