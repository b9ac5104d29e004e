"""The candle operators as queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
import re
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, predicates, rules
from ..functions.columns import by_time, ratio
from ..operators import bars, evaluation, features, fees, labels, motifs, nulls, population, prototypes, strategy
from ..sources.candles import from_events
from . import guardrail, research

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

OHLCV = """o AS (
  SELECT event_type AS symbol, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
STEP = 14_400_000_000
BARS = f"""{OHLCV},
e AS (SELECT symbol, CAST((ts + {STEP} - 1) // {STEP} * {STEP} AS BIGINT) AS edge, * EXCLUDE (symbol) FROM o),
b AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY edge) - 1 AS bar_id, edge AS ts, open, high, low, close, volume FROM (
    SELECT symbol, edge, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM e GROUP BY symbol, edge))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {OHLCV} SELECT symbol, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume FROM o")
def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(from_events(spark, sf_dir))


@query(f"WITH {BARS} SELECT symbol, bar_id, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM b")
def ohlcv_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.time_bars(from_events(spark, sf_dir)))


@query(f"WITH {BARS} SELECT o.symbol, o.ts AS timestamp, b.bar_id FROM o ASOF JOIN b ON o.symbol = b.symbol AND o.ts <= b.ts")
def minute_bar_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = from_events(spark, sf_dir)
    return bars.time_mapping(candles, bars.time_bars(candles))


def _event_sql(size: str, trigger: str, add: str, minutes: int = 240) -> str:
    return f"""WITH RECURSIVE {OHLCV},
k AS (SELECT *, CASE WHEN close > p THEN 1.0 WHEN close < p THEN -1.0 END AS d FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM o)),
m AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 1.0) AS tick, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM k),
x AS (SELECT symbol, ts, n, {add} AS x, greatest(quantile_cont({size}, 0.5) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) * {minutes}, 1e-6) AS lim FROM m),
f AS (
  SELECT symbol, n, ts, lim, x AS total, 0 AS bar_id FROM x WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.n, x.ts, x.lim, CASE WHEN {trigger} >= f.lim THEN 0 ELSE f.total END + x.x, f.bar_id + CASE WHEN {trigger} >= f.lim THEN 1 ELSE 0 END
  FROM f JOIN x ON x.symbol = f.symbol AND x.n = f.n + 1),
z AS (SELECT symbol, bar_id FROM f QUALIFY n = max(n) OVER (PARTITION BY symbol) AND {trigger} < f.lim AND {trigger} / f.lim < 0.5)
SELECT symbol, ts AS timestamp, CAST(bar_id AS BIGINT) AS bar_id FROM f ANTI JOIN z USING (symbol, bar_id)"""


@query(_event_sql("abs(close * volume)", "f.total", "abs(close * volume)"))
def dollar_bar_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.event_mapping(from_events(spark, sf_dir), "dollar")


@query(_event_sql("abs(volume)", "abs(f.total)", "tick * volume", 4))
def imbalance_bar_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.event_mapping(from_events(spark, sf_dir), "imbalance", target_seconds=240)


def _event_bars_sql(method: str, size: str, trigger: str, add: str, minutes: int) -> str:
    body = _event_sql(size, trigger, add, minutes).split("k AS (SELECT *, CASE", 1)[1]
    parts, last = ("k AS (SELECT *, CASE" + body).rsplit("\nSELECT symbol, ts AS timestamp", 1)
    for name in ("k", "m", "x", "f", "z"):
        parts = re.sub(rf"\b{name}\b(?= AS \()", f"{name}_{method}", parts)
        parts = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {name}_{method} AS {name}", parts)
    mapped = f"{method}_map AS (SELECT symbol, ts, CAST(bar_id AS BIGINT) AS bar_id FROM f_{method} AS f ANTI JOIN z_{method} AS z USING (symbol, bar_id))"
    return f"{parts},\n{mapped},\n{method}_bars AS (SELECT '{method}' AS method, symbol, bar_id, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM {method}_map JOIN o USING (symbol, ts) GROUP BY symbol, bar_id)"


@query(f"""WITH RECURSIVE {BARS.replace("row_number() OVER (PARTITION BY symbol ORDER BY edge) - 1 AS bar_id", "CAST(row_number() OVER (PARTITION BY symbol ORDER BY edge) - 1 AS BIGINT) AS bar_id")},
{_event_bars_sql("dollar", "abs(close * volume)", "f.total", "abs(close * volume)", 240)},
{_event_bars_sql("imbalance", "abs(volume)", "abs(f.total)", "tick * volume", 240)},
w AS (SELECT 'time' AS method, * FROM b UNION ALL BY NAME SELECT * FROM dollar_bars UNION ALL BY NAME SELECT * FROM imbalance_bars),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol, method ORDER BY ts) AS gap FROM w),
c AS (SELECT symbol, method, coalesce(abs(quantile_cont(gap, 0.5) / 1e6 - 14400), 'inf'::DOUBLE) AS off FROM g GROUP BY ALL),
y AS (SELECT symbol, method FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN method <> 'time' AND off <= 0.25 * 14400 THEN 0 ELSE 1 END, off, list_position(['time', 'dollar', 'imbalance'], method)) = 1)
SELECT symbol, method, bar_id, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM w JOIN y USING (symbol, method)""")
def bar_method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.chosen_bars(from_events(spark, sf_dir)))


def _folded_sql(method: str, trigger: str) -> str:
    """The event bars' fold of a symbol's rows as one list, where recursion row by row would take too long."""
    met = f"{trigger.replace('f.total', 'a.t')} >= a.lim"
    t, bar = f"CASE WHEN {met} THEN 0 ELSE a.t END + e.t", f"a.bar + CASE WHEN {met} THEN 1 ELSE 0 END"
    step = f"lambda a, e: {{'t': {t}, 'lim': e.lim, 'bar': {bar}, 'ts': list_append(a.ts, {t}), 'bars': list_append(a.bars, {bar})}}"
    empty = "'bar': 0::BIGINT, 'ts': []::DOUBLE[], 'bars': []::BIGINT[]"
    return f"""l_{method} AS (SELECT symbol, list_reduce(list({{'t': x::DOUBLE, 'lim': lim::DOUBLE, {empty}}} ORDER BY n), {step}, {{'t': 0::DOUBLE, 'lim': 1e-6::DOUBLE, {empty}}}) AS r FROM x_{method} GROUP BY symbol),
f_{method} AS (SELECT symbol, x.n, x.ts, x.lim, u.total, u.bar_id FROM (SELECT symbol, unnest(r.ts) AS total, unnest(r.bars) AS bar_id, generate_subscripts(r.ts, 1) AS n FROM l_{method}) u JOIN x_{method} AS x USING (symbol, n))"""


def _minutes_sql(target: int, tolerance: float) -> str:
    sql = ORACLES["bar_method_choice"].replace("'hour'", "'minute'").replace(str(STEP), str(target * 1_000_000)).replace("0.25 * 14400", f"{tolerance} * {target}").replace("14400", str(target)).replace("* 240,", f"* {target // 60},")
    for method, trigger in (("dollar", "f.total"), ("imbalance", "abs(f.total)")):
        begin = sql.index(f"f_{method} AS (")
        sql = sql[:begin] + _folded_sql(method, trigger) + ",\n" + sql[sql.index(f"z_{method} AS (") :]
    return sql


@query(_minutes_sql(60, 15.0))
def bar_method_choice_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with gaps: bars of one minute are far from their target, and imbalance bars win."""
    return rounded(bars.chosen_bars(from_events(spark, sf_dir, "minute"), 60, 15.0))


@query(_minutes_sql(1200, 15.0))
def bar_method_choice_twenty_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar bars win for most symbols, time bars where those are beyond the tolerance."""
    return rounded(bars.chosen_bars(from_events(spark, sf_dir, "minute"), 1200, 15.0))


@query(f"""WITH RECURSIVE {OHLCV}, {_event_bars_sql("dollar", "abs(close * volume)", "f.total", "abs(close * volume)", 240)}
SELECT symbol, bar_id, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM dollar_bars""")
def dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.event_bars(from_events(spark, sf_dir), "dollar"))


@query(ORACLES["dollar_bar_mapping"])
def dollar_bar_mapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars from chunks of 97 rows, each a task's work."""
    return bars.event_mapping(from_events(spark, sf_dir), "dollar", chunk=97)


@query(ORACLES["imbalance_bar_mapping"])
def imbalance_bar_mapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.event_mapping(from_events(spark, sf_dir), "imbalance", target_seconds=240, chunk=97)


def _morph_sql(n: int, rounds: bool = True) -> str:
    w = f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    cols = {
        "tod_sin": "sin(floor((ts % 86400000000) / 1e6) * (2 * pi() / 86400))", "tod_cos": "cos(floor((ts % 86400000000) / 1e6) * (2 * pi() / 86400))", "direction": "sign(close - open)", "range": "tr", "body": "body",
        "wick_upper": "wu", "wick_lower": "wl", "cum_return": "sum(ret) OVER (PARTITION BY symbol ORDER BY ts)",
        f"w{n}_body_atr": f"body / nullif(avg(tr) OVER {w}, 0)", f"w{n}_upper_body": "wu / nullif(body, 0)", f"w{n}_lower_body": "wl / nullif(body, 0)", f"w{n}_range_var": f"var_samp(tr) OVER {w}",
        f"w{n}_ret_sum": f"sum(ret) OVER {w}", f"w{n}_ret_z": f"(ret - avg(ret) OVER {w}) / nullif(stddev_pop(ret) OVER {w}, 0)", f"w{n}_vol_z": f"(volume - avg(volume) OVER {w}) / nullif(stddev_pop(volume) OVER {w}, 0)",
        f"w{n}_drawup": f"(close - min(close) OVER {w}) / nullif(min(close) OVER {w}, 0)", f"w{n}_drawdown": f"(max(close) OVER {w} - close) / nullif(max(close) OVER {w}, 0)",
    }
    flag = f"CAST(coalesce(tr <= quantile_cont(tr, 0.2) OVER {w}, false) AS INT) AS w{n}_nr_flag"
    return f"""WITH {OHLCV},
d AS (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS wu, least(open, close) - low AS wl, nullif(high - low, 0) AS tr,
  coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM o)
SELECT symbol, ts, {", ".join(f"round(coalesce({x}, 0), 7) + 0.0 AS {k}" if rounds else f"coalesce({x}, 0)::DOUBLE AS {k}" for k, x in cols.items())}, {flag} FROM d"""


def _morph(n: int):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.morphology(from_events(spark, sf_dir), (n,)), 7)

    f.__name__ = f"morph_w{n}"
    return query(_morph_sql(n))(f)


for _n in (3, 6, 12):
    _morph(_n)


def _rollup_sql(windows: tuple[int, int]) -> str:
    base = ["tod_sin", "tod_cos", "direction", "range", "body", "wick_upper", "wick_lower", "cum_return"]
    own = [f"w{n}_{x}" for n in windows for x in ("body_atr", "upper_body", "lower_body", "range_var", "ret_sum", "ret_z", "vol_z", "drawup", "drawdown", "nr_flag")]
    make = {"sum": 'sum("{0}")', "max": 'max("{0}")', "mean": 'avg("{0}")', "last": 'arg_max("{0}", m.ts)'}
    cols = [f"CAST({make[r].format(c)} AS BIGINT) AS {c}_{r}" if c.endswith("nr_flag") else f"round({make[r].format(c)}, 6) + 0.0 AS {c}_{r}" for c in base + own for r in features.reducers(c)]
    second = f"SELECT symbol, ts, {', '.join(own[10:])} FROM ({_morph_sql(windows[1], False)})"
    return f"""WITH {BARS}, m AS (SELECT * FROM ({_morph_sql(windows[0], False)}) JOIN ({second}) USING (symbol, ts))
SELECT m.symbol, b.bar_id, {", ".join(cols)} FROM m JOIN b ON b.symbol = m.symbol AND b.ts = CAST((m.ts + {STEP} - 1) // {STEP} * {STEP} AS BIGINT) GROUP BY m.symbol, b.bar_id"""


@query(_rollup_sql((3, 6)))
def feature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = from_events(spark, sf_dir)
    return rounded(features.rollup(features.morphology(candles, (3, 6)), bars.time_mapping(candles, bars.time_bars(candles))))


#: Each predicate's parameters here and its SQL over f (o with body, uw, lw, tr); w20 and w5 are full windows.
_LAG = "OVER (PARTITION BY symbol ORDER BY ts)"


def _full(value: str, x: str, n: int, frame: str | None = None) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {frame or f'{n - 1} PRECEDING'})"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {value} {over} END"


_BEFORE = "BETWEEN 10 PRECEDING AND 1 PRECEDING"
_PREV = {x: f"lag({x}) {_LAG}" for x in ("open", "high", "low", "close")}


def _near(level: str, tolerance: float = 0.02) -> str:
    return f"abs(close - {level}) / nullif({_full('avg(tr)', 'tr', 20)}, 0) <= {tolerance}"


_FIRST = f"greatest(first_value(close) {_LAG}, 1e-12)"


def _steps(p: float) -> str:
    return f"{_FIRST} * exp(round_even(ln(greatest(greatest(close, 1e-12) / {_FIRST}, 1e-12)) / {math.log(1 + p)!r}, 0) * {math.log(1 + p)!r})"


PREDICATES = {
    "LONG_LOWER_WICK": ({"threshold": 0.4}, "coalesce(lw / nullif(tr, 0), 0) >= 0.4"),
    "RANGE_COMPRESSION": ({}, f"tr <= {_full('quantile_cont(tr, 0.2)', 'tr', 5)}"),
    "VOLUME_SPIKE": ({}, f"volume >= {_full('quantile_cont(volume, 0.8)', 'volume', 20)}"),
    "CLOSE_ABOVE_PRIOR_LOW": ({}, f"close > {_PREV['low']}"),
    "BREAK_ABOVE_RANGE": ({}, f"close >= {_full('max(high)', 'high', 10, _BEFORE)}"),
    "BREAK_BELOW_RANGE": ({}, f"close <= {_full('min(low)', 'low', 10, _BEFORE)}"),
    "HIGHER_LOW": ({}, f"low > {_PREV['low']} AND {_PREV['low']} > lag(low, 2) {_LAG}"),
    "INSIDE_BAR": ({}, f"high < {_PREV['high']} AND low > {_PREV['low']}"),
    "OUTSIDE_BAR": ({}, f"high > {_PREV['high']} AND low < {_PREV['low']}"),
    "BULLISH_ENGULF": ({}, f"{_PREV['close']} < {_PREV['open']} AND close > open AND greatest(open, close) >= greatest({_PREV['open']}, {_PREV['close']}) AND least(open, close) <= least({_PREV['open']}, {_PREV['close']})"),
    "BEARISH_ENGULF": ({}, f"{_PREV['close']} > {_PREV['open']} AND close < open AND greatest(open, close) >= greatest({_PREV['open']}, {_PREV['close']}) AND least(open, close) <= least({_PREV['open']}, {_PREV['close']})"),
    "WICK_DOMINANCE": ({}, "coalesce(uw / nullif(body, 0), 0) >= 1.5"),
    "EVR_ANOMALY": ({}, f"coalesce(({_full('(volume - avg(volume)', 'volume', 20).replace('(volume - avg(volume)', 'volume - avg(volume)')}) / nullif(stddev_pop(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 0) / nullif(tr / nullif({_full('avg(tr)', 'tr', 20)}, 0), 0), 0) >= 1"),
    "PIVOT_HIGH": ({}, f"high > {_PREV['high']} AND high > lag(high, 2) {_LAG} AND high >= lead(high) {_LAG} AND high >= lead(high, 2) {_LAG}"),
    "PIVOT_LOW": ({}, f"low < {_PREV['low']} AND low < lag(low, 2) {_LAG} AND low <= lead(low) {_LAG} AND low <= lead(low, 2) {_LAG}"),
    "ROUND_LEVEL_PROXIMITY": ({"tick": 5.0, "tolerance": 0.02}, _near("round_even(close / 5, 0) * 5")),
}
FIELDS = f"{OHLCV},\nf AS (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw, high - low AS tr FROM o)"


def _predicate(name: str, params: dict, sql: str, suffix: str = ""):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicates.evaluate(from_events(spark, sf_dir), name, "hit", **params).select("symbol", "ts", "hit")

    f.__name__ = f"pred_{name.lower()}{suffix}"
    return query(f"WITH {FIELDS} SELECT symbol, ts, coalesce({sql}, false) AS hit FROM f")(f)


for _name, (_params, _sql) in PREDICATES.items():
    _predicate(_name, _params, _sql)
_predicate("ROUND_LEVEL_PROXIMITY", {"percent": 0.03, "tolerance": 0.02}, _near(_steps(0.03)), "_percent")
_predicate("ROUND_LEVEL_PROXIMITY", {"step": 7.5, "tolerance": 0.02}, _near("round_even(close / 7.5, 0) * 7.5"), "_step")
_predicate("ROUND_LEVEL_PROXIMITY", {"tolerance": 0.005}, _near(f"CASE WHEN quantile_cont(close, 0.5) OVER (PARTITION BY symbol) > 1 THEN {_steps(0.01)} END", 0.005), "_auto")  # every symbol's median is above 1
_predicate("WICK_DOMINANCE", {"ratio": 0.5, "kind": "lower"}, "coalesce(lw / nullif(body, 0), 0) >= 0.5", "_lower")

_INSIDE, _HIGHER, _ABOVE = (PREDICATES[x][1] for x in ("INSIDE_BAR", "HIGHER_LOW", "CLOSE_ABOVE_PRIOR_LOW"))
_MASKS = f"{FIELDS}, m AS (SELECT symbol, ts, coalesce({_INSIDE}, false) AS a, coalesce({_HIGHER}, false) AS b, coalesce({_ABOVE}, false) AS c FROM f)"
_SEQ = "list_slice({m}, {at}, 5)"
PATTERNS = {
    "dsl_and": ({"name": "AND", "children": ["HIGHER_LOW", "CLOSE_ABOVE_PRIOR_LOW"]}, f"WITH {_MASKS} SELECT symbol, ts, b AND c AS hit FROM m"),
    "dsl_or": ({"name": "OR", "children": ["INSIDE_BAR", "HIGHER_LOW"]}, f"WITH {_MASKS} SELECT symbol, ts, a OR b AS hit FROM m"),
    "dsl_not": ({"name": "NOT", "children": ["INSIDE_BAR"]}, f"WITH {_MASKS} SELECT symbol, ts, NOT a AS hit FROM m"),
    "dsl_count": ({"name": "COUNT", "params": {"window": 5, "threshold": 2}, "children": ["HIGHER_LOW"]}, f"WITH {_MASKS} SELECT symbol, ts, sum(CAST(b AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) >= 2 AS hit FROM m"),
    "dsl_sequence": (
        {"name": "SEQUENCE", "params": {"window": 5}, "children": ["INSIDE_BAR", "HIGHER_LOW"]},
        f"""WITH {_MASKS}, l AS (SELECT symbol, ts, list(a) OVER v AS a, list(b) OVER v AS b FROM m WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING))
SELECT symbol, ts, coalesce(list_position(a, true) > 0 AND list_contains(list_slice(b, CAST(list_position(a, true) + 1 AS BIGINT), 5), true), false) AS hit FROM l""",
    ),
    "dsl_sequence_tolerance": (
        {"name": "SEQUENCE", "params": {"window": 5, "tolerance": 1}, "children": ["INSIDE_BAR", "HIGHER_LOW", "INSIDE_BAR"]},
        f"""WITH {_MASKS}, l AS (SELECT symbol, ts, list(a) OVER v AS a, list(b) OVER v AS b FROM m WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)),
x AS (SELECT *, coalesce(list_position(a, true), 0) AS p FROM l), y AS (SELECT *, coalesce(list_position(b[p + 1:], true), 0) AS q FROM x), z AS (SELECT *, coalesce(list_position(a[p + q + 1:], true), 0) AS r FROM y)
SELECT symbol, ts, CAST(p = 0 AS INT) + CAST(q = 0 AS INT) + CAST(r = 0 AS INT) <= 1 AS hit FROM z""",
    ),
    "dsl_sequence_wide": (
        {"name": "SEQUENCE", "params": {"window": 70, "tolerance": 1}, "children": ["INSIDE_BAR", "HIGHER_LOW", "INSIDE_BAR"]},
        f"""WITH {_MASKS}, l AS (SELECT symbol, ts, list(a) OVER v AS a, list(b) OVER v AS b FROM m WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 69 PRECEDING)),
x AS (SELECT *, coalesce(list_position(a, true), 0) AS p FROM l), y AS (SELECT *, coalesce(list_position(b[p + 1:], true), 0) AS q FROM x), z AS (SELECT *, coalesce(list_position(a[p + q + 1:], true), 0) AS r FROM y)
SELECT symbol, ts, CAST(p = 0 AS INT) + CAST(q = 0 AS INT) + CAST(r = 0 AS INT) <= 1 AS hit FROM z""",
    ),
    "seed_trend_pullback": (patterns.SEEDS["trend_pullback"], f"WITH {FIELDS} SELECT symbol, ts, coalesce({_HIGHER}, false) AND coalesce({PREDICATES['RANGE_COMPRESSION'][1]}, false) AS hit FROM f"),
    "seed_stop_run_reclaim": (patterns.SEEDS["stop_run_reclaim"], f"WITH {FIELDS} SELECT symbol, ts, coalesce({PREDICATES['LONG_LOWER_WICK'][1]}, false) AND coalesce({PREDICATES['VOLUME_SPIKE'][1]}, false) AND coalesce({_ABOVE}, false) AS hit FROM f"),
}


def _pattern(name: str, spec: dict, sql: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return patterns.evaluate(from_events(spark, sf_dir), spec, "hit").select("symbol", "ts", "hit")

    f.__name__ = name
    return query(sql)(f)


for _name, (_spec, _sql) in PATTERNS.items():
    _pattern(_name, _spec, _sql)

_TWENTY = "sigma AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_id, 0.2 AS s FROM o)"
TRIPLE = f"""WITH {OHLCV}, {_TWENTY},
g AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last_ts, close * 1.4 AS up, close * 0.6 AS dn FROM sigma),
nx AS (SELECT g.symbol, g.ts, coalesce(min(n.ts), max(g.last_ts)) AS nts FROM g LEFT JOIN o n ON n.symbol = g.symbol AND n.ts >= g.ts + 43200000000 GROUP BY ALL),
p AS (
  SELECT g.symbol, g.ts, min(q.ts) AS hit_ts FROM g JOIN nx USING (symbol, ts) JOIN o q ON q.symbol = g.symbol AND (q.ts > g.ts AND q.ts <= g.ts + 43200000000 OR q.ts = nx.nts)
  WHERE (q.ts - g.ts >= 7200000000 OR q.ts = g.last_ts) AND (q.close >= g.up OR q.close <= g.dn) GROUP BY ALL)
SELECT g.symbol, g.bar_id, g.ts, coalesce(p.hit_ts, least(g.ts + 43200000000, g.last_ts)) AS t1,
  CASE WHEN p.hit_ts IS NULL THEN 0 WHEN x.close >= g.up THEN 1 ELSE -1 END AS y, CASE WHEN p.hit_ts IS NULL THEN 'time' WHEN x.close >= g.up THEN 'up' ELSE 'down' END AS hit,
  round((x.ts - g.ts) / 3.6e9, 4) + 0.0 AS holding_hours, x.bar_id AS exit_bar_id
FROM g JOIN nx USING (symbol, ts) LEFT JOIN p USING (symbol, ts) JOIN sigma x ON x.symbol = g.symbol AND x.ts = coalesce(p.hit_ts, nx.nts)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir).withColumn("bar_id", F.row_number().over(by_time()) - 1)


@query(TRIPLE)
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.triple_barrier(_numbered(spark, sf_dir).withColumn("bar_id", F.col("bar_id").cast("long")).withColumn("sigma", F.lit(0.2)))
    return rounded(out.select("symbol", "bar_id", "ts", "t1", "y", "hit", "holding_hours", "exit_bar_id"), 4)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir)
    return o.select("symbol", "ts", F.coalesce(ratio(F.col("close"), F.lag("close").over(by_time())) - 1, F.lit(0.0)).alias("ret"))


_RET = f"{OHLCV}, r AS (SELECT symbol, ts, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM o)"


@query(f"WITH {_RET} SELECT symbol, ts, CASE WHEN ret > 0.001 THEN 'U' WHEN ret < -0.001 THEN 'D' ELSE 'F' END AS state FROM r")
def symbolic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.states(_returns(spark, sf_dir)).select("symbol", "ts", "state")


@query(f"""WITH {_RET}, k AS (SELECT *, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS fold FROM r),
g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol, fold ORDER BY ts)) / 1e6 AS gap FROM k)
SELECT symbol, CAST(fold AS INT) AS fold, round(avg(ret) / stddev_pop(ret) * sqrt(31557600 / greatest(quantile_cont(gap, 0.5), 1)), 4) + 0.0 AS sharpe, round(avg(abs(ret)), 4) + 0.0 AS abs_return_mean, round(sum(ret), 4) + 0.0 AS pnl
FROM g GROUP BY symbol, fold""")
def cpcv_fold_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.fold_sharpe(evaluation.folds(_returns(spark, sf_dir))), 4)


@query(f"""WITH {_RET}, k AS (SELECT *, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS fold FROM r), s AS (SELECT symbol, fold, min(ts) AS lo, max(ts) AS hi FROM k GROUP BY ALL)
SELECT r.symbol, r.ts, CAST(s.fold AS INT) AS fold FROM r JOIN s USING (symbol) WHERE NOT (r.ts >= s.lo - 3600000000 AND r.ts <= s.hi + 3600000000)""")
def cpcv_train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.training(_returns(spark, sf_dir))


@query(f"""WITH {_RET}, e AS (SELECT symbol, ts, ts + 21600000000 AS t1, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b FROM r), s AS (SELECT symbol, b AS fold, min(ts) AS lo, max(t1) AS hi FROM e GROUP BY ALL)
SELECT symbol, ts, CAST(fold AS INT) AS fold FROM e JOIN s USING (symbol) WHERE b <> fold AND NOT (ts <= hi AND t1 >= lo) AND NOT (ts >= lo - 3600000000 AND ts <= hi + 3600000000)""")
def event_kfold_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.event_training(_returns(spark, sf_dir).withColumn("t1", F.col("ts") + 21_600_000_000))


#: A position against the last move, held to the next bar: its folds win and lose.
_FADE = f"{_RET}, s AS (SELECT symbol, ts, ret, coalesce(-sign(lag(ret) OVER (PARTITION BY symbol ORDER BY ts)) * (CASE WHEN ts // 3600000000 % 5 < 2 THEN -1 ELSE 1 END), 0) * least(ret, 1.0) AS gain FROM r)"


def _fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.floor(F.col("ts") / 3_600_000_000) % 5 < 2, -1).otherwise(1)
    r = _returns(spark, sf_dir)
    return r.withColumn("gain", F.coalesce(-F.signum(F.lag("ret").over(by_time())) * side, F.lit(0.0)) * F.least("ret", F.lit(1.0)))


@query(f"""WITH {_FADE}, k AS (SELECT *, ntile(12) OVER (PARTITION BY symbol ORDER BY ts) AS fold FROM s), g AS (SELECT symbol, fold, avg(gain) AS m FROM k GROUP BY ALL)
SELECT symbol, round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS pbo FROM g GROUP BY symbol""")
def pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.overfit_share(evaluation.fold_sharpe(evaluation.folds(_fade(spark, sf_dir), 12), "gain")))


@query(f"""WITH {_RET}, k AS (SELECT *, ntile(5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b FROM r), c AS (SELECT row_number() OVER (ORDER BY x.i, y.i) - 1 AS fold, x.i AS p, y.i AS q FROM range(5) x(i), range(5) y(i) WHERE x.i < y.i),
t AS (SELECT c.fold, k.* FROM k JOIN c ON k.b = c.p OR k.b = c.q), g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol, fold ORDER BY ts)) / 1e6 AS gap FROM t)
SELECT symbol, CAST(fold AS INT) AS fold, round(avg(ret) / stddev_pop(ret) * sqrt(31557600 / greatest(quantile_cont(gap, 0.5), 1)), 4) + 0.0 AS sharpe, round(avg(abs(ret)), 4) + 0.0 AS abs_return_mean, round(sum(ret), 4) + 0.0 AS pnl FROM g GROUP BY symbol, fold""")
def cpcv_two_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.fold_sharpe(evaluation.folds(_returns(spark, sf_dir), 5, 2)), 4)


_ITEMS = ["INSIDE_BAR", "HIGHER_LOW", "CLOSE_ABOVE_PRIOR_LOW"]


@query(f"""WITH {_MASKS}, y AS (SELECT m.*, CASE WHEN n > 0 THEN 1 WHEN n < 0 THEN -1 ELSE 0 END AS y FROM m JOIN (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS n FROM o) USING (symbol, ts)),
s AS (SELECT 'CLOSE_ABOVE_PRIOR_LOW' AS k, c AS h, y FROM y UNION ALL SELECT 'HIGHER_LOW', b, y FROM y UNION ALL SELECT 'INSIDE_BAR', a, y FROM y
  UNION ALL SELECT 'CLOSE_ABOVE_PRIOR_LOW_HIGHER_LOW', b AND c, y FROM y UNION ALL SELECT 'CLOSE_ABOVE_PRIOR_LOW_INSIDE_BAR', a AND c, y FROM y UNION ALL SELECT 'HIGHER_LOW_INSIDE_BAR', a AND b, y FROM y),
t AS (SELECT k, d, count(*) FILTER (h) / count(*) AS support, count(*) FILTER (h AND y = d) / nullif(count(*) FILTER (h), 0) AS purity, count(*) FILTER (y = d) / count(*) AS base FROM s, (VALUES (1), (-1)) v(d) GROUP BY k, d)
SELECT k || CASE WHEN d > 0 THEN '__LONG' ELSE '__SHORT' END AS name, CAST(d AS INT) AS direction, round(support, 6) + 0.0 AS support, round(purity / base, 6) + 0.0 AS lift, round(purity, 6) + 0.0 AS purity
FROM t WHERE support >= 0.01 AND purity > 0 AND purity / base >= 0.9""")
def motif_support_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir)
    for name in _ITEMS:
        o = predicates.evaluate(o, name, name)
    o = o.withColumn("y", F.coalesce(F.signum(F.lead("close").over(by_time()) - F.col("close")), F.lit(0.0)).cast("int"))
    return rounded(motifs.mine(o, _ITEMS, min_lift=0.9, max_size=2).drop("items"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = li.join(o.select("o_orderkey", "o_orderdate"), li.l_orderkey == o.o_orderkey)
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") * (1 + F.col("l_suppkey") % 50)).alias("quantity"), (F.col("l_linestatus") == "O").alias("maker"), F.col("l_discount").alias("participation"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, l_extendedprice / l_quantity AS price, l_quantity * (1 + l_suppkey % 50) AS q, l_linestatus = 'O' AS maker, l_discount AS part, max(abs(l_quantity * (1 + l_suppkey % 50))) OVER (PARTITION BY l_suppkey % 50) AS largest FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT *, price * (1 + s * 0.0001 + s * abs(q) / largest * 0.00001) AS fill, CASE WHEN maker THEN 1 ELSE 7 END + greatest(part, 0) * 0.5 AS fee FROM x)
SELECT l_orderkey, l_linenumber, round(fill, 4) + 0.0 AS fill_price, round(fee, 4) + 0.0 AS fee_bps, round(abs(q) * fill * fee / 10000, 4) + 0.0 AS fee_paid, round((fill - price) / price * 10000, 4) + 0.0 AS slippage_bps FROM y""")
def execution_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.executed(_orders(spark, sf_dir))
    return rounded(out.select("l_orderkey", "l_linenumber", "fill_price", "fee_bps", "fee_paid", "slippage_bps"), 4)


@query(f"""WITH {_RET}, p AS (SELECT symbol AS panel, ts, ret AS score FROM r), w AS (SELECT panel, 1 / nullif(stddev_pop(score), 0) AS w FROM p GROUP BY panel), t AS (SELECT sum(w) AS total, count(*) AS k FROM w),
c AS (SELECT ts, CASE WHEN count(*) = max(t.k) THEN sum(w * score) / max(t.total) ELSE 0 END AS s FROM p JOIN w USING (panel), t GROUP BY ts),
d AS (SELECT ts, s, least(coalesce(abs(s - lag(s) OVER (ORDER BY ts)), 0), 0.5) AS turn FROM c)
SELECT ts, round(s, 6) + 0.0 AS ensemble_score, round(turn, 6) + 0.0 AS turnover, round(s - sign(s) * (7 + 0.5 * avg(turn) OVER ()) / 10000, 6) + 0.0 AS fee_adjusted_score, 1.0::DOUBLE AS weight_sum FROM d""")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.ensemble(_returns(spark, sf_dir).select(F.col("symbol").alias("panel"), "ts", F.col("ret").alias("score"))))


@query(f"WITH {_RET} SELECT symbol, ts, CASE WHEN abs(ret) > 0.5 THEN 1 ELSE 0 END AS meta FROM r")
def meta_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.meta_label(_returns(spark, sf_dir).withColumnRenamed("ret", "score")).select("symbol", "ts", "meta")


_SIGNALS = f"""{_RET}, q AS (SELECT symbol, ts, least(ret, 1.0) AS ret FROM r),
g AS (SELECT *, coalesce(avg(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS signal FROM q)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(spark, sf_dir).select("symbol", "ts", F.least("ret", F.lit(1.0)).alias("ret"))
    return r.withColumn("signal", F.coalesce(F.avg("ret").over(by_time().rowsBetween(-3, -1)), F.lit(0.0)))


@query(f"""WITH {_SIGNALS},
p AS (SELECT *, CASE WHEN abs(signal) > 0.1 THEN sign(signal) ELSE 0 END AS pos FROM g),
t AS (SELECT *, coalesce(abs(pos - lag(pos) OVER w), 0) AS turn, pos <> 0 AND coalesce(lag(pos) OVER w, 0) = 0 AS entry FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT *, least(avg(turn) OVER (PARTITION BY symbol), 1) AS part FROM t),
n AS (SELECT *, pos * ret AS gross, turn * (7 + 0.5 * part) / 10000 AS cost, pos * ret - turn * (7 + 0.5 * part) / 10000 AS net, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) AS fold FROM c),
m AS (SELECT *, avg(net) OVER v AS mu, stddev_samp(net) OVER v AS sd FROM n WINDOW v AS (PARTITION BY symbol)),
a AS (SELECT symbol, count(*) AS n, max(mu) AS mu, max(sd) AS sd, avg((net - mu) ** 3) / max(sd) ** 3 AS skew, avg((net - mu) ** 4) / max(sd) ** 4 AS kurt, stddev_pop(net) AS std_return, avg(gross) AS gross, avg(cost) AS cost, max(part) AS part, avg(turn) AS turnover,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS breadth, count(*) FILTER (entry) AS trades FROM m GROUP BY symbol),
d AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol, fold ORDER BY ts)) / 1e6 AS gap FROM m),
s AS (SELECT symbol, fold, avg(net) / stddev_pop(net) * sqrt(31557600 / greatest(quantile_cont(gap, 0.5), 1)) AS sharpe FROM d GROUP BY ALL),
f AS (SELECT symbol, avg(sharpe) AS sharpe_mean, avg(CASE WHEN sharpe <= 0 THEN 1.0 ELSE 0.0 END) AS pbo FROM s GROUP BY symbol),
z AS (SELECT *, mu / sd AS sr, 1 - skew * (mu / sd) + (kurt - 3) / 4 * (mu / sd) ** 2 AS v FROM a JOIN f USING (symbol))
SELECT symbol, n, round(mu, 6) + 0.0 AS mean_return, round(std_return, 6) + 0.0 AS std_return, round(gross, 6) + 0.0 AS mean_gross_return, round(cost, 6) + 0.0 AS mean_cost, round(part, 6) + 0.0 AS mean_participation, round(turnover, 6) + 0.0 AS turnover,
  round(breadth, 6) + 0.0 AS breadth, trades AS trade_count, round(sharpe_mean, 6) + 0.0 AS sharpe_mean, round(sr, 6) + 0.0 AS sharpe_total, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt,
  round(sr * sqrt(n - 1) / sqrt(v), 6) + 0.0 AS psr_z, round((sr - sqrt(v / (n - 1)) * {NormalDist().inv_cdf(5 / 6)!r}) / sqrt(v / (n - 1)), 6) + 0.0 AS dsr_z, round(pbo, 6) + 0.0 AS pbo FROM z""")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    return rounded(strategy.evaluated(s.select("symbol", "ts", "signal"), s.select("symbol", "ts", "ret")).drop("psr", "dsr"))


@query()  # its SQL is set below, with the evaluation's
def strategy_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the normal distribution by its series."""
    s = _signals(spark, sf_dir)
    return rounded(strategy.fitness(strategy.evaluated(s.select("symbol", "ts", "signal"), s.select("symbol", "ts", "ret"))).select("symbol", "psr", "dsr", "fitness"))


@query(f"""WITH {_SIGNALS}, k AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS fold FROM q),
d AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol, fold ORDER BY ts)) / 1e6 AS gap FROM k), h AS (SELECT symbol, fold, quantile_cont(gap, 0.5) AS gap, avg(ret) / stddev_pop(ret) * sqrt(31557600 / greatest(quantile_cont(gap, 0.5), 1)) AS sharpe FROM d GROUP BY ALL),
b AS (SELECT symbol, place // 24 AS block, count(*) AS size FROM k GROUP BY ALL), u AS (SELECT b.*, r.i AS run FROM b, range(40) r(i)),
o2 AS (SELECT *, sum(size) OVER (PARTITION BY symbol, run ORDER BY md5(run || '-' || block)) - size AS off FROM u),
m AS (SELECT k.symbol, o2.run, k.ret, o2.off + k.place % 24 AS pos, k.n FROM k JOIN o2 ON k.symbol = o2.symbol AND k.place // 24 = o2.block),
e AS (SELECT symbol, run, ret, CASE WHEN pos < (n % 6) * (n // 6 + 1) THEN pos // (n // 6 + 1) ELSE n % 6 + (pos - (n % 6) * (n // 6 + 1)) // (n // 6) END AS fold FROM m),
s AS (SELECT e.symbol, run, e.fold, avg(ret) / stddev_pop(ret) * sqrt(31557600 / greatest(max(h.gap), 1)) AS sharpe FROM e JOIN h ON h.symbol = e.symbol AND h.fold = e.fold GROUP BY ALL),
x AS (SELECT symbol, run, avg(sharpe) AS sharpe FROM s GROUP BY ALL), y AS (SELECT symbol, avg(sharpe) AS real_sharpe FROM h GROUP BY symbol)
SELECT symbol, round(real_sharpe, 4) + 0.0 AS real_sharpe, round(avg(sharpe), 4) + 0.0 AS null_mean, round((count(*) FILTER (sharpe >= real_sharpe) + 1) / (count(*) + 1), 4) + 0.0 AS p_value, count(*) AS runs FROM x JOIN y USING (symbol) GROUP BY symbol, real_sharpe""")
def permutation_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _signals(spark, sf_dir).select("symbol", "ts", "ret")
    text = lambda run, b: F.md5(F.concat_ws("-", run.cast("string"), b.cast("string")).cast("binary"))
    return rounded(nulls.p_values(nulls.real_sharpe(r), nulls.permuted(r, 40, 24, order=text)), 4)


@query()
def chance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random walks come from a seeded generator, which SQL lacks; the tests hold them against numpy."""
    return rounded(nulls.summary(_signals(spark, sf_dir).select("symbol", "ts", "ret"), runs=20), 4)


_RULE = "div(ret, gap) + GT(gap, 0.5) * 0.25 + AND(GE(vol, 3), LT(ret, 0)) * OR(vol, EQ(gap, 0)) + tanh(-ret)"


@query(f"""WITH {_RET}, q AS (SELECT o.symbol, o.ts, least(ret, 1.0) AS ret, close - open AS gap, volume AS vol FROM o JOIN r USING (symbol, ts)),
v AS (SELECT *, CASE WHEN abs(gap) < 1e-6 THEN CASE WHEN gap < 0 THEN NULL ELSE ret / (sign(gap) * 1e-6 + 1e-6) END ELSE ret / gap END + CAST(gap > 0.5 AS INT) * 0.25 + CAST(vol >= 3 AND ret < 0 AND (vol <> 0 OR gap = 0) AS INT) + tanh(-ret) AS x FROM q),
s AS (SELECT symbol, stddev_pop(coalesce(x, 0)) AS s FROM v GROUP BY symbol)
SELECT symbol, ts, round(tanh(coalesce(x, 0) / CASE WHEN s > 1e-6 THEN s ELSE 1 END), 6) + 0.0 AS signal FROM v JOIN s USING (symbol)""")
def rule_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir).select("symbol", "ts", (F.col("close") - F.col("open")).alias("gap"), F.col("volume").alias("vol"))
    features_of = _returns(spark, sf_dir).withColumn("ret", F.least("ret", F.lit(1.0))).join(o, ["symbol", "ts"])
    return rounded(rules.with_signal(features_of, _RULE).select("symbol", "ts", "signal"))


_BOTH = f"{_MASKS}, y AS (SELECT m.*, CASE WHEN n > 0 THEN 1 WHEN n < 0 THEN -1 ELSE 0 END AS y FROM m JOIN (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS n FROM o) USING (symbol, ts))"


@query(f"""WITH {_BOTH},
s AS (SELECT symbol, unnest(['INSIDE_BAR__0', 'HIGHER_LOW__1', 'CLOSE_ABOVE_PRIOR_LOW__2', 'HIGHER_LOW__1_INSIDE_BAR__0', 'CLOSE_ABOVE_PRIOR_LOW__2_INSIDE_BAR__0', 'CLOSE_ABOVE_PRIOR_LOW__2_HIGHER_LOW__1']) AS k, unnest([a, b, c, a AND b, a AND c, b AND c]) AS h, y FROM y),
t AS (SELECT symbol, k, d, count(*) FILTER (h) / count(*) AS support, count(*) FILTER (h AND y = d) / nullif(count(*) FILTER (h), 0) AS purity, count(*) FILTER (y = d) / count(*) AS base FROM s, (VALUES (1), (-1)) v(d) GROUP BY ALL)
SELECT symbol, k || CASE WHEN d > 0 THEN '__LONG' ELSE '__SHORT' END AS name, CAST(d AS INT) AS direction, round(support, 6) + 0.0 AS support, round(purity / base, 6) + 0.0 AS lift, round(purity, 6) + 0.0 AS purity FROM t WHERE support >= 0.01 AND purity > 0 AND purity / base >= 0.9""")
def motif_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of three predicates, joined with labels and mined for each symbol."""
    o = from_events(spark, sf_dir)
    y = o.select("symbol", "ts", F.coalesce(F.signum(F.lead("close").over(by_time()) - F.col("close")), F.lit(0.0)).cast("int").alias("y"))
    return rounded(motifs.mine_bars(o, y.where("y <> 0"), [(name, {}) for name in _ITEMS], min_lift=0.9, max_size=2).drop("items"))


def _default_specs_sql() -> str:
    other = {"LONG_LOWER_WICK": "coalesce(lw / nullif(tr, 0), 0) >= 0.3", "ROUND_LEVEL_PROXIMITY": _near("round_even(close / 0.01, 0) * 0.01", 0.25)}
    masks = [f"CASE WHEN coalesce({other.get(name, PREDICATES[name][1])}, false) THEN '{name}__{k}' END AS m{k}" for k, (name, _) in enumerate(motifs.DEFAULT_SPECS)]
    return f"""WITH {FIELDS}, m AS (SELECT symbol, ts, {", ".join(masks)} FROM f),
h AS (SELECT m.symbol, list_sort(list_filter([{", ".join(f"m{k}" for k in range(len(motifs.DEFAULT_SPECS)))}], lambda x: x IS NOT NULL)) AS held, CASE WHEN n > 0 THEN 1 WHEN n < 0 THEN -1 ELSE 0 END AS y, row_number() OVER () AS row FROM m JOIN (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS n FROM o) USING (symbol, ts)),
i AS (SELECT symbol, row, y, unnest(held) AS x FROM h), t AS (SELECT symbol, count(*) AS n, count(*) FILTER (y = 1) / count(*) AS up, count(*) FILTER (y = -1) / count(*) AS down FROM h GROUP BY symbol),
s AS (SELECT symbol, y, x AS k FROM i UNION ALL SELECT a.symbol, a.y, a.x || '_' || b.x FROM i a JOIN i b ON a.row = b.row AND a.x < b.x UNION ALL SELECT a.symbol, a.y, a.x || '_' || b.x || '_' || c.x FROM i a JOIN i b ON a.row = b.row AND a.x < b.x JOIN i c ON c.row = a.row AND b.x < c.x),
g AS (SELECT symbol, k, count(*) AS n, count(*) FILTER (y = 1) AS up, count(*) FILTER (y = -1) AS down FROM s GROUP BY ALL),
r AS (SELECT symbol, k, d, g.n / t.n AS support, CASE d WHEN 1 THEN g.up ELSE g.down END / g.n AS purity, CASE d WHEN 1 THEN t.up ELSE t.down END AS base FROM g JOIN t USING (symbol), (VALUES (1), (-1)) v(d))
SELECT symbol, k || CASE WHEN d > 0 THEN '__LONG' ELSE '__SHORT' END AS name, CAST(d AS INT) AS direction, round(support, 6) + 0.0 AS support, round(purity / base, 6) + 0.0 AS lift, round(purity, 6) + 0.0 AS purity FROM r WHERE support >= 0.01 AND purity > 0 AND purity / base >= 1.1"""


@query(_default_specs_sql())
def motifs_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen default predicates, sets of up to three, for each symbol."""
    o = from_events(spark, sf_dir)
    y = o.select("symbol", "ts", F.coalesce(F.signum(F.lead("close").over(by_time()) - F.col("close")), F.lit(0.0)).cast("int").alias("y"))
    return rounded(motifs.mine_bars(o, y).drop("items"))


@query(f"WITH {_RET} SELECT symbol, ts, CAST(ret > 0.001 AS INT) AS motif_0, CAST(ret < -0.001 AS INT) AS motif_1 FROM r")
def motif_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _returns(spark, sf_dir).withColumn("motif_id", F.when(F.col("ret") > 0.001, 0).when(F.col("ret") < -0.001, 1).otherwise(2))
    return features.one_hot(named, [0, 1])


@query(f"""WITH {_RET}, q AS (SELECT symbol, ts, least(ret, 1.0) AS ret FROM r), v AS (SELECT symbol, ts, avg(ret) OVER w AS a, stddev_pop(ret) OVER w AS s, min(ret) OVER w AS lo, max(ret) OVER w AS hi, ret, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))
SELECT symbol, ts, round(a, 6) + 0.0 AS ret_mean, round(s, 6) + 0.0 AS ret_std, round(lo, 6) + 0.0 AS ret_min, round(hi, 6) + 0.0 AS ret_max, round(ret, 6) + 0.0 AS ret_last FROM v WHERE n = 24""")
def motif_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.motif_vectors(_signals(spark, sf_dir).select("symbol", "ts", "ret"), 24))


@query()
def motif_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster numbers are arbitrary: rows only."""
    return features.motif_clusters(_signals(spark, sf_dir).select("symbol", "ts", "ret"), 24, 4, seeds=2)


_RULES = """rr AS (SELECT 'r' || (c_custkey % 40) AS name, string_agg(DISTINCT 'f' || (c_nationkey % 9), ' + ' ORDER BY 'f' || (c_nationkey % 9)) AS expression, avg(c_acctbal) AS dsr FROM customer GROUP BY 1)"""


def _rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    token = F.concat(F.lit("f"), (F.col("c_nationkey") % 9).cast("string"))
    rules_ = c.groupBy(F.concat(F.lit("r"), (F.col("c_custkey") % 40).cast("string")).alias("name")).agg(F.array_join(F.array_sort(F.collect_set(token)), " + ").alias("expression"), F.avg("c_acctbal").alias("dsr"))
    return rules_.select("name", "expression", F.create_map(F.lit("dsr"), "dsr").alias("metadata"))


@query(f"""WITH {_RULES}, t AS (SELECT name, unnest(list_distinct(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*'))) AS k FROM rr UNION ALL SELECT name, 'dsr' FROM rr), n AS (SELECT name, count(*) AS n FROM t GROUP BY name)
SELECT x.name AS a, y.name AS b, round(1 - count(*) / (max(p.n) + max(q.n) - count(*)), 6) + 0.0 AS distance FROM t x JOIN t y ON x.k = y.k AND x.name < y.name JOIN n p ON p.name = x.name JOIN n q ON q.name = y.name GROUP BY ALL""")
def rule_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prototypes.jaccard_distances(prototypes.pattern_stats(_rule_records(spark, sf_dir))))


@query(f"""WITH {_RULES}, t AS (SELECT name, unnest(list_distinct(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*'))) AS k FROM rr)
SELECT name, {", ".join(f"max(CASE WHEN k = 'f{k}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS f{k}" for k in range(9))}, round(max(dsr) / max(norm), 6) + 0.0 AS dsr FROM t JOIN rr USING (name), (SELECT sqrt(sum(dsr * dsr)) AS norm FROM rr) GROUP BY name""")
def rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = prototypes.feature_matrix(prototypes.pattern_stats(_rule_records(spark, sf_dir)))
    return rounded(research.with_columns_of(prototypes.normalized(matrix, ["dsr"]), ["name", *[f"f{k}" for k in range(9)], "dsr"]).na.fill(0.0))


_FEE_FILE = {"venues": {"x": {"spot": {"vip0": {"maker_bps": 1, "taker": 5, "half_spread_bps": 1.5, "impact": 0.5}, "vip1": {"maker": 0.5, "taker_bps": 3}}}}}


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 IN (3, 4) THEN 'vip1' ELSE 'vip0' END AS tier, CASE WHEN l_suppkey % 50 IN (3, 4) THEN 0.5 ELSE 1.0 END::DOUBLE AS fee_maker, CASE WHEN l_suppkey % 50 IN (3, 4) THEN 3.0 ELSE 5.0 END::DOUBLE AS fee_taker,
CASE WHEN l_suppkey % 50 IN (3, 4) THEN 0.0 ELSE 1.5 END::DOUBLE AS fee_half_spread, CASE WHEN l_suppkey % 50 IN (3, 4) THEN 0.0 ELSE 0.5 END::DOUBLE AS fee_impact FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fee_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fees.with_fees(_orders(spark, sf_dir), _FEE_FILE, "x", "spot", {"overrides": {"3": "vip1", "4": "vip1"}})
    return out.select("l_orderkey", "l_linenumber", "tier", "fee_maker", "fee_taker", "fee_half_spread", "fee_impact")


@query(f"WITH {BARS} SELECT o.symbol, o.ts, arg_min(b.bar_id, b.ts) AS bar_id FROM o LEFT JOIN b ON b.symbol = o.symbol AND b.ts >= o.ts AND b.bar_id % 3 = 0 GROUP BY o.symbol, o.ts")
def as_of_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir)
    return research.as_of_forward(o.select("symbol", "ts"), bars.time_bars(o).where("bar_id % 3 = 0"), "bar_id")


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM b),
w AS (SELECT symbol, bar_id, ret AS mean, 0.0::DOUBLE AS cov, 1.0::DOUBLE AS sq FROM n WHERE bar_id = 0
  UNION ALL SELECT n.symbol, n.bar_id, (1 - {2 / 49!r}) * w.mean + {2 / 49!r} * n.ret, (1 - {2 / 49!r}) * (w.cov + (w.mean - ((1 - {2 / 49!r}) * w.mean + {2 / 49!r} * n.ret)) ** 2) + {2 / 49!r} * (n.ret - ((1 - {2 / 49!r}) * w.mean + {2 / 49!r} * n.ret)) ** 2, w.sq * (1 - {2 / 49!r}) ** 2 + {2 / 49!r} ** 2 FROM w JOIN n ON n.symbol = w.symbol AND n.bar_id = w.bar_id + 1),
sigma AS (SELECT n.*, greatest(CASE WHEN n.bar_id > 0 AND w.cov > 0 THEN sqrt(w.cov / (1 - w.sq)) ELSE avg(abs(n.ret)) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS 47 PRECEDING) END, 1e-6) AS s FROM n JOIN w USING (symbol, bar_id)),
g AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last_ts, close * (1 + 2 * s) AS up, close * (1 - 2 * s) AS dn FROM sigma),
nx AS (SELECT g.symbol, g.ts, coalesce(min(n.ts), max(g.last_ts)) AS nts FROM g LEFT JOIN b n ON n.symbol = g.symbol AND n.ts >= g.ts + 43200000000 GROUP BY ALL),
p AS (
  SELECT g.symbol, g.ts, min(q.ts) AS hit_ts FROM g JOIN nx USING (symbol, ts) JOIN b q ON q.symbol = g.symbol AND (q.ts > g.ts AND q.ts <= g.ts + 43200000000 OR q.ts = nx.nts)
  WHERE (q.ts - g.ts >= 7200000000 OR q.ts = g.last_ts) AND (q.close >= g.up OR q.close <= g.dn) GROUP BY ALL)
SELECT g.symbol, CAST(g.bar_id AS BIGINT) AS bar_id, g.ts, coalesce(p.hit_ts, least(g.ts + 43200000000, g.last_ts)) AS t1, CASE WHEN p.hit_ts IS NULL THEN 0 WHEN x.close >= g.up THEN 1 ELSE -1 END AS y, round(g.up, 4) + 0.0 AS up_bar, round(g.dn, 4) + 0.0 AS dn_bar,
  CASE WHEN p.hit_ts IS NULL THEN 'time' WHEN x.close >= g.up THEN 'up' ELSE 'down' END AS hit, round((x.ts - g.ts) / 3.6e9, 4) + 0.0 AS holding_hours, round(x.close, 4) + 0.0 AS exit_price, CAST(x.bar_id AS BIGINT) AS exit_bar_id, round(coalesce(x.close / nullif(g.close, 0) - 1, 0), 4) + 0.0 AS realized_return
FROM g JOIN nx USING (symbol, ts) LEFT JOIN p USING (symbol, ts) JOIN sigma x ON x.symbol = g.symbol AND x.ts = coalesce(p.hit_ts, nx.nts)""")
def triple_barrier_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.triple_barrier(labels.volatility(bars.time_bars(from_events(spark, sf_dir)))), 4)


@query(ORACLES["triple_barrier_ewm"].replace("\nSELECT g.symbol, CAST(g.bar_id", ",\nz AS (SELECT g.symbol, CAST(g.bar_id", 1) + """)
SELECT symbol, count(*) AS rows, round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS class_up, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS class_flat, round(avg(CASE WHEN y = -1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS class_down,
  round(avg(CASE WHEN hit = 'up' THEN 1.0 ELSE 0 END), 6) + 0.0 AS hit_up, round(avg(CASE WHEN hit = 'down' THEN 1.0 ELSE 0 END), 6) + 0.0 AS hit_down, round(avg(CASE WHEN hit = 'time' THEN 1.0 ELSE 0 END), 6) + 0.0 AS hit_time, round(avg(holding_hours), 6) + 0.0 AS avg_holding_hours FROM z GROUP BY symbol""")
def label_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.diagnostics(triple_barrier_ewm(spark, sf_dir)))


def _research_sql() -> str:
    rolled = _rollup_sql((3, 6)).replace(", 6) + 0.0 AS", ", 7) + 0.0 AS")
    own = lambda n: _morph_sql(n).split(f"WITH {OHLCV},\n", 1)[1].replace("FROM o)", "FROM b)")
    only = lambda n: ", ".join(f"w{n}_{x}" for x in ("body_atr", "upper_body", "lower_body", "range_var", "ret_sum", "ret_z", "vol_z", "drawup", "drawdown", "nr_flag"))
    seeds = []
    for name in ("stop_run_reclaim", "trend_pullback"):
        body = ORACLES[f"seed_{name}"].split(f"WITH {FIELDS} ", 1)[1].replace("FROM f", "FROM sf").replace("AS hit", f"AS seed_{name}")
        seeds.append(f"seed_{name} AS ({body})")
    fields = FIELDS.split(",\nf AS (", 1)[1].replace("FROM o)", "FROM b)")
    return f"""WITH {BARS}, rl AS ({rolled}), m3 AS (WITH {own(3)}), m6 AS (WITH {own(6)}), m12 AS (WITH {own(12)}), sf AS ({fields}, {", ".join(seeds)}, lb AS (SELECT symbol, ts, y, realized_return FROM ({ORACLES["triple_barrier_ewm"]}))
SELECT rl.*, b.ts, m3.* EXCLUDE (symbol, ts), m6.* EXCLUDE (symbol, ts), m12.* EXCLUDE (symbol, ts), CAST(s1.seed_stop_run_reclaim AS DOUBLE) AS seed_stop_run_reclaim, CAST(s2.seed_trend_pullback AS DOUBLE) AS seed_trend_pullback, lb.y, lb.realized_return
FROM rl JOIN b ON b.symbol = rl.symbol AND b.bar_id = rl.bar_id JOIN m3 ON m3.symbol = b.symbol AND m3.ts = b.ts JOIN (SELECT symbol, ts, {only(6)} FROM m6) m6 ON m6.symbol = b.symbol AND m6.ts = b.ts JOIN (SELECT symbol, ts, {only(12)} FROM m12) m12 ON m12.symbol = b.symbol AND m12.ts = b.ts
  JOIN seed_stop_run_reclaim s1 ON s1.symbol = b.symbol AND s1.ts = b.ts JOIN seed_trend_pullback s2 ON s2.symbol = b.symbol AND s2.ts = b.ts JOIN lb ON lb.symbol = b.symbol AND lb.ts = b.ts"""


@query(_research_sql())
def research_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan from candles to labelled features of bars."""
    out = research.supervised(research.research(from_events(spark, sf_dir), windows=(3, 6)))
    return rounded(out.withColumn("realized_return", F.round("realized_return", 4)), 7)


def _evaluated_sql(source: str, splits: int, trades: int, trials: int | None, turnover: float, breadth: float) -> str:
    """CTEs from source (symbol, ts, signal, ret), where symbol may stand for a symbol, a run and a rule, to scored: the metrics of strategy.evaluated and the fitness."""
    series = ", ".join(repr(float(c)) for c in strategy._SERIES)
    best = f"{strategy.best_of(trials or splits)!r}"
    phi = f"CASE WHEN dsr_z > 8.3 THEN 1 WHEN dsr_z < -8.3 THEN 0 ELSE 0.5 + dsr_z * exp(-dsr_z * dsr_z / 2) / {math.sqrt(2 * math.pi)!r} * list_reduce([{series}], lambda s, c: s * dsr_z * dsr_z + c) END"
    return f"""ep AS (SELECT *, CASE WHEN abs(signal) > 0.1 THEN sign(signal) ELSE 0 END AS pos FROM {source}),
et AS (SELECT *, coalesce(abs(pos - lag(pos) OVER w), 0) AS turn, pos <> 0 AND coalesce(lag(pos) OVER w, 0) = 0 AS entry FROM ep WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ec AS (SELECT *, least(avg(turn) OVER (PARTITION BY symbol), 1) AS part FROM et),
en AS (SELECT *, pos * ret AS gross, turn * (7 + 0.5 * part) / 10000 AS cost, pos * ret - turn * (7 + 0.5 * part) / 10000 AS net, ntile({splits}) OVER (PARTITION BY symbol ORDER BY ts) AS fold FROM ec),
em AS (SELECT *, avg(net) OVER v AS mu, stddev_samp(net) OVER v AS sd FROM en WINDOW v AS (PARTITION BY symbol)),
ea AS (SELECT symbol, count(*) AS n, max(mu) AS mu, CASE WHEN max(sd) > 0 THEN max(sd) END AS sd, coalesce(avg((net - mu) ** 3) / nullif(max(sd), 0) ** 3, 0) AS skew, coalesce(avg((net - mu) ** 4) / nullif(max(sd), 0) ** 4, 3) AS kurt, avg(turn) AS turnover,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS breadth, count(*) FILTER (entry) AS trades FROM em GROUP BY symbol),
ed AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol, fold ORDER BY ts)) / 1e6 AS gap FROM em),
es AS (SELECT symbol, fold, CASE WHEN stddev_pop(net) <= 1e-12 * greatest(abs(avg(net)), 1e-12) OR quantile_cont(gap, 0.5) IS NULL THEN 0 ELSE avg(net) / stddev_pop(net) * sqrt(31557600 / greatest(quantile_cont(gap, 0.5), 1)) END AS sharpe FROM ed GROUP BY ALL),
ef AS (SELECT symbol, avg(sharpe) AS sharpe_mean, avg(CASE WHEN sharpe <= 0 THEN 1.0 ELSE 0.0 END) AS pbo FROM es GROUP BY symbol),
ez AS (SELECT *, mu / sd AS sr, 1 - skew * (mu / sd) + (kurt - 3) / 4 * (mu / sd) ** 2 AS v FROM ea JOIN ef USING (symbol)),
ey AS (SELECT *, CASE WHEN trades >= {trades} AND v > 0 THEN (sr - sqrt(v / (n - 1)) * {best}) / sqrt(v / (n - 1)) END AS dsr_z, CASE WHEN v > 0 THEN sr * sqrt(n - 1) / sqrt(v) END AS psr_z FROM ez),
ex AS (SELECT *, {phi} AS dsr, {phi.replace("dsr_z", "psr_z")} AS psr FROM ey),
scored AS (SELECT *, coalesce(dsr - {turnover} * turnover + {breadth} * breadth - pbo, '-inf'::DOUBLE) AS fitness FROM ex)"""


ORACLES["strategy_fitness"] = f"""WITH {_SIGNALS}, {_evaluated_sql("g", 6, 10, None, 0.1, 0.1)}
SELECT symbol, round(psr, 6) + 0.0 AS psr, round(dsr, 6) + 0.0 AS dsr, round(fitness, 6) + 0.0 AS fitness FROM scored"""

#: Rules of the population and their SQL.
_POPULATION = {
    "-ret": "-ret", "GT(gap, 0) * 2 + -1": "CAST(gap > 0 AS INT) * 2 - 1", "div(ret, vol) + tanh(gap) * -1": "ret / vol - tanh(gap)", "AND(GE(vol, 3), LT(ret, 0))": "CAST(vol >= 3 AND ret < 0 AS INT)", "OR(GT(vol, 8), GT(ret, 0.9)) * -1": "-CAST(vol > 8 OR ret > 0.9 AS INT)", "0 * ret": "0 * ret",
}
_POP_SQL = " UNION ALL ".join(f"SELECT symbol, {k} AS rule, ts, CAST({x} AS DOUBLE) AS x, ahead FROM v" for k, x in enumerate(_POPULATION.values()))


@query(f"""WITH {_RET}, q AS (SELECT o.symbol, o.ts, least(ret, 1.0) AS ret, close - open AS gap, volume AS vol FROM o JOIN r USING (symbol, ts)),
v AS (SELECT *, coalesce(lead(ret) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ahead FROM q), u AS ({_POP_SQL}),
s AS (SELECT symbol, rule, stddev_pop(x) AS s FROM u GROUP BY ALL), g AS (SELECT symbol || '|' || rule AS symbol, ts, tanh(x / CASE WHEN s > 1e-6 THEN s ELSE 1 END) AS signal, ahead AS ret FROM u JOIN s USING (symbol, rule)),
{_evaluated_sql("g", 6, 10, None, 0.5, 1.0)}
SELECT split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS INT) AS rule, n, round(mu, 6) + 0.0 AS mean_return, round(turnover, 6) + 0.0 AS turnover, round(breadth, 6) + 0.0 AS breadth, trades AS trade_count, round(sharpe_mean, 6) + 0.0 AS sharpe_mean, round(sr, 6) + 0.0 AS sharpe_total,
  round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt, round(psr_z, 6) + 0.0 AS psr_z, round(dsr_z, 6) + 0.0 AS dsr_z, round(dsr, 6) + 0.0 AS dsr, CASE WHEN trades >= 10 THEN round(pbo, 6) + 0.0 END AS pbo, round(fitness, 6) + 0.0 AS fitness,
  row_number() OVER (PARTITION BY split_part(symbol, '|', 1) ORDER BY fitness DESC, CAST(split_part(symbol, '|', 2) AS INT)) AS place FROM scored""")
def rule_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules in one plan, each held against the next return and ranked within its symbol; some win and some lose."""
    o = from_events(spark, sf_dir).select("symbol", "ts", (F.col("close") - F.col("open")).alias("gap"), F.col("volume").alias("vol"))
    rows = _returns(spark, sf_dir).withColumn("ret", F.least("ret", F.lit(1.0))).join(o, ["symbol", "ts"])
    rows = rows.withColumn("ahead", F.coalesce(F.lead("ret").over(by_time()), F.lit(0.0)))
    scored = population.assessed(rows, rows.select("symbol", "ts", F.col("ahead").alias("ret")), list(_POPULATION), 0.5, 1.0, ["ret", "gap", "vol"])
    kept = ["symbol", "rule", "n", "mean_return", "turnover", "breadth", "trade_count", "sharpe_mean", "sharpe_total", "skew", "kurt", "psr_z", "dsr_z", "dsr", "pbo", "fitness", "place"]
    return rounded(population.ranked(scored).select(*kept))


_GUARD = guardrail.GuardRules(runs=4, min_trades=20, threshold=-0.5, ratio=0.4, least_fit=0.2, trials=None)
_GUARD_RULES = {"direction * -1": "-direction", "direction": "direction", "GT(w3_vol_z, 0) * 2 + -1": "CAST(w3_vol_z > 0 AS INT) * 2 - 1", "w3_ret_z * -1": "-w3_ret_z", "OR(GT(body, 20), LT(w3_ret_sum, 0))": "CAST(body > 20 OR w3_ret_sum < 0 AS INT)"}


def _uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT + 0.5) / {2.0**52!r})"


def _normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(*parts, repr('a'))})) * cos({2 * math.pi!r} * {_uniform(*parts, repr('b'))}))"


def _guard_sql() -> str:
    real = BARS.replace("o AS (", "o0 AS (", 1).split("\ne AS (", 1)
    own = ("symbol", "run", "k")
    walk = f"""wj AS (SELECT symbol, run, unnest(range(greatest(n, 10))) AS k FROM (SELECT symbol, count(*) AS n FROM o0 GROUP BY symbol), range(1, {_GUARD.runs + 1}) t(run)),
wc AS (SELECT *, 100 * exp(sum({_normal("'r'", *own)} * 0.01) OVER (PARTITION BY symbol, run ORDER BY k)) AS close FROM wj),
wo AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, run ORDER BY k), 100.0) AS open FROM wc),
o AS (SELECT symbol || '#0' AS symbol, * EXCLUDE (symbol) FROM o0 UNION ALL BY NAME SELECT symbol || '#' || run AS symbol, CAST({guardrail.START_US} + k * 3600000000 AS BIGINT) AS ts, open, greatest(open, close) * (1 + 0.005 * {_uniform("'h'", *own)}) AS high, least(open, close) * (1 - 0.005 * {_uniform("'l'", *own)}) AS low, close, exp({_normal("'v'", *own)} * 0.1) AS volume FROM wo)"""
    series = f"{real[0]}\n{walk},\ne AS ({real[1]}"
    morph = _morph_sql(3, False).split("\nd AS (", 1)[1].replace("FROM o)\nSELECT", "FROM b),\nmf AS (SELECT", 1).replace("FROM d", "FROM md")
    labelled = ORACLES["triple_barrier_ewm"].split(f"{BARS}, ", 1)[1].split("\nSELECT g.symbol", 1)[0].replace("n AS (", "n AS MATERIALIZED (", 1)
    rules_sql = " UNION ALL ".join(f"SELECT symbol || '|{k}' AS symbol, ts, CAST({x} AS DOUBLE) AS x, ret FROM fr" for k, x in enumerate(_GUARD_RULES.values()))
    hit = f"isfinite(s.fitness) AND s.trades >= {_GUARD.min_trades} AND s.fitness >= {_GUARD.threshold} AND r.fitness > 0 AND s.fitness / r.fitness >= {_GUARD.ratio} AND s.trades / greatest(r.trades, 1) <= {_GUARD.trade_ratio}"
    return f"""WITH RECURSIVE {series},
md AS ({morph}),
{labelled},
lab AS (SELECT g.symbol, g.ts, coalesce(x.close / nullif(g.close, 0) - 1, 0) AS ret FROM g JOIN nx USING (symbol, ts) LEFT JOIN p USING (symbol, ts) JOIN sigma x ON x.symbol = g.symbol AND x.ts = coalesce(p.hit_ts, nx.nts)),
fr AS (SELECT * FROM mf JOIN lab USING (symbol, ts)), u AS ({rules_sql}), us AS (SELECT symbol, stddev_pop(coalesce(x, 0)) AS s FROM u GROUP BY symbol),
src AS (SELECT symbol, ts, tanh(coalesce(x, 0) / CASE WHEN s > 1e-6 THEN s ELSE 1 END) AS signal, ret FROM u JOIN us USING (symbol)),
{_evaluated_sql("src", _GUARD.splits, _GUARD.min_trades, _GUARD.trials, _GUARD.turnover_weight, _GUARD.breadth_weight)},
k AS (SELECT split_part(symbol, '#', 1) AS sym, CAST(split_part(split_part(symbol, '#', 2), '|', 1) AS INT) AS run, CAST(split_part(symbol, '|', 2) AS INT) AS rule, fitness, trades FROM scored),
a AS (SELECT r.sym, r.rule, any_value(r.fitness) AS fit, any_value(r.trades) AS trades, max(s.fitness) FILTER (isfinite(s.fitness)) AS top, count(*) FILTER ({hit}) AS hits, count(*) FILTER (isfinite(s.fitness)) AS runs, avg(s.fitness) FILTER (isfinite(s.fitness)) AS mean FROM k r JOIN k s ON s.sym = r.sym AND s.rule = r.rule AND s.run > 0 WHERE r.run = 0 GROUP BY ALL),
j AS (SELECT *, isfinite(fit) AND fit > 0 AND trades >= {_GUARD.min_trades} AS judged, isfinite(fit) AND fit > 0 AND trades >= {_GUARD.min_trades} AND hits >= {_GUARD.hits} AND fit >= {_GUARD.least_fit} AS leak FROM a),
fl AS (SELECT *, min(rule) FILTER (leak) OVER (PARTITION BY sym) AS first FROM j)
SELECT sym AS symbol, round(max(fit) FILTER (isfinite(fit)), 5) + 0.0 AS real_best_fitness, round(max(top) FILTER (judged AND rule <= coalesce(first, rule)), 5) + 0.0 AS synthetic_max_positive_fitness, round(max(top), 5) + 0.0 AS synthetic_max_overall_fitness, {_GUARD.runs} AS synthetic_runs,
  coalesce(bool_or(leak), false) AS flagged, CAST(max(first) AS INT) AS leak_rule, max(hits) FILTER (rule = first) AS leak_hits, max(runs) FILTER (rule = first) AS leak_runs, round(max(mean) FILTER (rule = first), 5) + 0.0 AS leak_mean FROM fl GROUP BY sym"""


@query(_guard_sql())
def guardrail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules over the hourly candles' bars and over four random walks for each symbol: which symbols are flagged."""
    scored = guardrail.assessed(from_events(spark, sf_dir), list(_GUARD_RULES), _GUARD, 3_600_000_000, windows=(3,))
    out = guardrail.checks(guardrail.held_against(scored, _GUARD), _GUARD)
    leak = [F.col(f"leak_rule.{a}").alias(b) for a, b in (("rule", "leak_rule"), ("hits_above_threshold", "leak_hits"), ("runs", "leak_runs"), ("synthetic_mean", "leak_mean"))]
    return rounded(out.select("symbol", "real_best_fitness", "synthetic_max_positive_fitness", "synthetic_max_overall_fitness", "synthetic_runs", "flagged", *leak), 5)
