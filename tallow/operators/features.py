"""Candle morphology over rolling windows, and its roll-up to bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, by_time, full, last_rows, ratio, require_columns
from ..functions.rolling import with_rolling
from ..sources.tables import settled


def morphology(candles: DataFrame, windows: tuple[int, ...] = (60, 120, 240, 360)) -> DataFrame:
    """(symbol, ts, 8 base columns, 10 of each window); what cannot be told is 0. All windows of a symbol share one sort."""
    require_columns(candles, "symbol", "ts", "open", "high", "low", "close", "volume")
    c, zero = F.col, F.lit(0.0)
    df = candles.withColumns({
        "body": F.abs(c("close") - c("open")), "direction": F.signum(c("close") - c("open")), "wick_upper": c("high") - F.greatest("open", "close"),
        "wick_lower": F.least("open", "close") - c("low"), "tr": F.nullif(c("high") - c("low"), zero),
        "ret": F.coalesce(ratio(c("close"), F.lag("close").over(by_time())) - 1, zero),
    })
    angle = F.floor(F.pmod("ts", F.lit(DAY_US)) / 1_000_000) * (2 * math.pi / 86_400)
    out = {"tod_sin": F.sin(angle), "tod_cos": F.cos(angle), "direction": c("direction"), "range": c("tr"), "body": c("body"), "wick_upper": c("wick_upper"), "wick_lower": c("wick_lower")}
    df = df.withColumn("cum_return", F.sum("ret").over(by_time()))
    stats = {"tr": ("avg", "var_samp"), "ret": ("sum", "avg", "stddev_pop"), "volume": ("avg", "stddev_pop"), "close": ("min", "max")}
    wanted = {f"__{kind}_{x}_{n}": (x, n, kind) for n in windows for x, kinds in stats.items() for kind in kinds}
    df = with_rolling(df, wanted | {f"__p20_{n}": ("tr", n, "quantile", 0.2) for n in windows})
    out["cum_return"], body = c("cum_return"), F.nullif(c("body"), zero)
    for n in windows:
        p, of = f"w{n}_", lambda kind, x, n=n: c(f"__{kind}_{x}_{n}")
        low, high = of("min", "close"), of("max", "close")
        out |= {
            p + "body_atr": ratio(c("body"), of("avg", "tr")), p + "upper_body": ratio(c("wick_upper"), body), p + "lower_body": ratio(c("wick_lower"), body),
            p + "range_var": of("var_samp", "tr"), p + "ret_sum": of("sum", "ret"),
            p + "ret_z": ratio(c("ret") - of("avg", "ret"), of("stddev_pop", "ret")), p + "vol_z": ratio(c("volume") - of("avg", "volume"), of("stddev_pop", "volume")),
            p + "drawup": ratio(c("close") - low, low), p + "drawdown": ratio(high - c("close"), high),
            p + "nr_flag": F.when(c("tr") <= c(f"__p20_{n}"), 1).otherwise(0),
        }
    return df.select("symbol", "ts", *[F.coalesce(x, F.lit(0 if k.endswith("nr_flag") else 0.0)).alias(k) for k, x in out.items()])


#: Words in a column's name that make its roll-up a maximum, fixed values.
MAXIMA = ["upper", "lower", "wick", "body", "range_var", "vol_z", "ret_z", "drawup", "drawdown"]


def reducers(name: str) -> list[str]:
    """How a feature column is rolled up to bars, by its name."""
    out = ["sum"] * name.endswith("nr_flag") + ["max"] * any(x in name for x in MAXIMA) + ["sum"] * ("ret_sum" in name) + ["last"] * name.endswith(("direction", "cum_return"))
    return list(dict.fromkeys(out)) or ["mean"]


def rollup(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """(symbol, bar_id, {column}_{reducer} ..) of features (symbol, ts, ..) by mapping (symbol, timestamp, bar_id)."""
    rows = features.join(mapping.withColumnRenamed("timestamp", "ts"), ["symbol", "ts"])
    make = {"sum": F.sum, "max": F.max, "mean": F.avg, "last": lambda x: F.max_by(x, "ts")}
    columns = [x for x in features.columns if x not in ("symbol", "ts")]
    return rows.groupBy("symbol", "bar_id").agg(*[make[f](x).alias(f"{x}_{f}") for x in columns for f in reducers(x)])


def motif_vectors(features: DataFrame, window: int, columns: list[str] | None = None) -> DataFrame:
    """(symbol, ts, {column}_{mean, std, min, max, last} ..) over full windows of so many rows; rows that lack a value are left out."""
    columns = columns or [c for c in features.columns if c not in ("symbol", "ts")]
    n, w = max(window, 1), last_rows(max(window, 1))
    value = {c: F.col(f"`{c}`").try_cast("double") for c in columns}
    out = {f"{c}_{k}": full(value[c], f(value[c]).over(w), n) for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))}
    return features.select("symbol", "ts", *[x.alias(k) for k, x in out.items()], *[value[c].alias(f"{c}_last") for c in columns]).dropna()


def motif_clusters(features: DataFrame, window: int, clusters: int, columns: list[str] | None = None, seeds: int = 10, path: str | None = None) -> DataFrame:
    """(symbol, ts, motif_id): k-means over motif_vectors, the best of several seeds by its cost. The vectors are made once and kept, with path as a table there."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = motif_vectors(features, window, columns)
    if path:
        rows.write.mode("overwrite").parquet(path)
        rows = rows.sparkSession.read.parquet(path)
    else:
        rows = settled(rows)
    if rows.isEmpty():
        raise ValueError("no full window of observations")
    points = VectorAssembler(inputCols=[c for c in rows.columns if c not in ("symbol", "ts")], outputCol="__v").transform(rows)
    fits = [KMeans(k=clusters, seed=s, featuresCol="__v", predictionCol="motif_id").fit(points) for s in range(42, 42 + seeds)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(points).select("symbol", "ts", "motif_id")


def one_hot(motifs: DataFrame, universe: list[int]) -> DataFrame:
    """(symbol, ts, motif_{id} ..), 1 where a row is of the motif, else 0."""
    return motifs.select("symbol", "ts", *[(F.col("motif_id") == k).cast("int").alias(f"motif_{k}") for k in universe])


def states(df: DataFrame, column: str = "ret", low: float = -0.001, high: float = 0.001) -> DataFrame:
    """df with state: U above high, D below low, else F."""
    return df.withColumn("state", F.when(F.col(column) > high, "U").when(F.col(column) < low, "D").otherwise("F"))
