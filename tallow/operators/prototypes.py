"""Mined rules as feature rows: their tokens and metrics, one-hot matrix, distances between rules, states and signals."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import tokens


def pattern_stats(records: DataFrame) -> DataFrame:
    """(name, expression, items, metrics) of rule records (name, expression, metadata map<string, double>): tokens and metadata's keys; metrics without nulls and nans."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,double>"))
    keep = F.map_filter(meta, lambda _, v: v.isNotNull() & ~F.isnan(v))
    return records.select("name", "expression", F.concat(tokens(F.col("expression")), F.array_sort(F.map_keys(meta))).alias("items"), keep.alias("metrics"))


def feature_matrix(stats: DataFrame) -> DataFrame:
    """(name, a column for each item and metric): 1 for an item, a metric's value in its place, 0 where a rule lacks it."""
    items = stats.select("name", F.explode("items").alias("k")).distinct().withColumn("v", F.lit(1.0))
    metrics = stats.select("name", F.explode("metrics").alias("k", "m"))
    cells = items.join(metrics, ["name", "k"], "full").select("name", "k", F.coalesce("m", "v").alias("v"))
    return stats.select("name").distinct().join(cells.groupBy("name").pivot("k").agg(F.first("v")), "name", "left").na.fill(0.0)


def normalized(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """matrix with the named columns over their Euclidean norms; a column of zeros stays."""
    norms = matrix.agg(*[F.sqrt(F.sum(F.col(f"`{c}`") ** 2)).alias(f"n{k}") for k, c in enumerate(columns)]).first() if columns else []
    return matrix.withColumns({c: F.col(f"`{c}`") / (norms[k] or 1.0) for k, c in enumerate(columns)})


def jaccard_distances(stats: DataFrame) -> DataFrame:
    """(a, b, distance) of rules a < b that share an item; all other pairs are at distance 1. Pairs come from a join on items, not from all pairs."""
    items = stats.select("name", F.explode(F.array_distinct("items")).alias("k"))
    n = items.groupBy("name").agg(F.count("*").alias("n"))
    shared = items.alias("x").join(items.alias("y"), F.expr("x.k = y.k and x.name < y.name")).groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count("*").alias("both"))
    sized = shared.join(n.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("distance"))


def fit_states(features: DataFrame, label: str = "state", trees: int = 100, depth: int = 6, seed: int = 42, estimator: Estimator | None = None) -> PipelineModel:
    """A classifier from every numeric column but the times to the label: a random forest, or any estimator of Spark's that gives probabilities."""
    inputs = [c for c, t in features.dtypes if c not in (label, "ts", "timestamp", "symbol") and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    vectors = VectorAssembler(inputCols=inputs, outputCol="__v")
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(features)
    chosen = estimator.copy() if estimator is not None else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    chosen.setParams(featuresCol="__v", labelCol="__y", predictionCol="__p")
    named = IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels)
    return PipelineModel([vectors, chosen.fit(vectors.transform(index.transform(features))), named])


def predicted(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with predicted, the likeliest state, and probability, an array in the order of the states' names."""
    return model.transform(features).select(*features.columns, "predicted", vector_to_array("probability").alias("probability"))


def to_signal(states: DataFrame, column: str = "predicted", mapping: dict[str, float] | None = None) -> DataFrame:
    """states with signal: 1 for upturn, -1 for downturn, 0 for all else, or as mapped."""
    value = F.lit(0.0)
    for name, x in (mapping or {"upturn": 1.0, "downturn": -1.0}).items():
        value = F.when(F.col(column) == name, float(x)).otherwise(value)
    return states.withColumn("signal", value)

