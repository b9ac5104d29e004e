"""Candle stores, other tables and sinks as files that Spark reads and writes, wherever they lie."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candles import PRICES, between, read_klines, write_candles


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, which may hold wildcards, matches a file in whichever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def require_root(spark: SparkSession, root: str) -> str:
    """The root, which must exist."""
    if not path_exists(spark, root):
        raise FileNotFoundError(f"no data root {root}")
    return root


@dataclass(frozen=True)
class CandleSpec:
    """Where a symbol's candles lie; path may be any function of the symbol."""

    symbol: str
    root: str
    path: Callable[[str, str], str] = lambda root, symbol: f"{root}/symbol={symbol}"

    def location(self) -> str:
        return self.path(self.root, self.symbol)


@dataclass(frozen=True)
class CandleStore:
    """Candles of several symbols; load filters by symbol and by time, both ends included, and the filters reach the files."""

    specs: tuple[CandleSpec, ...]
    frame: DataFrame | None = None

    @classmethod
    def of(cls, root: str, symbols: list[str]) -> CandleStore:
        return cls(tuple(CandleSpec(s, root) for s in symbols))

    @classmethod
    def in_memory(cls, candles: DataFrame) -> CandleStore:
        """The same over a frame at hand."""
        return cls((), candles)

    def missing(self, spark: SparkSession) -> list[str]:
        """What is wrong with the files: symbols without any, and symbols whose files lack a column."""
        wrong = []
        for s in self.specs:
            if not path_exists(spark, s.location()):
                wrong.append(f"{s.symbol}: no files")
            elif lacking := {"ts", *PRICES} - set(spark.read.parquet(s.location()).columns):
                wrong.append(f"{s.symbol}: no {', '.join(sorted(lacking))}")
        return wrong

    def load(self, spark: SparkSession, symbols: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        if self.frame is not None:
            return between(self.frame, start, end, symbols)
        chosen = [s for s in self.specs if symbols is None or s.symbol in symbols]
        if not chosen:
            raise KeyError(f"no symbols {symbols}")
        roots: dict[str, list[CandleSpec]] = {}
        own = []
        for s in chosen:  # the usual layout is one scan of a root's folders; other paths are read one by one
            usual = s.location() == f"{s.root}/symbol={s.symbol}"
            roots.setdefault(s.root, []).append(s) if usual else own.append(s)
        parts = [spark.read.option("basePath", r).parquet(*[s.location() for s in some]).select(F.col("symbol").cast("string").alias("symbol"), "ts", *PRICES) for r, some in roots.items()]
        parts += [spark.read.parquet(s.location()).select(F.lit(s.symbol).alias("symbol"), "ts", *PRICES) for s in own]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return between(out, start, end)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, sorted, in whichever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(f.getPath()) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def month_files(spark: SparkSession, root: str, months: list[str], symbols: list[str] | None = None, pattern: str = "{root}/{symbol}/1m/{symbol}-1m-{month}.csv", limit: int | None = None) -> list[str]:
    """The files of these months that exist, by symbol and month; all symbols below root unless some are named, the first so many of them with a limit.

    A month's files are listed at once.
    """
    found = set()
    for m in months:
        named = re.escape(pattern.format(root="", symbol="\0", month=m)).split(re.escape("\0"))
        shape = re.compile(named[0] + "([^/]+)" + "".join(part + r"\1" for part in named[1:-1]) + named[-1] + "$")
        for path in glob(spark, pattern.format(root=root, symbol="*", month=m)):
            if (hit := shape.search(path)) and (symbols is None or hit[1] in symbols):
                found.add((hit[1], m))
    chosen = sorted({s for s, _ in found})[:limit]
    return [pattern.format(root=root, symbol=s, month=m) for s, m in sorted(found) if s in chosen]


def month_range(first: str, last: str) -> list[str]:
    """Months from first to last as yyyy-mm, both included."""
    (y, m), (y2, m2) = (map(int, x.split("-")) for x in (first, last))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(12 * y + m - 1, 12 * y2 + m2)]


def csv_to_parquet(spark: SparkSession, paths: list[str] | str, out: str, symbol: str | None = None) -> None:
    """Exchange candle files to Parquet by symbol and month."""
    write_candles(read_klines(spark, paths, symbol), out)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or Parquet table, by the path's ending. Without a schema a CSV table is read once more to find its types."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither CSV nor Parquet: {path}")


def time_column(df: DataFrame) -> Column:
    """Epoch microseconds of column ts or timestamp, whichever there is."""
    types = dict(df.dtypes)
    for name in ("ts", "timestamp"):
        kind = types.get(name)
        if kind == "bigint":
            return F.col(name)
        if kind and (kind.startswith("timestamp") or kind in ("date", "string")):
            return F.unix_micros(F.col(name).cast("timestamp"))
    raise TypeError("no time column")


def read_orders(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(ts, side, price, quantity, maker, participation ..): missing flags are false and 0."""
    df = read_table(spark, path, schema)
    for name, default in (("maker", F.lit(False)), ("participation", F.lit(0.0))):
        df = df if name in df.columns else df.withColumn(name, default)
    return df.withColumn("ts", time_column(df))


def read_labels(spark: SparkSession, path: str, value: str = "y", schema: str | None = None) -> DataFrame:
    """(ts, y)."""
    df = read_table(spark, path, schema)
    return df.select(time_column(df).alias("ts"), F.col(value).cast("int").alias("y"))


def read_returns(spark: SparkSession, path: str, value: str = "returns") -> DataFrame:
    """(symbol, ts, ret) of one or many files, named for their symbol up to the first underscore."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no returns at {path}")
    df = spark.read.parquet(path)
    return df.select(F.split_part(F.col("_metadata.file_name"), F.lit("_"), F.lit(1)).alias("symbol"), time_column(df).alias("ts"), F.col(value).cast("double").alias("ret"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(name, expression, fitness, metadata) of JSON rule records, an array in each file."""
    return spark.read.json(path, schema="name string, expression string, fitness double, metadata map<string,double>", multiLine=True)


def best_rule(rules: DataFrame) -> DataFrame:
    """The rule of the highest finite fitness."""
    finite = F.col("fitness").isNotNull() & ~F.isnan("fitness") & (F.abs("fitness") < float("inf"))
    return rules.where(finite).orderBy(F.desc("fitness"), "name").limit(1)


def read_config(spark: SparkSession, path: str) -> dict | list:
    """A YAML or JSON document, read by Spark's readers."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no configuration {path}")
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def finite(df: DataFrame) -> DataFrame:
    """df with null in place of nan and infinities, which JSON cannot hold; in maps too."""
    good = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = {"double": good, "map<string,double>": lambda x: F.transform_values(x, lambda _, v: good(v))}
    return df.select(*[out[t](F.col(f"`{c}`")).alias(c) if t in out else F.col(f"`{c}`") for c, t in df.dtypes])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    finite(df).write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays become comma-separated text."""
    flat = [F.concat_ws(",", f"`{c}`").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, header=True)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows beside those that the folder holds already; nothing is read or rewritten."""
    write_csv(df, path, "append")


def write_months(df: DataFrame, root: str, keys: DataFrame | None = None) -> None:
    """df as Parquet by symbol and month, over whatever those partitions hold; other partitions stay.

    Once all is committed the keys (symbol, month; those of df unless given, so
    that a month without rows counts too) are marked as done below root/_done,
    which readers of root do not see. A run that is lost before that leaves its
    keys undone, and the next writes their partitions anew.
    """
    keys = df.select("symbol", "month").distinct() if keys is None else keys.select("symbol", "month")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(root)
    keys.select(F.col("symbol").cast("string").alias("symbol"), F.col("month").cast("string").alias("month")).write.mode("append").parquet(f"{root}/_done")


def undone(spark: SparkSession, keys: DataFrame, root: str, force: bool = False) -> DataFrame:
    """The keys (symbol, month) that are not marked as done below root, or all if force: marked by write_months, or by a file _SUCCESS in their folder."""
    if force:
        return keys
    marks = [re.search(r"/symbol=([^/]*)/month=([^/]*)/_SUCCESS$", p).groups() for p in glob(spark, f"{root}/symbol=*/month=*/_SUCCESS")]
    done = spark.createDataFrame(marks, "symbol string, month string")
    if path_exists(spark, f"{root}/_done/*.parquet"):
        done = done.unionByName(spark.read.schema("symbol string, month string").parquet(f"{root}/_done"))
    return keys.join(done, ["symbol", "month"], "left_anti")


def merged_csv(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All CSV outputs below root with the columns of their folders (symbol, month, cluster ..); empty files give no rows."""
    return spark.read.csv(root, header=True, schema=schema)


def merged(frames: list[DataFrame]) -> DataFrame:
    """Frames of different columns, one below another; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
