"""Helpers shared by the corpus operators: word splitting, written tables, task-side loops."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; bytes.split() splits on the same six characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The white-space separated words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, local masters get a local folder; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors of {master} share no local folder")
        path = tempfile.mkdtemp(prefix="tallow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables that this process has written and not yet removed.
_KEPT: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, any executor can reread it, and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables written() has made and clear() has not removed: a mark for clear()."""
    return len(_KEPT)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables that written() has made since a mark. Only for when no frame that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_KEPT) > since:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, for working columns beside whatever the caller's table carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, equals remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def broadcast_if_small(df: DataFrame, bound: int) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
