"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Quality rules drop documents, near-duplicate grouping keeps one of each group,
decontamination drops those that overlap the benchmark, mixing repeats and drops
documents towards the sources' targets, sharding adds the column shard. All but
the last return the columns of documents. Nulls, repeated rows, empty tables and
other columns are treated as the operators' docstrings state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallow.llm.common import clear, shared_dir, table, tables_made
from tallow.llm.decontaminate import drop_contaminated
from tallow.llm.minmax import drop_near
from tallow.llm.mixing import take_mix
from tallow.llm.quality import keep_good
from tallow.llm.sharding import with_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_shards(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Min-max hashing, apportionment and the k-d tree have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = tables_made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            clear(spark, mark)  # the stage's own tables; its result is written
    return docs
