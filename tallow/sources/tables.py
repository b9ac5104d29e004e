"""Tables between steps of a plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's checkpoint folder, for what several steps read; any executor can read it again.

    The folder is spark.checkpoint.dir; where it is unset, local masters get a
    local folder, and on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors of {sc.master} share no local folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tallow-"))
    return df.checkpoint()
