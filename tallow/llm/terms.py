"""Sums over a text's terms of values that a corpus-wide table gives each term.

Terms are counted in tasks and summed by key. The most frequent terms, a number
with a bound, are broadcast with their values, so no frequent term is a join key
and its part of every text's sum is made where the text is read. The other terms
are rare by construction; their occurrences are joined with the whole table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most terms that are broadcast.
HEAD = 1 << 18
_FLUSH = 200_000


def term_counter(split: Callable[[bytes], list]):
    """For mapInArrow over (text binary): (term, c), each task's terms summed up to _FLUSH distinct ones at a time."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py() or b""))
                if len(counts) >= _FLUSH:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return run


def head_floor(counts: DataFrame, most: int = HEAD) -> int:
    """The least count c such that at most most rows of counts (c) reach it."""
    level = F.floor(F.log2("c") * 16)
    got = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect()  # 1000 levels at most
    floor, n = 1 << 62, 0
    for r in got:
        n += r["n"]
        if n > most:
            break
        floor = r["c"]
    return floor
