"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target share of the words to take, capped at two passes
over the source. The words of the mix are cut into blocks of equal size, and the
blocks go to the sources with the highest quotients target / (2 k + 1). A
source's words, in a seeded order of its documents, are a run of blocks, the
last one shorter. A quota above the run's length takes the whole run first; what
is left of it takes blocks from the run's beginning, that is in seeded order.
A source's blocks are dealt to the shards in turn, so that its quotas in any two
shards differ by one at most.

Defined results: a null text has no words and none are taken; a null source is
a source of its own, last in order; rows alike in id and text lie one after
another; with no words at all every target is 0; a source whose target is under
half a block may get none; empty tables give no rows; other columns play no part
and may have any name. Texts are only split into words, row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, words, written


@dataclass(frozen=True)
class MixRules:
    #: Weights of the sources in the order of their names, repeating.
    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    shards: int = 8
    #: Words of a block; a source's taken words are off its target by about half of it.
    block: int = 64
    seed: int = 11


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their 0-based place in the order of names, null last, without sorting all in one task."""
    null = F.col("source").isNull().cast("int").alias("null")
    part = written(sources.select("*", null).orderBy("null", "source").withColumn("part", F.spark_partition_id()))
    heads = part.groupBy("part").count()
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    heads = heads.select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("null", "source")) - 1
    return part.join(F.broadcast(heads), "part").withColumn("rank", F.col("before") + place).drop("part", "before", "null")


def targets(sources: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """sources (source, source_size) with weight and target: shares by weight, capped, the excess dealt again until none is above."""
    weight = F.element_at(F.lit([float(x) for x in rules.weights]), (F.col("rank") % len(rules.weights)).cast("int") + 1)
    s = written(_ranked(sources).withColumn("weight", weight))
    cap = F.col("source_size") * rules.most
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * rules.share
    level, capped = 0.0, -1
    while True:  # each round caps at least one source more
        full = cap <= F.col("weight") * level if capped >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("done"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, level = r["n"], (total - r["done"]) / r["open"]
    return s.withColumn("target", F.least(cap, F.col("weight") * level).cast("double"))


def apportioned(aims: DataFrame, seats: int) -> DataFrame:
    """aims with quota: seats by Sainte-Lague, that is target / d rounded half up for the divisor d that deals all seats.

    The divisor is narrowed by 64 candidates a pass over the sources; seats left
    by ties go to the highest quotients, then the first names.
    """
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    if not total or not seats:
        return aims.withColumn("quota", F.lit(0).cast("long"))
    dealt = lambda d: F.floor(F.col("target") / d + 0.5)
    low, high = 0.0, 4.0 * total  # too many seats, and none
    for _ in range(12):
        step = [low + (high - low) * k / 64 for k in range(1, 64)]
        got = aims.agg(*[F.sum(dealt(d)).alias(f"d{k}") for k, d in enumerate(step)]).first()
        few = next((k for k, n in enumerate(got) if n <= seats), 63)
        low, high = ([low, *step][few], [*step, high][few])
        if few < 63 and got[few] == seats or high - low <= 1e-12 * high:
            break
    quota = aims.withColumn("quota", dealt(high).cast("long"))
    left = seats - quota.agg(F.sum("quota")).first()[0]
    if left > 0:
        extra = quota.withColumn("q", F.col("target") / (2 * F.col("quota") + 1)).orderBy(F.desc("q"), "rank").limit(left).select("rank", F.lit(1).alias("more"))
        quota = quota.join(extra, "rank", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")
    return quota


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def mix_plan(sized: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """A row for each source of sized (source, size, h), h being a row's place in the seeded order.

    source, source_size, n (rows), rank, weight, target, quota (blocks), run (blocks of
    a pass), passes (whole passes), extra (blocks of the last, partial pass).
    """
    aims = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), rules))
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    plan = apportioned(aims, round(total / rules.block)).withColumn("run", F.ceil(F.col("source_size") / rules.block).cast("long"))
    plan = plan.withColumn("quota", F.least("quota", F.floor(F.col("run") * rules.most).cast("long")))
    passes = F.when(F.col("run") > 0, F.floor(F.col("quota") / F.col("run"))).otherwise(0).cast("long")
    return written(plan.withColumn("passes", passes).withColumn("extra", F.col("quota") - F.col("passes") * F.col("run")))


def _slices(sized: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """sized with key and slice, a range of the seeded order of few rows, and (key, slice, before): the words of a source's earlier slices. most: rows of the largest source."""
    bits = min(max(round(math.log2(max(most, 1) / 200)), 1), 20)
    sized = sized.withColumn("key", _key()).withColumn("slice", F.shiftright(F.col("h"), 62 - bits))
    sums = sized.groupBy("key", "slice").agg(F.sum("size").alias("z"))
    before = F.sum("z").over(Window.partitionBy("key").orderBy("slice")) - F.col("z")
    return sized, sums.select("key", "slice", "z", before.alias("before"))


def _edges(sized: DataFrame, plan: DataFrame, rules: MixRules) -> DataFrame:
    """plan with edge and edge_take: of the rows with h below edge the partial pass takes all words, of those at edge edge_take."""
    s = plan.agg(F.max("n").alias("n"), F.count("*").alias("s")).first()
    rest = F.least(F.col("extra") * rules.block, F.col("source_size"))
    plan = plan.withColumn("rest", rest).withColumn("key", _key())
    sized, slices = _slices(sized, s["n"] or 0)
    slices = slices.join(plan.select("key", "rest"), "key").where("before <= rest and rest < before + z").select("key", "slice", "before", "rest")
    inside = sized.join(F.broadcast(slices) if s["s"] <= 100_000 else slices, ["key", "slice"])
    inside = inside.groupBy("key", "h").agg(F.sum("size").alias("z"), F.count("*").alias("k"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = inside.withColumn("from", F.col("before") + F.sum("z").over(Window.partitionBy("key").orderBy("h")) - F.col("z"))
    edge = inside.where("from <= rest and rest < from + z").select("key", F.col("h").alias("edge"), F.floor((F.col("rest") - F.col("from")) / F.col("k")).alias("edge_take"))
    plan = plan.join(edge, "key", "left").drop("key")
    # no edge: the partial pass takes nothing, or all
    return written(plan.withColumn("edge", F.coalesce("edge", F.when(F.col("rest") > 0, F.lit((1 << 63) - 1)).otherwise(-1))).withColumn("edge_take", F.coalesce("edge_take", F.lit(0).cast("long"))))


def _place(key: str, text: str, seed: int):
    """A row's place in the seeded order: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")), 2)


def _parts(rules: MixRules) -> Column:
    """For a row at words offset to offset + size of its source's run: (block, copy, shard, words) of all that is taken of it."""
    size, block = F.col("size"), F.lit(rules.block)
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes"), F.lit(0))), lambda c: c)  # copy c takes the run, the last its first extra blocks
    words = lambda b: F.least(F.col("offset") + size, (b + 1) * block) - F.greatest(F.col("offset"), b * block)
    place = lambda b, c: F.when(c < F.col("passes"), F.col("extra") + c * F.col("run") + b).otherwise(b)
    part = lambda b, c: F.struct(b.alias("block"), c.cast("int").alias("copy"), F.pmod(F.col("first") + place(b, c), F.lit(rules.shards)).cast("int").alias("shard"), words(b).alias("words"))
    span = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + size - 1) / block))
    every = F.flatten(F.transform(whole, lambda c: F.transform(F.filter(span, lambda b: (c < F.col("passes")) | (b < F.col("extra"))), lambda b: part(b, c))))
    return F.when(size > 0, every).otherwise(F.array().cast("array<struct<block:bigint,copy:int,shard:int,words:bigint>>"))


def mixed(docs: DataFrame, rules: MixRules = MixRules(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, quota, parts) of each row of docs; parts: (block, copy, shard, words) of what is taken of it."""
    sized = written(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), _place(key, text, rules.seed).alias("h")))
    plan = mix_plan(sized, rules).withColumn("key", _key())
    s = plan.agg(F.max("n").alias("n"), F.count("*").alias("s")).first()
    rows, slices = _slices(sized, s["n"] or 0)
    inside = F.sum("size").over(Window.partitionBy("key", "slice").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(slices, ["key", "slice"]).withColumn("offset", F.col("before") + F.col("inside"))
    plan = plan.select("key", "source_size", "target", "quota", "run", "passes", "extra", F.pmod(F.xxhash64(F.lit(rules.seed), "key"), F.lit(rules.shards)).alias("first"))
    out = rows.join(F.broadcast(plan) if s["s"] <= 100_000 else plan, "key")
    last = F.greatest(F.least(F.col("offset") + F.col("size"), F.col("extra") * rules.block) - F.col("offset"), F.lit(0))
    return out.select("id", "size", "source_size", "target", (F.col("passes") * F.col("size") + last).alias("taken"), "quota", _parts(rules).alias("parts"))


def take_mix(docs: DataFrame, rules: MixRules = MixRules(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes its words, rounded: not at all, once or twice. Texts are not shuffled."""
    of, size, h, times = fresh(docs, "of", "size", "h", "times")
    sized = docs.select(F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), _place(key, text, rules.seed).alias("h"))
    sized = written(sized)
    plan = _edges(sized, mix_plan(sized, rules), rules)
    small = plan.limit(100_001).count() <= 100_000
    plan = plan.select(F.col("source").alias(of), F.struct("passes", "edge", "edge_take").alias(times))
    if small:
        plan = F.broadcast(plan)
    rows = docs.withColumn(size, F.size(words(F.col(f"`{text}`")))).withColumn(h, _place(key, text, rules.seed))
    rows = rows.join(plan, F.col(f"`{source}`").eqNullSafe(F.col(of)))
    s, p = F.col(size), F.col(times)
    taken = p["passes"] * s + F.when(F.col(h) < p["edge"], s).when(F.col(h) == p["edge"], F.least(s, p["edge_take"])).otherwise(0)
    copies = F.when(s > 0, F.floor(taken / s + 0.5)).otherwise(0).cast("int")
    rows = rows.withColumn(times, copies).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
