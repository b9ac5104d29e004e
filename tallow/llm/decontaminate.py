"""Benchmark decontamination by spaced-seed hashing (native DataFrame functions only).

A seed is a mask over consecutive tokens: hashed at its care positions, blind
at the others. Every mask is hashed at every position of the test items and of
the documents where it fits; equal hashes are hits. Around each hit the document
and the item are laid side by side, and the overlap counts if a window of
min_tokens (or the whole item, if shorter) that holds the hit agrees in
min_percent of its tokens.

Items shorter than min_tokens have masks of their own, for each length: the item
is cut into five parts, and where e substitutions are allowed a mask is any
five less e of them, so every allowed pattern leaves one mask whole.

Tokens are runs of letters and digits of the lower-cased text. Defined results:
texts without tokens match nothing; items of one to four tokens must occur as
they are; repeated items or documents are found each; documents without an id
are found too and carry a null id; items without an id are not looked for; empty
tables give no rows; other columns play no part and may have any name. A text's
tokens are held in one array.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written


@dataclass(frozen=True)
class SeedRules:
    #: Care positions of each mask; substitutions at the other places do no harm.
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 4), (0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 1, 4, 5, 9))
    min_tokens: int = 13
    min_percent: int = 80
    #: Items of fewer tokens are not looked for.
    shortest: int = 1
    #: Up to so many seeds of the test set are broadcast with their items; beyond, hashes are joined by a shuffle.
    broadcast_seeds: int = 500_000
    #: Keys that a seed has in that shuffle, so that a frequent seed is not one task's work.
    salts: int = 8


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def short_masks(length: int, percent: int) -> list[tuple[int, ...]]:
    """Masks of an item of that many tokens that hit every placing of which percent agree."""
    allowed = length - -(-percent * length // 100)
    parts = min(5, length)
    cuts = [length * k // parts for k in range(parts + 1)]
    return [tuple(x for p in some for x in range(cuts[p], cuts[p + 1])) for some in combinations(range(parts), max(parts - allowed, 1))]


def _seeds(df: DataFrame, w: str, masks: list[tuple[int, tuple[int, ...]]], keep: list[str], fit: bool = False) -> DataFrame:
    """A row (keep..., at, seed) for every mask (its number, its care positions) and every position; with fit, only where the mask fits.

    A mask that sticks out of a text has a hash of fewer tokens there, which no
    fitting mask's hash equals: it is enough that one side of a join fits.
    """
    size = F.size(w)
    hashed = lambda i, n, m: F.xxhash64(F.lit(n), *[F.get(F.col(w), i + k) for k in m])
    place = (lambda i, n, m: F.when(i + m[-1] < size, hashed(i, n, m))) if fit else hashed
    df = df.where(size > 0).select(*dict.fromkeys([*keep, w]), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    df = df.select(*keep, "at", F.explode(F.array(*[place(F.col("at"), n, m) for n, m in masks])).alias("seed"))
    return df.where("seed is not null") if fit else df


def _placed(df: DataFrame) -> DataFrame:
    """Adds the tokens of d that lie beside the item: from place shift on, as many as the item has."""
    begin = F.greatest(F.col("shift"), F.lit(0))
    return df.withColumn("beside", F.slice("d", begin + 1, F.greatest(F.col("len") + F.col("shift") - begin, F.lit(0)))).drop("d")


def overlaps(docs: DataFrame, items: DataFrame, rules: SeedRules = SeedRules(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, hits, matched, item_tokens) of each document and each item that overlaps it."""
    column = lambda c: F.col(f"`{c}`")
    bench = written(items.select(column(item_key).alias("item"), tokens(column(item_text)).alias("t")).where(F.col("item").isNotNull() & (F.size("t") >= max(rules.shortest, 1))))
    lengths = sorted(r["k"] for r in bench.where(F.size("t") < rules.min_tokens).select(F.size("t").alias("k")).distinct().collect())  # fewer than min_tokens values
    by_length = {k: [(1000 * k + n, m) for n, m in enumerate(short_masks(k, rules.min_percent))] for k in lengths}
    whole = bench.where(F.size("t") >= rules.min_tokens)
    masks = [] if whole.isEmpty() else list(enumerate(rules.masks))
    seeds = None
    for part, own in [(whole, masks), *((bench.where(F.size("t") == k), by_length[k]) for k in lengths)]:
        if own:
            part = _seeds(part.withColumn("len", F.size("t")), "t", own, ["item", "len"], fit=True).select("item", "len", F.col("at").alias("j"), "seed")
            seeds = part if seeds is None else seeds.union(part)
    d = docs.select(column(key).alias("id"), tokens(column(text)).alias("d"))
    if seeds is None:
        return d.select("id", F.lit(None).cast(bench.schema["item"].dataType).alias("item"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("matched"), F.lit(0).alias("item_tokens")).where("false")
    every = masks + [m for k in lengths for m in by_length[k]]
    small = seeds.count() <= rules.broadcast_seeds
    at = [F.col("item"), (F.col("at") - F.col("j")).alias("shift"), F.col("j"), F.col("len")]
    found = [F.count("*").alias("hits"), F.min("j").alias("lo"), F.max("j").alias("hi")]  # a hit for each mask and position
    if small:  # texts stay where they are; only what lies beside an item goes on
        met = _placed(_seeds(d, "d", every, ["id", "d"]).join(F.broadcast(seeds), "seed").select("id", *at, "d"))
        met = met.groupBy("id", "item", "shift", "beside").agg(*found)
    else:  # rows have keys of their own: ids may be null or repeated
        d = written(d.withColumn("row", F.monotonically_increasing_id()))
        seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rules.salts - 1).cast("long"))))
        met = _seeds(d, "d", every, ["row"]).select("row", "at", "seed", F.pmod("row", F.lit(rules.salts)).alias("salt")).join(seeds, ["seed", "salt"])
        met = met.select("row", *at).groupBy("row", "item", "shift", "len").agg(*found)
        met = _placed(met.join(d, "row")).select("id", "item", "shift", "beside", "hits", "lo", "hi")
    met = met.join(F.broadcast(bench) if small else bench, "item").withColumn("n", F.least(F.lit(rules.min_tokens), F.size("t")))
    same = F.transform("t", lambda x, k: F.when(F.get(F.col("beside"), k + F.least(F.col("shift"), F.lit(0))) == x, 1).otherwise(0))
    met = met.withColumn("same", same).withColumn("m", F.aggregate("same", F.lit(0), lambda x, y: x + y))
    starts = F.sequence(F.greatest(F.lit(0), F.col("lo") - F.col("n") + 1), F.least(F.col("hi"), F.size("t") - F.col("n")))
    window = lambda s: F.aggregate(F.slice(F.col("same"), s + 1, F.col("n")), F.lit(0), lambda x, y: x + y)
    met = met.where(F.exists(starts, lambda s: window(s) * 100 >= rules.min_percent * F.col("n")))
    return met.groupBy("id", "item").agg(F.sum("hits").alias("hits"), F.max("m").alias("matched"), F.max(F.size("t")).alias("item_tokens"))


def drop_contaminated(docs: DataFrame, items: DataFrame, rules: SeedRules = SeedRules(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that overlap no item, with docs' columns. A row is judged by its id and a hash of its text, so rows may share an id or have none."""
    (k,) = fresh(docs, "hit")
    own = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text"))
    named = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"))
    found = written(overlaps(named, items, rules, "own", "text", item_key, item_text).select(F.col("id").alias(k)).distinct())
    return docs.join(found, own.eqNullSafe(F.col(k)), "left_anti")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


