"""Near-duplicate groups by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of
the permuted shingle hashes, so a signature costs half the hash evaluations of
plain minwise hashing. Signatures are banded; documents that share a band are
candidates, and links are confirmed on the full shingle sets.

Documents with equal sets form one class and only its smallest id is compared.
In a bucket every document is first compared with a pivot; only documents of
buckets that still hold several components are compared further, and never two
of one component, so large groups of copies cost a star and not all pairs. Of
those that are left, only pairs whose parity sketches allow the similarity are
met: bins that hold an odd number of one set's shingles and an even number of
the other's are never more than the shingles in which the sets differ.

Defined results: a null or empty text has no shingles and is linked with
nothing; a text of fewer words than the shingle length has its whole sequence
as one shingle; every row is a document of its own, with or without an id, and
rows that repeat an id are linked by their texts alone; a group without an id
has a null one. Ids may be of any type that has an order. Empty tables give no
rows; other columns may have any name. A text is held whole in one task, with the
hashes of its shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, table, written


@dataclass(frozen=True)
class NearRules:
    shingle: int = 2
    percent: int = 80
    #: 32 bands of 5 values: a pair at a similarity of 0.8 shares no band with a chance of 3e-6.
    bands: int = 32
    rows: int = 5
    seed: int = 7
    #: Rounds in which a bucket's documents are compared with a pivot before what is left is compared pair by pair.
    pivots: int = 3
    #: Bins of the parity sketch, in words of 64.
    sketch: int = 8
    #: Rows of a block, of those that pivots leave over in a bucket.
    block: int = 8192
    #: Up to so many rows' numbers are broadcast to find their texts; more are joined by a shuffle.
    broadcast_rows: int = 1_000_000


_CHUNK = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(texts: list, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingle hashes of consecutive texts, their ends), about _CHUNK words at a time."""
    first, lists, held = 0, [], 0
    for k, text in enumerate([*texts, None]):
        last = k == len(texts)
        if not last:
            lists.append(ws := (text or b"").lower().split())
            held += len(ws)
        if lists and (last or held >= _CHUNK):
            sizes = np.array([len(x) for x in lists])
            flat = np.array([w for x in lists for w in x], dtype=object)
            h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
            counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
            ends = np.cumsum(counts)
            starts = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(ends[-1]) - np.repeat(ends - counts, counts)
            width = np.repeat(np.minimum(sizes, n), counts)
            out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
            for j in range(n):
                use = width > j
                out[use] = _mix(out[use] * np.uint64(0xD1342543DE82EF95) + h[starts[use] + j])
            yield first, out, ends
            first, lists, held = k + 1, [], 0


def _signer(rules: NearRules):
    half = (rules.bands * rules.rows + 1) // 2
    draws = np.random.default_rng(rules.seed).integers(0, 2**63, (2, half), dtype=np.uint64)
    mul, plus = draws[0] * np.uint64(2) + np.uint64(1), draws[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _mix(np.arange(1, rules.rows + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for first, h, ends in _shingles(texts, rules.shingle):
                begins = np.concatenate(([0], ends[:-1]))
                some = np.flatnonzero(ends > begins)
                sizes, keys = np.zeros(len(ends), np.int64), np.zeros((len(ends), 2), np.uint64)
                odd = np.zeros((len(ends), rules.sketch), np.int64)
                bands = np.zeros((len(some), rules.bands), np.uint64)
                for d in some:
                    s = np.unique(h[begins[d] : ends[d]])
                    sizes[d], keys[d] = len(s), (s.sum(dtype=np.uint64), _mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    bins = (_mix(s + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * rules.sketch)).astype(np.int64)
                    odd[d] = np.packbits(np.bincount(bins, minlength=64 * rules.sketch) & 1).view(np.int64)
                if len(some):
                    sig = np.empty((len(some), 2 * half), np.uint64)
                    for p in range(half):
                        v = h * mul[p] + plus[p]
                        sig[:, 2 * p], sig[:, 2 * p + 1] = np.minimum.reduceat(v, begins[some]), np.maximum.reduceat(v, begins[some])
                    parts = sig[:, : rules.bands * rules.rows].reshape(len(some), rules.bands, rules.rows)
                    bands = _mix((_mix(parts) * weights).sum(axis=2, dtype=np.uint64) + np.arange(rules.bands, dtype=np.uint64))
                offsets = np.zeros(len(ends) + 1, np.int32)
                offsets[1:][some] = rules.bands
                yield pa.record_batch(
                    [
                        pa.array(ids[first : first + len(ends)], pa.int64()),
                        pa.array(sizes),
                        pa.array(keys[:, 0].view(np.int64)),
                        pa.array(keys[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * rules.sketch), pa.array(odd.reshape(-1))),
                    ],
                    names=["row", "n", "k1", "k2", "bands", "sketch"],
                )

    return run


def _sets(rules: NearRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, h, ends in _shingles(batch.column(1).to_pylist(), rules.shingle):
                begins = np.concatenate(([0], ends[:-1]))
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(begins, ends, strict=True)]
                yield pa.record_batch([pa.array(ids[first : first + len(ends)], pa.int64()), pa.array(sets, pa.binary())], names=["row", "set"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) of rows whose full sets reach the threshold. texts: (row, text)."""
    wanted = broadcast_if_small(written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()), rules.broadcast_rows)
    sets = written(texts.join(wanted, "row", "left_semi").mapInArrow(_sets(rules), "row long, set binary"))
    near = pairs.join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    near = near.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a")
    return near.select("a", "b", "x", "y").mapInArrow(_confirmer(rules.percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (a, b): the smallest id that it reaches.

    Each round takes the smallest component among a node's neighbours and then
    that component's own component, so paths halve and stars end in two rounds.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    comp = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")))
    while True:
        seen = both.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = comp.join(seen, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = comp.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        new = written(step.join(jump, "mid", "left").select("id", "old", F.least("mid", "far").alias("comp")))
        comp = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return comp


def _left_over(at: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b, n, pn) of one bucket and two components that sizes and parity sketches allow.

    at: (id, n, band, h, comp, sketch). A bucket is parted by size, each size
    meeting itself and the next smaller one, and into blocks of about
    rules.block rows; every pair of blocks is a join key of its own, so no
    bucket is one task's work, however large.
    """
    size = F.floor(F.ln(F.col("n").cast("double")) / math.log(100 / rules.percent) + 1e-9)  # sizes in the ratio differ by 1 at most
    at = at.withColumn("size", size).withColumn("with", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    parts = at.groupBy("band", "h", "with").agg(F.count("*").alias("m")).where("m > 1").select("band", "h", "with", F.ceil(F.col("m") / rules.block).alias("g"))
    at = at.join(parts, ["band", "h", "with"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")))
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).withColumns({"p": F.least("block", "j"), "q": F.greatest("block", "j")}).drop("j", "g")
    keys = ["band", "h", "with", "p", "q"]
    other = at.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "comp", "sketch", "size", "block")])
    apart = reduce(add, [F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("o_sketch")[k])) for k in range(rules.sketch)])
    fits = (100 + rules.percent) * apart <= (100 - rules.percent) * (F.col("n") + F.col("o_n"))
    here = F.expr("id < o_id and comp <> o_comp and `with` = greatest(size, o_size) and p = least(block, o_block) and q = greatest(block, o_block)")
    return at.join(other, keys).where(here & fits).select(F.col("id").alias("a"), F.col("o_id").alias("b"), "n", F.col("o_n").alias("pn"))


def _grouped(texts: DataFrame, rules: NearRules) -> DataFrame:
    """(row, id, n, comp, lead) of each row of texts (row, id, text; a written table): set size, smallest id of its group, the row that stands for the group."""
    signed = written(texts.select("row", "text").mapInArrow(_signer(rules), "row long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"))
    sized = signed.select("row", "n", "k1", "k2").join(texts.select("row", "id"), "row")
    lead = lambda row, low: F.min_by(row, F.struct(F.col(low).isNull(), F.col(low), F.col(row)))
    several = sized.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("rep"), F.min("id").alias("low"), lead("row", "id").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m")
    member = sized.join(written(several), ["k1", "k2", "n"], "left")
    member = written(member.select("row", "id", "n", F.coalesce("rep", "row").alias("rep"), F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("low")).alias("low"), F.coalesce("lead", "row").alias("lead")))
    classes = member.where("n > 0 and row = rep").select("row", "low", "lead")
    copies = broadcast_if_small(member.where("row <> rep").select("row"), rules.broadcast_rows)
    signed = signed.join(copies, "row", "left_anti").where("n > 0").select(F.col("row").alias("id"), "n", "bands", "sketch")

    buckets = signed.select("id", "n", F.posexplode("bands").alias("band", "h"))
    crowded = buckets.groupBy("band", "h").count().where("count > 1").select("band", "h")
    buckets = written(buckets.join(crowded, ["band", "h"]))
    nodes = buckets.select("id").distinct().select("id", F.col("id").alias("comp"))
    comps = links = tried = None
    for turn in range(rules.pivots + 1):
        at = buckets.join(written(nodes), "id") if turn else buckets.withColumn("comp", F.col("id"))
        if turn:
            mixed = at.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "h")
            at = written(at.join(mixed, ["band", "h"]))
            if at.isEmpty():
                break
        if turn < rules.pivots:
            order = F.struct(F.xxhash64(F.lit(turn), "id") if turn else F.col("id"), "id")
            pivot = at.groupBy("band", "h").agg(F.min_by(F.struct(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc")), order).alias("x")).select("band", "h", "x.*")
            met = at.join(pivot, ["band", "h"]).where("comp <> pc").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"), "n", F.col("pn"))
        else:
            met = _left_over(at.join(signed.select("id", "sketch"), "id"), rules)
        met = met.where(100 * F.least("n", "pn") >= rules.percent * F.greatest("n", "pn")).select("a", "b").distinct()
        met = written(met if tried is None else met.join(tried, ["a", "b"], "left_anti"))
        if met.isEmpty():
            continue
        tried = met if tried is None else tried.union(met)
        found = written(_confirmed(met, texts.select("row", "text"), rules))
        links = found if links is None else links.union(found)
        if not links.isEmpty():
            comps = components(links)
            nodes = buckets.select("id").distinct().join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    if comps is None:
        return member.select("row", "id", "n", F.col("low").alias("comp"), "lead")
    own = comps.withColumnRenamed("id", "row").join(classes, "row")
    groups = own.groupBy("comp").agg(F.min("low").alias("least"), lead("lead", "low").alias("first"))
    own = written(own.select(F.col("row").alias("rep"), "comp").join(groups, "comp").select("rep", "least", "first"))
    linked = F.col("first").isNotNull()
    return member.join(own, "rep", "left").select("row", "id", "n", F.when(linked, F.col("least")).otherwise(F.col("low")).alias("comp"), F.coalesce("first", "lead").alias("lead"))


def near_groups(docs: DataFrame, rules: NearRules = NearRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, comp) of every row of docs: set size, smallest id of its group."""
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")))
    return _grouped(texts, rules).select("id", "n", "comp")


def drop_near(docs: DataFrame, rules: NearRules = NearRules(shingle=5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' columns of one row of each group: that of the smallest id, or any of it if the id repeats."""
    (row,) = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = _grouped(rows.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")), rules)
    gone = written(groups.where("row <> lead").select(F.col("row").alias(row)))
    return rows.join(broadcast_if_small(gone, rules.broadcast_rows), row, "left_anti").drop(row)


def op10_minmax_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))
