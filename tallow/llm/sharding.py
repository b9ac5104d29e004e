"""Sharding by k-d tree partitioning (native DataFrame functions only).

All rows start in one node that stands for all shards. A node of k shards is
cut along its widest metadata dimension into nodes of k/2 shards each (rounded
down and up) so that their bytes are in that proportion; the cut is a
distributed weighted quantile, found by histograms of ever finer key ranges.
Rows that tie on the dimension lie in the order of their text's checksum and
then of their id, and equal texts share their coordinates, so they stay together
unless a cut within its slack needs them apart.

Defined results: a null text has 0 bytes, a null source, language or id counts
as an empty string; repeated rows lie side by side and have slots of their own;
rows alike in id and text cannot be parted; an empty table has no rows; extra
columns play no part. Texts are only hashed and measured, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, let, table, written


@dataclass(frozen=True)
class TreeRules:
    shards: int = 24
    #: Bytes of a shard, at most but for ties: if set, it decides how many shards there are.
    target_bytes: int | None = None
    #: A cut may be off by so much of a shard's bytes.
    slack: float = 0.002
    #: The same for a cut between two texts that leaves equal texts together.
    whole: float = 0.02
    #: Histogram bins are 2**bits of a node's remaining key range.
    bits: int = 10


#: Key bits: dimension, text checksum, id; 62 in all.
_DIM, _TEXT, _ID = 20, 24, 18


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _unit(name: str) -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) / float(2**32)


def points(docs: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang"), keep: bool = False) -> DataFrame:
    """(id, size, crc, tie, m), and doc, a struct of docs' columns, if keep. m holds the named columns' values, for equal texts those that come first among them.

    Only texts whose rows differ in metadata are joined: broadcast up to 100,000
    of them; beyond that those with many rows are broadcast, the others shuffled.
    """
    known = F.col(f"`{text}`")
    twin = F.struct(text_crc(known).alias("crc"), F.xxhash64(F.coalesce(known, F.lit(""))).alias("hash"))
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in metadata]
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 64 - _ID)
    doc = ["doc"] if keep else []
    rows = docs.select(*[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(d) for d in doc], F.col(f"`{key}`").alias("id"), text_bytes(known).alias("size"), twin.alias("twin"), tie.alias("tie"), F.array(*values).alias("m"))
    mixed = rows.groupBy("twin").agg(F.min("m").alias("least"), F.max("m").alias("most"), F.count("*").alias("k")).where("least <> most").select("twin", "least", "k")
    mixed = written(mixed)
    if mixed.count() <= 100_000:
        rows = rows.join(F.broadcast(mixed.drop("k")), "twin", "left")
    else:
        hot = F.col("k") * 1000 > mixed.agg(F.sum("k")).first()[0]  # under 1000 texts
        rows = rows.join(F.broadcast(mixed.where(hot).select("twin", F.col("least").alias("hot"))), "twin", "left").join(mixed.where(~hot).drop("k"), "twin", "left").withColumn("least", F.coalesce("hot", "least"))
    return rows.select(*doc, "id", "size", F.col("twin.crc").alias("crc"), "tie", F.coalesce("least", "m").alias("m"))


def _dims(n: int) -> list[Column]:
    """The dimensions of points, each from 0 to 1: the logarithm of the size, and n metadata columns."""
    return [F.least(F.greatest(F.log2("size") / 40, F.lit(0.0)), F.lit(1.0)), *[F.crc32(F.get("m", F.lit(d)).cast("binary")) / float(2**32) for d in range(n)]]


def _keys(n: int) -> list[Column]:
    """A point's places along its dimensions; equal texts lie together, and their rows in the order of their ids' hashes."""
    return [_key(d) for d in _dims(n)]


def keyed(pts: DataFrame, n: int) -> DataFrame:
    """pts with dims and keys, arrays of what the dimensions give: written, they keep the tree's many plans small."""
    return pts.withColumn("dims", F.array(*_dims(n))).withColumn("keys", F.array(*_keys(n))).drop("m")


def _key(dim: Column) -> Column:
    return F.shiftleft((dim * ((1 << _DIM) - 1)).cast("long"), _TEXT + _ID) + F.shiftleft(F.shiftright("crc", 32 - _TEXT), _ID) + F.col("tie")


@dataclass(frozen=True)
class Node:
    """A leaf, or a cut of a dimension at a key: points below it go low, the others high. A node is named by its first shard."""

    shard: int
    shards: int
    dim: int | None = None
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.dim is None else self.low.leaves() + self.high.leaves()

    def grown(self, cuts: dict[int, tuple[int, int]]) -> Node:
        """The tree with the leaves of cuts {shard: (dim, key)} cut in two halves of their shards."""
        if self.dim is not None:
            return replace(self, low=self.low.grown(cuts), high=self.high.grown(cuts))
        if self.shard not in cuts:
            return self
        half = self.shards // 2
        return Node(self.shard, self.shards, *cuts[self.shard], Node(self.shard, half), Node(self.shard + half, self.shards - half))

    def nodes(self) -> list[tuple[Node, int]]:
        """All nodes, level by level, with the place of the lower child; the higher one follows it, and a leaf has -1."""
        out, at = [self], 0
        low = []
        while at < len(out):
            node = out[at]
            low.append(len(out) if node.dim is not None else -1)
            out += [node.low, node.high] if node.dim is not None else []
            at += 1
        return list(zip(out, low, strict=True))

    def depth(self) -> int:
        return 0 if self.dim is None else 1 + max(self.low.depth(), self.high.depth())

    def of(self, keys: Column) -> Column:
        """The shard of a point with these keys, an array: steps down the tree, whose cuts are looked up, so that the expression does not grow with the tree."""
        if self.dim is None:
            return F.lit(self.shard)
        nodes = self.nodes()
        low, shard = _values([x for _, x in nodes]), _values([n.shard for n, _ in nodes])
        dim, cut = _values([n.dim or 0 for n, _ in nodes]), _values([n.cut for n, _ in nodes])

        def step(at: Column, _: Column) -> Column:
            high = (F.get(keys, F.get(dim, at).cast("int")) >= F.get(cut, at)).cast("int")
            return F.when(F.get(low, at) < 0, at).otherwise((F.get(low, at) + high).cast("int"))

        steps = F.sequence(F.lit(1), F.lit(self.depth()))
        return F.get(shard, F.aggregate(steps, F.lit(0), step)).cast("int")


def _values(numbers: list[int]) -> Column:
    """The numbers as one literal array."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _chosen(by_node: dict[int, int], default: int) -> Column:
    """The value of each node, of at most as many nodes as shards."""
    values = [by_node.get(k, default) for k in range(max(by_node, default=0) + 1)]
    return F.coalesce(F.get(_values(values), F.col("node")), F.lit(default).cast("bigint"))


def _cuts(rows: DataFrame, aims: dict[int, float], slack: float, whole: float, bits: int) -> dict[int, int]:
    """For each node of rows (node, key, size) the key below which as near as may be aims[node] bytes lie, within slack, or within whole between two texts."""
    low, width = dict.fromkeys(aims, 0), _DIM + _TEXT + _ID
    left, cuts = dict(aims), {}
    while aims.keys() - cuts.keys():
        width = max(width - bits, _ID if width > _ID else 0)
        slack = whole if width == _ID else slack
        todo = [n for n in aims if n not in cuts]
        bins = rows.where(_chosen(dict.fromkeys(todo, 1), 0) == 1).withColumn("bin", F.shiftright(F.col("key"), width) - _chosen({n: low[n] >> width for n in todo}, 0))
        bins = bins.where(f"bin >= 0 and bin < {1 << bits}").groupBy("node", "bin").agg(F.sum("size").alias("z")).orderBy("node", "bin").collect()  # shards x bins at most
        for n in todo:
            own, upto = [r for r in bins if r["node"] == n], 0
            for r in own:
                if upto + r["z"] > left[n] or r is own[-1]:
                    over, under = upto + r["z"] - left[n], left[n] - upto
                    start = low[n] + (r["bin"] << width)
                    if over <= slack and over <= under or width == 0 and over <= under:
                        cuts[n] = start + (1 << width)
                    elif under <= slack or width == 0:
                        cuts[n] = start
                    elif over <= slack:
                        cuts[n] = start + (1 << width)
                    else:
                        low[n], left[n] = start, under
                    break
                upto += r["z"]
            else:
                cuts[n] = 0
    return cuts


def tree(pts: DataFrame, rules: TreeRules = TreeRules()) -> Node:
    """The k-d tree of pts (a written table: size, dims, keys). Points stay where they are: a level is a few histograms over them."""
    total = pts.agg(F.sum("size")).first()[0] or 0
    root = Node(0, rules.shards if rules.target_bytes is None else max(1, -(-total // rules.target_bytes)))
    if not total:
        return root
    dims = [F.get("dims", F.lit(d)) for d in range(len(pts.select("dims").head()["dims"]))]
    slack, whole = rules.slack * total / root.shards, rules.whole * total / root.shards
    while todo := {leaf.shard: leaf.shards for leaf in root.leaves() if leaf.shards > 1}:
        at = pts.withColumn("node", root.of(F.col("keys"))).where(_chosen(dict.fromkeys(todo, 1), 0) == 1)
        wide = at.groupBy("node").agg(F.sum("size").alias("z"), *[f(x).alias(f"{f.__name__}{d}") for d, x in enumerate(dims) for f in (F.min, F.max)]).collect()
        widest = {r["node"]: max(range(len(dims)), key=lambda d: (r[f"max{d}"] - r[f"min{d}"], -d)) for r in wide}
        key = F.get("keys", _chosen(widest, 0).cast("int"))
        cuts = _cuts(at.select("node", key.alias("key"), "size"), {r["node"]: r["z"] * (todo[r["node"]] // 2) / todo[r["node"]] for r in wide}, slack, whole, rules.bits)
        root = root.grown({n: (widest.get(n, 0), cuts.get(n, 0)) for n in todo})
    return root


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (id, crc, tie, shard) with slot, gapless in each shard: slices are numbered, then the rows of each slice."""
    n = rows.count()
    slices = max(16, min(n // 2000, 1 << 16))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "crc"), F.lit(slices)))
    sums = rows.groupBy("shard", "slice").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")
    sums = sums.select("shard", "slice", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "crc")) - 1
    return rows.withColumn("place", place).join(sums, ["shard", "slice"]).withColumn("slot", F.col("before") + F.col("place")).drop("slice", "place", "before")


def sharded(docs: DataFrame, rules: TreeRules = TreeRules(), key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs."""
    pts = written(keyed(points(docs, key, text, metadata), len(metadata)))
    out = with_slots(pts.withColumn("shard", tree(pts, rules).of(F.col("keys"))))
    return out.select("id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, rules: TreeRules = TreeRules(), key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """docs' columns and shard (under another name if docs has one). The tree is applied row by row; texts are not shuffled."""
    root = tree(written(keyed(points(docs, key, text, metadata), len(metadata))), rules)
    name = "shard" if "shard" not in map(str.lower, docs.columns) else fresh(docs, "shard")[0]
    rows = points(docs, key, text, metadata, keep=True)
    return rows.select("doc", let(F.array(*_keys(len(metadata))), root.of).alias("node")).select("doc.*", F.col("node").alias(name))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
