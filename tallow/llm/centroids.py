"""Centroid clustering in whole numbers with block-norm screening.

Components are scaled and floored, so that distances and means are exact. A
vector is compressed once to the norms of its segments. In a round the reverse
triangle inequality (Cauchy-Schwarz on each segment) gives, from these norms and
the centroids', a lower bound of every distance; the centroid of the least bound
is measured exactly, and of the others only those whose bound is not above that
distance. Sums are made where vectors are read, so a round moves a row for each
task, cluster and component; only the centroids are on the driver.

Defined results: vectors that are null, of another length, or hold a null or a
component that is not finite are left out, as are those with a scaled component
beyond 2**27 in size, whose distances a long might not hold. Repeated rows are
vectors of their own; where ids tie, start centroids are taken in the order of
their components; a null id counts as an empty text. Fewer vectors than clusters
give a centroid each. Of equally near centroids the smaller number wins. An
empty table gives no rows; other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


@dataclass(frozen=True)
class ClusterRules:
    clusters: int = 8
    rounds: int = 10
    size: int = 64
    #: Components are multiplied by this and floored.
    scale: int = 1024
    #: The start centroids are those of the least hashes of '{seed}:{id}'.
    seed: int = 3
    #: Components of a segment whose norm stands for it.
    segment: int = 8


_LARGEST = 1 << 27
#: Bounds are lowered by this share of what they were taken from: far more than their rounding errors.
_DOUBT = 1e-9


def whole_vectors(df: DataFrame, rules: ClusterRules = ClusterRules(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, q array<int>, norms array<double>) of the usable rows: scaled components, and the norms of their segments."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    usable = (F.size(x) == rules.size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < _LARGEST / rules.scale), F.lit(False)))
    q = F.transform(x, lambda v: F.floor(v * rules.scale).cast("int"))
    rows = df.where(F.col(f"`{vector}`").isNotNull()).where(usable).select(F.col(f"`{key}`").alias("id"), q.alias("q"))
    starts = range(0, rules.size, rules.segment)
    norm = lambda a: F.sqrt(F.aggregate(F.slice("q", a + 1, rules.segment), F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long")).cast("double"))
    return rows.withColumn("norms", F.array(*[norm(a) for a in starts]))


def segment_norms(q: np.ndarray, segment: int) -> np.ndarray:
    return np.sqrt(np.add.reduceat(q.astype(np.int64) ** 2, np.arange(0, q.shape[1], segment), axis=1).astype(np.float64))


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of q (whole numbers, with its segments' norms) the nearest centroid and the squared distance; and how many distances were taken."""
    c_norms = segment_norms(centroids, segment)
    own, theirs = (norms**2).sum(axis=1), (c_norms**2).sum(axis=1)
    low = own[:, None] + theirs - 2 * norms @ c_norms.T - _DOUBT * (own[:, None] + theirs) - 1  # of the squared distance
    every = np.arange(len(q))
    best = low.argmin(axis=1)
    dist = ((q - centroids[best]) ** 2).sum(axis=1)
    left = low <= dist[:, None]
    left[every, best] = False
    rows, cols = np.nonzero(left)
    if len(rows):
        more = ((q[rows] - centroids[cols]) ** 2).sum(axis=1)
        full = np.full(left.shape, np.iinfo(np.int64).max)
        full[rows, cols] = more
        full[every, best] = dist
        best = full.argmin(axis=1)  # the smaller number, if distances tie
        dist = full[every, best]
    return best, dist, len(q) + len(rows)


def _read(batch: pa.RecordBatch, at: int, size: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], rules: ClusterRules, centroids: np.ndarray):
    """(batch, its rows' clusters, distances, vectors), some thousand rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            q = _read(part, 1, rules.size).astype(np.int64)
            near, dist, _ = nearest(q, _read(part, 2, -(-rules.size // rules.segment)), centroids, rules.segment)
            yield part, near, dist, q


def _summed(rules: ClusterRules, centroids: np.ndarray):
    """(cluster, at, total): a task's sums of each cluster's components; at -1 the number of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), rules.size + 1), np.int64)
        for _, near, _, q in _blocks(batches, rules, centroids):
            sums[:, 0] += np.bincount(near, minlength=len(centroids))
            for k in np.unique(near):
                sums[k, 1:] += q[near == k].sum(axis=0)
        cluster, at = np.nonzero(np.broadcast_to(sums[:, :1] > 0, sums.shape))
        yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(sums[cluster, at])], names=["cluster", "at", "total"])

    return run


def _assigned(rules: ClusterRules, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, near, dist, _ in _blocks(batches, rules, centroids):
            yield pa.record_batch([part.column(0), pa.array(near.astype(np.int32)), pa.array(dist)], names=["id", "cluster", "distance"])

    return run


def start_centroids(vectors: DataFrame, rules: ClusterRules = ClusterRules()) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(order.alias("h"), "q").orderBy("h", "q").limit(rules.clusters).collect()
    return np.array([r["q"] for r in first], np.int64).reshape(-1, rules.size)


def moved(vectors: DataFrame, centroids: np.ndarray, rules: ClusterRules = ClusterRules()) -> np.ndarray:
    """The centroids after a round: each the floored mean of its vectors; one without vectors stays."""
    parts = vectors.mapInArrow(_summed(rules, centroids), "cluster int, at int, total long")
    got = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x components
    total = {(r["cluster"], r["at"]): int(r["total"]) for r in got}
    out = centroids.copy()
    for k in range(len(centroids)):
        if n := total.get((k, -1)):
            out[k] = [total[k, j] // n for j in range(rules.size)]
    return out


def clustered(df: DataFrame, rules: ClusterRules = ClusterRules(), key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each usable row as a written table, and the final centroids."""
    vectors = written(whole_vectors(df, rules, key, vector))
    centroids = start_centroids(vectors, rules)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rules.rounds):
        centroids = moved(vectors, centroids, rules)
    return written(vectors.mapInArrow(_assigned(rules, centroids), f"id {kind}, cluster int, distance long")), centroids


def op11_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = clustered(table(spark, sf_dir, "embeddings"))
    by = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each cluster
    facts = [(k, by.get(k, 0), sum(by.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rules: ClusterRules = ClusterRules()) -> str:
    ctes = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({rules.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {rules.size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {rules.size})",
        "u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS row, vec_id, q FROM v)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT q, sha256('{rules.seed}:' || vec_id) AS h FROM u) QUALIFY k < {rules.clusters})",
    ]
    near = "SELECT row, vec_id, q, k, d FROM (SELECT u.*, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM u, c{0}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1"
    for r in range(1, rules.rounds + 1):
        ctes.append(f"a{r} AS ({near.format(r - 1)})")
        ctes.append(f"s{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{r}) GROUP BY k, j)")
        ctes.append(f"m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY k)")
        ctes.append(f"c{r} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN m{r} m USING (k))")
    ctes.append(f"f AS MATERIALIZED ({near.format(rules.rounds)})")
    body = f"SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rules.rounds} USING (k)"
    return "WITH " + ",\n".join(ctes) + "\n" + body


OP11_SQL = _sql()
