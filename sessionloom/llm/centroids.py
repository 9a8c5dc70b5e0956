"""Integer k-means whose searches are cut short by a LAESA table of pivot distances.

Vectors are turned into integers, floor(``SCALE`` * x) of every component, so that distances, sums and means are exact.

1. ``kept_vectors``: rows of ``DIMENSIONS`` components, none null or non-finite.
2. ``pivot_table``: the start centroids are chosen by hash; some of them, far apart, are the pivots. Every vector's
   distances to the pivots are computed once and written beside its integers.
3. ``assign``: each round knows the pivots' distances to the centroids. The largest difference of a vector's and a centroid's
   distance to one pivot is a lower bound of the distance between the two (triangle inequality). A vector first
   meets the centroid of the least bound, then those alone whose bound doesn't pass the best squared distance so far; what survives
   gets exact integer distances. Bounds are lowered by far more than rounding can add, so no centroid that could win or tie is left out.
4. ``next_centroids``: tasks add up their own vectors by cluster; the sums of tasks are added as decimals, and the floor of the mean is
   taken in whole numbers. Only these sums of k clusters reach the driver.

Nulls: a null vector, one of another length or with a null, NaN or infinite component isn't kept; neither is one with a scaled
component of 2 ** 27 or more either way, whose distances don't fit a long. A vector without an id is assigned like any
other and starts a centroid only where fewer than k have one. Vectors that share an id are rows of their own; where such an id starts
centroids, rows in ascending order of their components do. Fewer than k vectors start as many centroids. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, stored

DIMENSIONS, SCALE, K, ROUNDS, PIVOTS, SEED = 64, 64, 16, 3, 8, 1
#: Scaled components stay below this: (2 ** 28) ** 2 * 64 < 2 ** 63.
LIMIT = 1 << 27
_TABLE = "vec_id long,vector binary,pivots binary"


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer components of the rows that qualify."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    sound = (F.size("embedding") == dimensions) & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LIMIT, F.lit(False)))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("v"))


def start_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order."""
    named = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [r["v"] for r in named.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Indices of ``n`` centroids, each the farthest from those before it; the first is centroid 0."""
    if not len(centroids):
        return np.empty(0, np.int64)
    chosen = [0]
    least = squared(centroids, centroids[:1])
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(centroids, centroids[chosen[-1] :][:1]))
    return np.array(chosen)


def pivot_table(kept: DataFrame, pivots: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """Written (vec_id, vector, pivots): integers as 32-bit ones, distances to the pivots as doubles."""
    schema = arrow_schema(_TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(-1, dimensions)
                far = np.sqrt(np.stack([squared(v, p[None]) for p in pivots], 1)) if len(pivots) else np.empty((len(v), 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(v.astype("<i4")), _binary(far.astype("<f8"))], schema=schema)

    return stored(kept.mapInArrow(run, _TABLE), "pivot-table")


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each vector, the smaller number winning ties, and how many distances were computed."""
    far = np.sqrt(np.stack([squared(centroids, p[None]) for p in pivots], 1))
    bound = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - far[None, :, p]), out=bound)
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0) ** 2 * (1 - 1e-9)
    cluster = bound.argmin(1)
    best = squared(v, centroids[cluster])
    computed, first = len(v), cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (bound[:, c] <= best))
        found = squared(v[rows], centroids[c : c + 1])
        computed += len(rows)
        better = (found < best[rows]) | (found == best[rows]) & (c < cluster[rows])
        cluster[rows[better]], best[rows[better]] = c, found[better]
    return cluster, best, computed


def _assigned(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("vector"), "<i4").astype(np.int64)
                yield batch.column("vec_id"), v, *nearest(v, _matrix(batch.column("pivots"), "<f8"), centroids, pivots)[:2]

    return run


def next_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floor of every non-empty cluster's mean; k rows of sums come to the driver."""
    each = _assigned(centroids, pivots)
    ddl = "cluster int,component int,total long,n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v, cluster, _ in each(batches):
            used = np.unique(cluster)
            sums = np.stack([v[cluster == c].sum(axis=0) for c in used])
            n = np.array([(cluster == c).sum() for c in used])
            width = v.shape[1]
            yield pa.RecordBatch.from_pydict({"cluster": np.repeat(used, width), "component": np.tile(np.arange(width), len(used)), "total": sums.ravel(), "n": np.repeat(n, width)}, schema=schema)

    sums = table.mapInArrow(run, ddl).groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return out


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    each = _assigned(centroids, pivots)
    ddl = "vec_id long,cluster int,distance long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return table.mapInArrow(run, ddl)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, n_pivots: int = PIVOTS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Written (vec_id, cluster, distance) and the final centroids."""
    kept = kept_vectors(vectors, dimensions, scale)
    centroids = np.array(start_centroids(kept, k, seed), np.int64).reshape(-1, dimensions)
    pivots = centroids[choose_pivots(centroids, n_pivots)]
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    table = pivot_table(kept, pivots, dimensions)
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, pivots)
    return stored(assign(table, centroids, pivots), "assigned"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All qualifying ``embeddings`` in 16 clusters after three rounds."""
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    sums = [(r["cluster"], int(r["s"])) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]  # k rows
    inertia, total = dict(sums), sum(s for _, s in sums)
    rows = spark.createDataFrame([(c, inertia.get(c, 0), total, digest) for c, digest in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle() -> str:
    means = "CAST((s - ((s % c) + c) % c) // c AS BIGINT)"
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"d{r} AS (SELECT v.row, v.vec_id, c.cluster, CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS BIGINT) AS distance FROM kept v CROSS JOIN c{r} c)")
        rounds.append(f"a{r} AS (SELECT row, any_value(vec_id) AS vec_id, min(struct_pack(distance := distance, cluster := cluster)) AS m FROM d{r} GROUP BY row)")
        rounds.append(
            f"s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS c FROM (SELECT a.m.cluster AS cluster, unnest(k.v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{r} a JOIN kept k ON k.row = a.row) x GROUP BY cluster, i), "
            f"c{r + 1} AS (SELECT c.cluster, coalesce(any_value(m.v), any_value(c.v)) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list({means} ORDER BY i) AS v FROM s{r} GROUP BY cluster) m ON m.cluster = c.cluster GROUP BY c.cluster)"
        )
    last = ROUNDS
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id))) - 1 AS INTEGER) AS cluster, v FROM kept QUALIFY cluster < {K}),
{", ".join(rounds)}
SELECT a.vec_id, a.m.cluster AS cluster, a.m.distance AS distance, CAST(sum(a.m.distance) OVER (PARTITION BY a.m.cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.m.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.cluster = a.m.cluster
"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _oracle()}
