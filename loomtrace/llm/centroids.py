"""Exact k-means by balls (operator 12).

A cluster is a ball: its centroid and a radius that all members lie within. Only clusters whose
centroid is within twice the radius can take a member over, these are its neighbours. A member that
is nearer to its centroid than half the way to the nearest neighbour is in the stable core and is
compared with nobody; one in the annulus beyond half the way to the i-th neighbour is compared with
the first i neighbours exactly. All arithmetic that decides is on integers, so the clusters equal
those of comparing everything, ties included.

Each round is written to the shared folder: vectors with their cluster and distance. The driver sees
centroids, counts, sums and radii of clusters alone. A radius isn't measured again after a centroid
moved: the old one plus the way it moved is a bound.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out.
Integers beyond +-2^25 are cut to it. Repeated rows and ids each count; of equal hashes the lesser
vector is first; a null id hashes as no text and comes last. With fewer vectors than clusters there
are as many clusters as vectors. An empty table gives no rows. Sums beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_folder, remove
from .texts import id_first, working
from .vectors import integers, listed, matrix

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64


@dataclass(frozen=True)
class Balls:
    """Centroids, and for each its neighbours in order of distance with the squared distances."""

    centroids: np.ndarray
    neighbours: tuple[tuple[tuple[int, int], ...], ...]

    @classmethod
    def around(cls, centroids: np.ndarray, radii: np.ndarray) -> Balls:
        """radii: a bound for each centroid (infinite: all others are neighbours)."""
        apart = np.square(centroids[:, None, :] - centroids[None, :, :]).sum(axis=2)
        near = []
        for i, row in enumerate(apart):
            order = sorted((int(s), j) for j, s in enumerate(row) if j != i)
            near.append(tuple((j, s) for s, j in order if s <= 4 * radii[i] ** 2))
        return cls(centroids, tuple(near))


def _distance(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.square(rows - centroid).sum(axis=1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of rows that have no cluster yet: all centroids are compared."""
    best, cluster = _distance(rows, centroids[0]), np.zeros(len(rows), np.int32)
    for j in range(1, len(centroids)):
        d = _distance(rows, centroids[j])
        closer = d < best
        best[closer], cluster[closer] = d[closer], j
    return cluster, best


def settle(rows: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for rows with a cluster, and how many distances to other centroids it took."""
    out, distance, compared = cluster.copy(), np.zeros(len(rows), np.int64), 0
    for i in np.unique(cluster).tolist():
        own = np.flatnonzero(cluster == i)
        members = rows[own]
        to_own = _distance(members, balls.centroids[i])
        best, name = to_own.copy(), np.full(len(own), i, np.int32)
        for j, apart in balls.neighbours[i]:
            ring = np.flatnonzero(4 * to_own >= apart)  # all others are nearer than half the way
            if not len(ring):
                break
            d = _distance(members[ring], balls.centroids[j])
            compared += len(ring)
            closer = (d < best[ring]) | ((d == best[ring]) & (j < name[ring]))
            best[ring[closer]], name[ring[closer]] = d[closer], j
        out[own], distance[own] = name, best
    return out, distance, compared


def _first(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """id, v: the vectors that count, as integers."""
    schema = id_first(vectors, id_col, "id", "v array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = integers(batch.column(1))
            kept = pa.array(good & (np.diff(x.offsets.to_numpy()) == dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), x.filter(kept)], names=["id", "v"])

    return vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).mapInArrow(working("centroids", run), schema)


def _assigned(rows: DataFrame, balls: Balls, dimensions: int, known: bool) -> DataFrame:
    """id, v, cluster, distance under these balls. known: rows have a cluster already."""
    schema = id_first(rows, "id", "id", "v array<int>, cluster int, distance long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dimensions)
            cluster, distance = settle(x, batch.column("cluster").to_numpy(), balls)[:2] if known else nearest(x, balls.centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed(x), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=schema.names)

    return rows.mapInArrow(working("centroids", run), schema)


def _moved(rows: DataFrame, centroids: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """New centroids, and a bound of the radius of each ball around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, n, far = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, cluster = matrix(batch.column("v"), dimensions), batch.column("cluster").to_numpy()
            np.maximum.at(far, cluster, batch.column("distance").to_numpy())
            n += np.bincount(cluster, minlength=k)
            for i in np.unique(cluster).tolist():
                sums[i] += x[cluster == i].sum(axis=0)
        for i in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_pydict({"cluster": np.full(dimensions, i), "at": np.arange(dimensions), "total": sums[i], "n": np.full(dimensions, n[i]), "far": np.full(dimensions, far[i])})

    parts = rows.select("v", "cluster", "distance").mapInArrow(working("centroids", run), "cluster long, at long, total long, n long, far long")
    new, radii = centroids.copy(), np.zeros(len(centroids))
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        new[r.cluster, r["at"]] = r.total // r.n
        radii[r.cluster] = r.far**0.5
    way = np.sqrt(np.square(new - centroids).sum(axis=1).astype(np.float64))
    return new, (radii + way) * (1 + 1e-9) + 1e-9


def ball_k_means(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """A row per vector: its cluster and squared distance, sums of these, the centroid's digest."""
    spark = vectors.sparkSession
    folders: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        folders.append(new_folder(spark, "centroids"))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    schema = id_first(vectors, id_col, id_col, "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = written(_first(vectors, id_col, vector_col, dimensions))
    name = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(F.asc_nulls_last(name), "v").limit(clusters).select("v").collect()
    if not seeds:
        return spark.createDataFrame([], schema)
    centroids = np.array([s.v for s in seeds], np.int64)
    balls = Balls.around(centroids, np.full(len(seeds), np.inf))
    for k in range(rounds + 1):
        rows = written(_assigned(rows, balls, dimensions, known=k > 0))
        remove(folders.pop(0))  # the round before is read no more
        if k < rounds:
            centroids, radii = _moved(rows, centroids, dimensions)
            balls = Balls.around(centroids, radii)
    own = rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()
    every = sum(r.s for r in own) if all(r.s is not None for r in own) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r.cluster, r.s, every if every is not None and every < 1 << 63 else None, digest[r.cluster]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(facts), "cluster").select(schema.names)  # facts: a row per cluster
