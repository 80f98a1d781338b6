"""A vector index with exact pruning.

Unit vectors are clustered into cells by k-means in Spark, fitted on a bounded sample; every vector is
then put into the cell of its nearest centroid. A cell is a Parquet folder of its own, and for each the
centroid and the radius of the ball around it are kept. Between unit vectors the cosine distance is half
the squared Euclidean one, so the ball gives the least distance that any vector of a cell can have.

One query visits cells in order of that bound, a few more at each step, and stops when no other cell
can hold a better hit. Many queries first take the bar from their nearest cells, then meet just
the cells below it, in blocks of vectors and queries. Both give the rows of a full scan.

Builds go to a folder of their own and count once the pointer names them; readers of the old one go on.
Rows that came after the build are scanned beside it (``beyond``).

Zero vectors, nulls and vectors of another length than most are no candidates; ids are unique."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.files import Files
from .pointer import Pointer

#: Vectors that the centroids are fitted on, at most, in order of a hash of their id.
SAMPLE = 100_000
#: Cells, at most: their centroids and radii are all that a driver or a task holds.
MOST_CELLS = 4096
#: Vectors of a file or block, queries of a block.
BLOCK, QUERY_BLOCK = 50_000, 512
#: Vectors that meet all centroids at a time: a row of distances for each.
STEP = 512
#: Queries of a group, about.
QUERIES_TOGETHER = 20_000
#: What rounding may take from a bound, and the digits of a distance.
SLACK, DIGITS = 1e-9, 12


def unit_rows(column: pa.ListArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one."""
    lengths = np.diff(column.offsets.to_numpy())
    fits = (lengths == dimensions) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    norms = np.sqrt(np.square(flat).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        good = np.isfinite(norms) & (norms > 0)
    fits[np.flatnonzero(fits)[~good]] = False
    return flat[good] / norms[good, None], fits


def unit(query: Sequence[float]) -> np.ndarray | None:
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt(np.square(q).sum()))
    return q / norm if norm > 0 and np.isfinite(norm) else None


@dataclass(frozen=True)
class Cells:
    """Number, centroid, radius and size of each cell that has vectors."""

    names: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least cosine distance of each query to any vector of each cell."""
        apart = np.sqrt(np.maximum(0, np.square(queries).sum(axis=1)[:, None] - 2 * queries @ self.centroids.T + np.square(self.centroids).sum(axis=1)[None, :]))
        return np.square(np.maximum(0, apart - self.radii[None, :])) / 2 - SLACK


def _fit(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, cells: int, seed: int) -> np.ndarray:
    """Centroids of k-means over a bounded sample of unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    square = F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = vectors.where((F.size(vector_col) == dimensions) & (square > 0) & (square < float("inf")))
    sample = usable.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(SAMPLE).select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="features").transform(sample).select("features").repartition(max(1, sample.sparkSession.sparkContext.defaultParallelism)).cache()
    try:
        model = KMeans(k=max(2, cells), seed=seed, maxIter=10, initSteps=2).fit(rows) if rows.limit(2).count() > 1 else None
        return np.array(model.clusterCenters()) if model else np.array([r.features.toArray() for r in rows.collect()]).reshape(-1, dimensions)
    finally:
        rows.unpersist()


def _into_cells(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, centroids: np.ndarray) -> DataFrame:
    """id, embedding (unit, double), cell, reach: each vector with the distance to its centroid."""
    schema = StructType([StructField("id", vectors.schema[id_col].dataType), *StructType.fromDDL("embedding array<double>, cell int, reach double").fields])
    norms = np.square(centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            u, fits = unit_rows(batch.column(1), dimensions)
            cell = np.argmin(norms[None, :] - 2 * u @ centroids.T, axis=1).astype(np.int32) if len(u) else np.zeros(0, np.int32)
            reach = np.sqrt(np.square(u - centroids[cell]).sum(axis=1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * dimensions, pa.int32()), pa.array(u.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), rows, pa.array(cell), pa.array(reach)], names=schema.names)

    return vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).mapInArrow(run, schema)


def _apart(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors, without the last digits: equal vectors are equally far however
    the products were added up."""
    return np.round(1 - rows @ q, DIGITS)


def _best(distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances of a block, ties at the last one included."""
    if len(distance) <= k:
        return np.arange(len(distance))
    return np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])


class VectorIndex:
    """Below ``folder``: builds, and the pointer to the one that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.pointer = Pointer(Files(spark), f"{folder}/_log", {})
        #: Cells that the last search read, of how many.
        self.cells_read, self.cells_known = 0, 0
        self._held: tuple[str, Cells] | None = None

    def build(self, vectors: DataFrame, *, id_col: str = "uuid", vector_col: str = "embedding", cells: int | None = None, seed: int = 7, covers: Sequence[str] = ()) -> int:
        """Index all vectors; how many. covers: a note of what is in it, such as commits."""
        sizes = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        if not sizes:
            self.pointer.update(lambda _: {"folder": None, "dimensions": 0, "covers": list(covers)})
            return 0
        dimensions, n = sizes[0]
        centroids = _fit(vectors, id_col, vector_col, dimensions, min(MOST_CELLS, cells or int(np.ceil(n**0.5))), seed)
        name = f"build-{uuid.uuid4().hex}"
        if not len(centroids):
            self.pointer.update(lambda _: {"folder": None, "dimensions": 0, "covers": list(covers)})
            return 0
        path = f"{self.folder}/{name}"
        placed = _into_cells(vectors, id_col, vector_col, dimensions, centroids)
        placed.write.parquet(f"{path}/placed")
        placed = self.spark.read.parquet(f"{path}/placed")
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
        own = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        found.join(F.broadcast(own), "cell").coalesce(1).write.parquet(f"{path}/cells")  # one row a cell
        cell_sizes = F.broadcast(self.spark.read.parquet(f"{path}/cells").select("cell", "n"))
        # A large cell goes to several tasks and files.
        salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")
        placed.join(cell_sizes, "cell").withColumn("block", salt).drop("n", "reach").repartition("cell", "block").sortWithinPartitions("cell", "block").write.partitionBy("cell").parquet(f"{path}/vectors")
        Files(self.spark).remove(f"{path}/placed")
        self.pointer.update(lambda _: {"folder": name, "dimensions": dimensions, "covers": list(covers)})
        return int(self.cells().sizes.sum())

    def state(self) -> dict:
        return self.pointer.read()[1]

    def cells(self) -> Cells:
        name = self.state()["folder"]
        if self._held is None or self._held[0] != name:
            rows = self.spark.read.parquet(f"{self.folder}/{name}/cells").orderBy("cell").collect()  # at most MOST_CELLS
            self._held = name, Cells(np.array([r.cell for r in rows]), np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]), np.array([r.n for r in rows]))
        return self._held[1]

    def _vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.state()['folder']}/vectors")

    def search(self, query: Sequence[float], k: int) -> list[tuple]:
        """The k nearest (id, distance) by cosine distance, ties by id."""
        state, q = self.state(), unit(query)
        self.cells_read = self.cells_known = 0
        if not state.get("folder") or q is None or len(q) != state["dimensions"] or k < 1:
            return []
        cells, vectors = self.cells(), self._vectors()
        bounds = cells.bounds(q[None, :])[0]
        order = np.argsort(bounds, kind="stable")
        self.cells_known = len(order)
        hits: list[tuple] = []
        step = 1
        while self.cells_read < len(order):
            left = order[self.cells_read :]
            if len(hits) >= k:
                left = left[bounds[left] <= hits[k - 1][1]]
            if not len(left):
                break
            # Enough cells to fill the k, then four times as many at each step.
            enough = int(np.searchsorted(np.cumsum(cells.sizes[left]), k)) + 1 if len(hits) < k else 1
            now = left[: max(step, enough)]
            rows = vectors.where(F.col("cell").isin(cells.names[now].tolist())).select("id", "embedding").mapInArrow(_nearest_to(q, k), StructType([vectors.schema["id"], StructField("distance", DoubleType())]))
            hits = sorted([*hits, *((r.id, r.distance) for r in rows.orderBy("distance", "id").limit(k).collect())], key=lambda x: (x[1], x[0]))[:k]
            self.cells_read += len(now)
            step *= 4
        return hits

    def search_all(self, queries: DataFrame, k: int, *, id_col: str = "uuid", vector_col: str = "embedding") -> DataFrame:
        """The same for every row of ``queries``: query_id, id, distance, place from 1."""
        state, kind = self.state(), queries.schema[id_col].dataType
        if not state.get("folder"):
            return self.spark.createDataFrame([], StructType([StructField("query_id", kind), StructField("id", kind), *StructType.fromDDL("distance double, place int").fields]))
        asked = queries.select(queries[id_col].alias("query_id"), queries[vector_col].alias("v"))
        parts = max(1, -(-asked.count() // QUERIES_TOGETHER))
        near = self._met(self._ways(asked.withColumn("bar", F.lit(None).cast("double")), k, nearest=True), k, parts)
        bar = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bar"))
        far = self._met(self._ways(asked.join(bar, "query_id"), k, nearest=False), k, parts)
        return _first_k(near.unionByName(far), k)

    def _ways(self, queries: DataFrame, k: int, nearest: bool) -> DataFrame:
        """query_id, q, cell: the cells in order of the bound that fill the k, or those behind them that
        may beat the query's bar."""
        cells, dimensions = self.cells(), self.state()["dimensions"]
        schema = StructType([queries.schema["query_id"], *StructType.fromDDL("q array<double>, cell int").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, fits = unit_rows(batch.column("v"), dimensions)
                kept = pa.array(fits)
                ids, bars = batch.column("query_id").filter(kept), batch.column("bar").filter(kept).to_numpy(zero_copy_only=False)
                for i in range(len(u)):
                    bounds = cells.bounds(u[i : i + 1])[0]
                    order = np.argsort(bounds, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(cells.sizes[order]), k)) + 1
                    order = order[:enough] if nearest else order[enough:][bounds[order[enough:]] <= bars[i]]
                    n = len(order)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(n, i, np.int64))), pa.array([u[i]] * n, pa.list_(pa.float64())), pa.array(cells.names[order], pa.int32())], names=schema.names)

        return queries.select("query_id", "v", "bar").mapInArrow(run, schema)

    def _met(self, pairs: DataFrame, k: int, parts: int) -> DataFrame:
        """The k nearest of each query among its cells. A cell's vectors meet its queries block by block."""
        vectors = self._vectors()
        found = StructType([pairs.schema["query_id"], vectors.schema["id"], *StructType.fromDDL("distance double").fields])
        blocks = vectors.groupBy("cell").agg(F.max("block").alias("last"))  # a row per cell
        asked = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).select("cell", "block", "part", "query_id", "q")
        held = vectors.join(asked.select("cell", "block", "part").distinct(), ["cell", "block"]).select(*[F.col(c).alias(f"own_{c}") for c in ("cell", "block", "part")], "id", "embedding")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [pa.table([pa.array([], left.schema.field("query_id").type), pa.array([], right.schema.field("id").type), pa.array([], pa.float64())], names=found.names)]
            if left.num_rows and right.num_rows:
                ids, rows = right.column("id").combine_chunks(), np.stack(right.column("embedding").to_numpy())
                for begin in range(0, left.num_rows, QUERY_BLOCK):
                    some = left.slice(begin, QUERY_BLOCK)
                    for i, row in enumerate(_apart(np.stack(some.column("q").to_numpy()), rows.T)):
                        best = pa.array(_best(row, k))
                        own = pa.table([some.column("query_id").take(pa.array(np.full(len(best), i, np.int64))), ids.take(best), pa.array(row).take(best)], names=found.names)
                        out.append(own.sort_by([("distance", "ascending"), ("id", "ascending")]).slice(0, k))
            return pa.concat_tables(out)

        met = asked.groupBy("cell", "block", "part").cogroup(held.groupBy("own_cell", "own_block", "own_part")).applyInArrow(meet, found)
        return _first_k(met, k).drop("place")


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return hits.select("query_id", "id", "distance").withColumn("place", nth).where(F.col("place") <= k)


def _nearest_to(q: np.ndarray, k: int):
    """The k nearest rows of each task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q))
            distance = _apart(rows, q)
            best = pa.array(_best(distance, k))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(best), pa.array(distance).take(best)], names=["id", "distance"])

    return run


def merged(parts: Sequence[Sequence[tuple]], k: int) -> list[tuple]:
    """The k best of several lists of (id, distance), an id once."""
    best: dict = {}
    for i, d in reduce(lambda a, b: [*a, *b], parts, []):
        best[i] = min(round(d, DIGITS), best.get(i, d))
    return sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
